"""Queries of aggregations, windows, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnmaps.functions import clicks as C
from attnmaps.operators import filters, stats
from attnmaps.plans import jobs
from attnmaps.plans.base import CLEAN, SUB, query
from attnmaps.plans.q_filters import BOTH, TEST, keyed, shown


@query("SELECT image_key, count(*) AS n FROM cl GROUP BY image_key", *BOTH, extra=CLEAN)
def agg1_maps_per_image(t):
    return stats.maps_per_image(jobs.clean(t.subs, TEST))


@query("SELECT count(*) AS total_maps, count(DISTINCT image_key) AS unique_images, true AS deduped FROM dd WHERE rn = 1", *BOTH, extra=CLEAN)
def agg2_run_summary(t):
    rows = filters.dedupe_first(filters.filter_mobile(filters.filter_catch(keyed(t))))
    return stats.run_summary(rows, True)


@query("""SELECT *, n_caught - n_deduped AS n_duplicates, (n_caught - n_deduped) / n_caught AS share_duplicates FROM (
  SELECT (SELECT count(*) FROM sub) AS n_before, (SELECT count(*) FROM dd) AS n_caught, (SELECT count(*) FROM dd WHERE rn = 1) AS n_deduped,
    (SELECT count(*) FROM dd WHERE rn = 1 AND n > 1) AS n_kept, (SELECT count(*) FROM dd WHERE rn = 1 AND n = 0) AS n_empty)""", *BOTH, extra=CLEAN)
def agg3_filter_report(t):
    return stats.filter_report(keyed(t))


@query("SELECT image_key, CAST(floor(median(size)) AS BIGINT) AS median FROM cl GROUP BY image_key", *BOTH, extra=CLEAN)
def agg4_medians_image(t):
    return stats.medians_image(jobs.clean(t.subs, TEST))


PER_IMAGE = "pi AS (SELECT image_key, split_part(image_key, '/', 1) AS category, count(*) AS n FROM sub GROUP BY image_key)"


@query("SELECT category, CAST(floor(median(n)) AS BIGINT) AS median FROM pi GROUP BY category", *BOTH, extra=f"{SUB},\n{PER_IMAGE}")
def agg5_medians_category(t):
    return stats.medians_category(keyed(t))


@query("SELECT CAST(floor(median(n)) AS BIGINT) AS median, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS percentile, round(avg(n), 9) AS mean FROM pi", *BOTH, extra=f"{SUB},\n{PER_IMAGE}")
def agg6_medians_all(t):
    return stats.medians_all(keyed(t)).withColumn("mean", F.round("mean", 9))


BATCHED = f"{SUB},\n{PER_IMAGE},\nb AS (SELECT *, CAST('0x' || substr(md5(image_key), 1, 7) AS BIGINT) % 4 AS batch FROM pi)"


@query("SELECT category, CAST(floor(median(m)) AS BIGINT) AS median FROM (SELECT category, CAST(floor(median(n)) AS BIGINT) AS m FROM b GROUP BY category, batch) GROUP BY category", *BOTH, extra=BATCHED)
def agg7_medians_batched_category(t):
    return stats.medians_batched(keyed(t), 4)[0]


@query("""SELECT CAST(floor(median(m)) AS BIGINT) AS median, CAST(floor(median(p)) AS BIGINT) AS percentile, round(avg(a), 9) AS mean
  FROM (SELECT CAST(floor(median(n)) AS BIGINT) AS m, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS p, avg(n) AS a FROM b GROUP BY batch)""", *BOTH, extra=BATCHED)
def agg7_medians_batched_all(t):
    return stats.medians_batched(keyed(t), 4)[1].withColumn("mean", F.round("mean", 9))


@query("SELECT regexp_extract(image_path, '[^/]+$') AS file, count(*) AS n FROM submissions WHERE contains(image_path, '/c2/') GROUP BY 1", "submissions")
def agg8_subjects_per_file(t):
    return stats.subjects_per_file(t.submissions, "/c2/")


@query("""SELECT a AS is_animal, round(avg(n), 6) AS mean, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75,
  round(100.0 * count(*) FILTER (n > 5) / count(*), 6) AS percent_over
  FROM (SELECT file_pointer, CAST(substr(split_part(file_pointer, '/', 3), 2) AS BIGINT) < 2666196 AS a, count(*) AS n FROM pointers GROUP BY file_pointer) GROUP BY a""", "pointers")
def agg9_maps_stats_by_group(t):
    return stats.maps_stats_by_group(t.pointers).withColumns({"mean": F.round("mean", 6), "percent_over": F.round("percent_over", 6)})


PER_USER = "pu AS (SELECT user_id, count(*) AS n FROM pointers GROUP BY user_id)"


@query("""SELECT CAST(s AS BIGINT) AS super_at, CAST(l AS BIGINT) AS light_at, count(*) FILTER (n > s) AS n_super, count(*) FILTER (n < l) AS n_light, count(*) AS n_users
  FROM pu, (SELECT ceil(quantile_cont(n, 0.95) / 10) * 10 AS s, greatest(10, ceil(quantile_cont(n, 0.25) / 10) * 10) AS l FROM pu) GROUP BY s, l""", "pointers", extra=PER_USER)
def agg10_user_activity(t):
    return stats.user_activity(t.pointers, 10)


@query("""SELECT CAST(least(n // 7, last) * 7 AS BIGINT) AS bin_start, count(*) AS n_users
  FROM pu, (SELECT CAST(ceil((max(n) + 7) / 7) AS BIGINT) - 2 AS last FROM pu) GROUP BY 1""", "pointers", extra=PER_USER)
def agg11_user_histogram(t):
    return stats.user_histogram(t.pointers, 7)


@query("SELECT sub_id, label, round(weight, 9) AS weight FROM (SELECT sub_id, label, count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)) AS weight FROM submissions JOIN players USING (user_id))", "submissions", "players")
def agg12_class_balance(t):
    return stats.class_balance(filters.filter_players(t.submissions, t.players)).select("sub_id", "label", F.round("weight", 9).alias("weight"))


@query("SELECT CAST(floor(greatest(max(x), max(y)) / 4) AS BIGINT) AS extent FROM clicks", "clicks")
def agg13_coord_extent(t):
    return stats.coord_extent(t.subs.select(F.col("clicks.x").alias("clickmap_x"), F.col("clicks.y").alias("clickmap_y")), 4)


@query("SELECT category, count(*) FILTER (n > 154) AS n_images FROM pi GROUP BY category HAVING n_images > 0", *BOTH, extra=f"{SUB},\n{PER_IMAGE}")
def agg14_well_covered_per_class(t):
    return stats.well_covered_per_class(keyed(t), 154)


def _scores(t):
    """Scores of which every seventeenth is NaN."""
    return t.scores.withColumn("score", F.when(F.col("image_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


@query("""SELECT round(c, 9) AS mean_ceiling, round(f, 9) AS mean_floor, round(c / f, 9) AS ratio
  FROM (SELECT avg(score) FILTER (kind = 'ceiling') AS c, avg(score) FILTER (kind = 'floor') AS f FROM scores WHERE image_id % 17 <> 0)""", "scores")
def agg15_ceiling_floor_summary(t):
    return stats.ceiling_floor_summary(_scores(t)).select(*[F.round(c, 9).alias(c) for c in ("mean_ceiling", "mean_floor", "ratio")])


@query("""SELECT axis, diff, round(c, 9) AS mean_ceiling, round(f, 9) AS mean_floor, round(c / f, 9) AS ratio FROM (
  SELECT CASE WHEN image_id % 2 = 0 THEN 'scale' ELSE 'rotation' END AS axis, CAST(image_id % 5 - 2 AS INT) AS diff,
    avg(score) FILTER (kind = 'ceiling' AND NOT (image_id % 2 = 1 AND image_id % 17 = 0)) AS c, avg(score) FILTER (kind = 'floor') AS f FROM scores GROUP BY ALL)""", "scores")
def agg16_constancy_summary(t):
    rows = t.scores.select(F.when(F.col("image_id") % 2 == 0, "scale").otherwise("rotation").alias("axis"), (F.col("image_id") % 5 - 2).cast("int").alias("diff"), "kind", F.when((F.col("image_id") % 34 == 17) & (F.col("kind") == "ceiling"), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    return stats.constancy_summary(rows).select("axis", "diff", *[F.round(c, 9).alias(c) for c in ("mean_ceiling", "mean_floor", "ratio")])


@query("SELECT image_id, kind, round(avg(s), 9) AS score FROM (SELECT image_id % 500 AS image_id, kind, image_id % 3 AS level, avg(score) FILTER (image_id % 17 <> 0) AS s FROM scores GROUP BY ALL) GROUP BY image_id, kind", "scores")
def agg17_integrate_scores(t):
    rows = _scores(t).withColumns({"level": F.col("image_id") % 3, "image_id": F.col("image_id") % 500})
    out = stats.integrate_scores(rows, ["image_id", "kind"], skip_nan_levels=True)
    return out.withColumn("score", F.round(F.nanvl("score", F.lit(None).cast("double")), 9))


# --- windows, top-k, sampling ------------------------------------------------------------


@query("SELECT sub_id, image_key, n FROM dd WHERE rn = 1", *BOTH, extra=CLEAN)
def win1_dedupe_first(t):
    return shown(filters.dedupe_first(filters.filter_mobile(filters.filter_catch(keyed(t)))))


@query("""SELECT sub_id, image_key, n FROM sub WHERE image_key IN (
  SELECT image_key FROM (SELECT image_key, row_number() OVER (PARTITION BY split_part(image_key, '/', 1) ORDER BY min(ord), image_key) AS r FROM sub GROUP BY image_key HAVING count(*) > 154) WHERE r <= 5)""", *BOTH, extra=SUB)
def win2_sample_per_class(t):
    return shown(stats.sample_per_class(keyed(t), 154, 5, None))


@query("""SELECT * FROM (SELECT 'top' AS side, image_id, score FROM scores WHERE kind = 'ceiling' ORDER BY score DESC, image_id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'bottom' AS side, image_id, score FROM scores WHERE kind = 'ceiling' ORDER BY score, image_id LIMIT 10)""", "scores")
def win3_top_bottom(t):
    return stats.top_bottom(t.scores.where("kind = 'ceiling'"), 10, key_col="image_id")


@query("""SELECT file_pointer, n FROM fc WHERE n >= (SELECT min(n) FROM (SELECT n, coalesce(sum(m) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT n, n * count(*) AS m FROM fc GROUP BY n)) WHERE before < 50)""", "pointers", extra="fc AS (SELECT file_pointer, count(*) AS n FROM pointers GROUP BY file_pointer)")
def win4_most_clicked_until(t):
    return stats.most_clicked_until(t.pointers.groupBy("file_pointer").agg(F.count(F.lit(1)).alias("n")), 50)


@query("SELECT image_key, count(*) AS n FROM sub GROUP BY image_key ORDER BY n DESC, image_key LIMIT 10", *BOTH, extra=SUB)
def win5_display_keys(t):
    return stats.display_keys(stats.maps_per_image(keyed(t)))


@query("SELECT sub_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM clicks WHERE pos < 3 GROUP BY sub_id", "clicks")
def win6_click_prefix(t):
    rows = t.subs.where(F.size("clicks") > 0).select("sub_id", C.click_prefix("clicks", 3).alias("c"))
    total = lambda c: F.aggregate(F.col(f"c.{c}"), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("sub_id", F.size("c").cast("long").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query("""SELECT draw, label, sub_id, user_id, round(weight, 9) AS weight FROM (
  SELECT draw, l.label, CAST('0x' || substr(md5(draw || '|7|row'), 1, 15) AS BIGINT) % total AS i FROM (
    SELECT range AS draw, CAST('0x' || substr(md5(range || '|7|label'), 1, 15) AS BIGINT) % (SELECT count(DISTINCT label) FROM sp) AS l FROM range((SELECT count(*) FROM sp))) d
  JOIN (SELECT label, count(*) AS total, row_number() OVER (ORDER BY label) - 1 AS l FROM sp GROUP BY label) l USING (l))
  JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(CAST(sub_id AS VARCHAR)), 1, 8) AS BIGINT) % 256, sub_id) - 1 AS i, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS weight FROM sp) USING (label, i)""",
    "submissions", "players", extra="sp AS (SELECT sub_id, user_id, label FROM submissions JOIN players USING (user_id))")
def smp1_balanced_resample(t):
    """As many draws as there are rows, exactly."""
    rows = filters.filter_players(t.submissions, t.players).select("sub_id", "user_id", "label")
    return stats.balanced_resample(rows, "sub_id", seed=7).withColumn("weight", F.round("weight", 9))


@query("""SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42'), user_id) AS r FROM players WHERE label = 1)
  WHERE r <= (SELECT count(*) FROM players WHERE label = 0)""", "players")
def smp2_match_good_players(t):
    bad = t.players.where("label = 0").count()
    return stats.match_good_players(t.players.where("label = 1").select("user_id"), bad)


@query("SELECT DISTINCT image_path FROM submissions", "submissions")
def set1_distinct_images(t):
    return t.submissions.select("image_path").distinct()
