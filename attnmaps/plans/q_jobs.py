"""Queries of the agreement jobs, player quality and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from attnmaps.operators import agreement, filters, joins, players, raster, sinks, stats
from attnmaps.plans import agreement_sql as own
from attnmaps.plans import jobs
from attnmaps.plans.base import CLEAN, KERNEL, SIDE, SUB, query
from attnmaps.plans.q_filters import BOTH, TEST
from attnmaps.plans.q_rasters import LEVELS, cleaned
from attnmaps.sources.shared import scratch, settled

SMALL = agreement.Agreement(h=SIDE, w=SIDE, kernel=KERNEL, iterations=4, crop=own.CROP, short_side=SIDE, seed=3)
#: Ten levels, compared by area.
LEVELLED = replace(SMALL, metric="auc", levels=10, iterations=2)
SCORED = "SELECT image_key, level, kind, iteration, round(score, 6) AS score FROM sr"


def _tidy(df):
    return df.withColumn("score", F.round(F.nanvl("score", F.lit(None).cast("double")), 6))


@query(SCORED, *BOTH, extra=f"{CLEAN},\n{own.image_job(('ceiling',), 3, 4)}")
def job1_split_half(t):
    return _tidy(agreement.split_half(cleaned(t), SMALL))


@query(SCORED, *BOTH, extra=f"{CLEAN},\n{own.image_job(('ceiling',), 3, 4, redraw=True, metric=own.AUC)}")
def job2_split_half_redrawn(t):
    return _tidy(agreement.split_half(cleaned(t), replace(SMALL, redraw_test=True, metric="auc")))


@query(SCORED, *BOTH, extra=f"{CLEAN},\n{own.image_job(('floor',), 3, 4)}")
def job3_floor(t):
    return _tidy(agreement.floor(cleaned(t), SMALL))


#: Maps of every level, cut to the least number of an image's levels.
STACKS = f"""{LEVELS},
mp AS (SELECT image_key, level, sub_id FROM (SELECT *, row_number() OVER (PARTITION BY image_key, level ORDER BY sub_id) AS r, min(c) OVER (PARTITION BY image_key) AS m
    FROM (SELECT image_key, level, sub_id, count(*) OVER (PARTITION BY image_key, level) AS c FROM (SELECT DISTINCT image_key, level, sub_id FROM ls))) WHERE m >= 2 AND r <= m),
pxl AS (SELECT image_key, level, sub_id, y, x, n FROM ls JOIN mp USING (image_key, level, sub_id))"""


@query(SCORED, *BOTH, extra=own.image_job(("ceiling", "floor"), 3, 2, metric=own.AUC, maps=STACKS))
def job1_job3_all_levels(t):
    """Ceilings and floors at each of ten cut points."""
    return _tidy(agreement.ceiling_floor(cleaned(t), LEVELLED))


def _framed(t):
    """Cleaned submissions keyed by frame."""
    return cleaned(t).join(t.frames.select("image_key", "frame_key"), "image_key").drop("image_key").withColumnRenamed("frame_key", "image_key")


FRAMED = "SELECT key AS image_key, '{axis}' AS axis, diff, level, kind, iteration, round(score, 6) AS score FROM sr"
SCALED = f"{CLEAN},\n{own.frame_job(own.SCALE_PAIRS, 'a.scale / b.scale', own.RESCALED, 3, 4)}"


@query(FRAMED.format(axis="scale"), *BOTH, "frames", extra=SCALED)
def job4_scale_constancy(t):
    pairs = joins.frame_pairs(t.frames, "scale")[0]
    return _tidy(agreement.scale_constancy(_framed(t), pairs, t.frames.select(F.col("frame_key").alias("key"), "scale"), SMALL))


@query(FRAMED.format(axis="rotation"), *BOTH, "frames", extra=f"{CLEAN},\n{own.frame_job(own.ROTATION_PAIRS, 'b.frame - a.frame', own.SHIFTED, 3, 4)}")
def job5_rotation_constancy(t):
    """Cameras of one depth that shift to the side by a frame's number."""
    pairs = joins.frame_pairs(t.frames, "rotation")[0]
    row = lambda *xs: F.array(*[F.lit(float(x)) if not hasattr(x, "alias") else x for x in xs])
    shift = (F.col("image_id") % 24).cast("double") / 10
    cameras = t.frames.select(
        F.col("frame_key").alias("key"), F.array(row(1, 0, 0, shift), row(0, 1, 0, 0), row(0, 0, 1, 0), row(0, 0, 0, 1)).alias("w2c"),
        F.array(row(20, 0, 16), row(0, 20, 16), row(0, 0, 1)).alias("k"), F.array_repeat(F.lit(10.0), SIDE * SIDE).alias("depth"),
    )
    return _tidy(agreement.rotation_constancy(_framed(t), pairs, cameras, SMALL))


CAPPED = """mp AS (SELECT cap, image_key, 0 AS level, sub_id FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY ord, sub_id) AS r FROM cl), (SELECT unnest([5, 10, 15]) AS cap) WHERE r <= cap),
pxl AS (SELECT image_key, 0 AS level, sub_id, y, x, n FROM ra)"""


@query("SELECT cap, image_key, level, kind, iteration, round(score, 6) AS score FROM sr", *BOTH, extra=f"{CLEAN},\n{own.image_job(('ceiling', 'floor'), 3, 4, by='cap', maps=CAPPED)}")
def job6_subject_sweep(t):
    return _tidy(agreement.subject_sweep(cleaned(t), [5, 10, 15], SMALL))


@query("SELECT sub_id, image_key, size AS n FROM cl WHERE sub_id % 3 <> 0", *BOTH, extra=CLEAN)
def job7_participant_filter(t):
    rows = cleaned(t)
    verdicts = rows.select("sub_id", F.when(F.col("sub_id") % 3 != 0, 1).otherwise(0).alias("good"))
    return players.participant_filter(rows, verdicts).select("sub_id", "image_key", F.size("clicks").cast("long").alias("n"))


@query()
def job8_player_classifier(t):
    # read for the class weights, the fit and the predictions
    labelled = settled(filters.filter_players(filters.drop_trivial(t.subs), t.players).select("sub_id", "user_id", "label", "clicks"), "labelled")
    model = players.train_player_classifier(labelled, 4, 8)
    return players.predict_players(labelled, model, 4, 8).select("sub_id", "user_id", "label", "good")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 5) for c in columns})


@query("""SELECT round(c, 5) AS mean_ceiling, round(f, 5) AS mean_floor, round(c / nullif(f, 0), 5) AS ratio FROM (SELECT avg(score) FILTER (kind = 'ceiling') AS c, avg(score) FILTER (kind = 'floor') AS f
  FROM (SELECT image_key, kind, avg(score) AS score FROM sr GROUP BY ALL))""", *BOTH, extra=f"{CLEAN},\n{own.image_job(('ceiling', 'floor'), 3, 4)}")
def w2_ceiling_floor(t):
    return _rounded(jobs.ceiling_floor(cleaned(t), SMALL)[1], "mean_ceiling", "mean_floor", "ratio")


@query("""SELECT 'scale' AS axis, diff, round(c, 5) AS mean_ceiling, round(f, 5) AS mean_floor, round(c / nullif(f, 0), 4) AS ratio FROM (SELECT diff, avg(score) FILTER (kind = 'ceiling') AS c, avg(score) FILTER (kind = 'floor') AS f
  FROM (SELECT key, diff, kind, avg(score) AS score FROM sr GROUP BY ALL) GROUP BY diff)""", *BOTH, "frames", extra=SCALED)
def w3_scale_constancy(t):
    pairs = joins.frame_pairs(t.frames, "scale")[0]
    summary = jobs.scale_constancy(_framed(t), pairs, t.frames.select(F.col("frame_key").alias("key"), "scale"), SMALL)[1]
    return _rounded(summary, "mean_ceiling", "mean_floor").withColumn("ratio", F.round("ratio", 4))


W3_ROTATION = f"{CLEAN},\n{own.frame_job(own.ROTATION_PAIRS, 'b.frame - a.frame', own.DEPTHS, 3, 2)}"


@query("""SELECT 'rotation' AS axis, diff, round(c, 5) AS mean_ceiling, round(f, 5) AS mean_floor, round(c / nullif(f, 0), 4) AS ratio FROM (SELECT diff, avg(score) FILTER (kind = 'ceiling') AS c, avg(score) FILTER (kind = 'floor') AS f
  FROM (SELECT key, diff, kind, avg(score) AS score FROM sr GROUP BY ALL) GROUP BY diff)""", *BOTH, "frames", extra=W3_ROTATION)
def w3_rotation_constancy(t):
    """Cameras that shift to the side before a surface of two depths, of which the near half hides parts of the far one."""
    pairs = joins.frame_pairs(t.frames, "rotation")[0]
    row = lambda *xs: F.array(*[F.lit(float(x)) if not hasattr(x, "alias") else x for x in xs])
    shift = (F.col("image_id") % 24).cast("double") / 10
    depth = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.when(i % SIDE < SIDE // 2, 25.0).otherwise(10.0))
    cameras = t.frames.select(
        F.col("frame_key").alias("key"), F.array(row(1, 0, 0, shift), row(0, 1, 0, 0), row(0, 0, 1, 0), row(0, 0, 0, 1)).alias("w2c"),
        F.array(row(20, 0, 16), row(0, 20, 16), row(0, 0, 1)).alias("k"), depth.alias("depth"),
    )
    summary = jobs.rotation_constancy(_framed(t), pairs, cameras, replace(SMALL, iterations=2))[1]
    return _rounded(summary, "mean_ceiling", "mean_floor").withColumn("ratio", F.round("ratio", 4))


WHOLE = f"""{SUB},
dd AS (SELECT *, row_number() OVER (PARTITION BY image_key, user_id, image_path ORDER BY ts NULLS LAST, ord) AS rn FROM sub WHERE user_catch_trial >= 0.95 AND NOT is_mobile),
cl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY image_key) AS subjects FROM dd
  WHERE rn = 1 AND n > 1 AND split_part(image_key, '/', 1) IN (SELECT category FROM classes) AND sub_id % 3 <> 0) WHERE subjects >= 5),
sz AS (SELECT image_key, coalesce(height, 32) AS h, coalesce(width, 32) AS w FROM (SELECT DISTINCT image_key FROM cl) LEFT JOIN dims USING (image_key)),
px AS (SELECT c.*, image_key FROM clicks c JOIN cl USING (sub_id) JOIN sz USING (image_key) WHERE pos < 6 AND x >= 0 AND x < w AND y >= 0 AND y < h),
vi AS (SELECT image_key, count(DISTINCT sub_id) AS maps FROM px GROUP BY image_key HAVING count(DISTINCT sub_id) >= 5),
mm AS (SELECT image_key, y, x, count(*) / any_value(maps) AS v FROM px JOIN vi USING (image_key) GROUP BY image_key, y, x),
io AS (SELECT image_key, count(*) FILTER (a AND b) / count(*) FILTER (a OR b) AS iou
  FROM (SELECT k.image_key, coalesce(m.v > bar, false) AS a, g.x BETWEEN x0 AND x1 AND g.y BETWEEN y0 AND y1 AS b
    FROM masks JOIN (SELECT image_key, max(v) * 0.5 AS bar FROM mm GROUP BY image_key) k ON split_part(k.image_key, '.', 1) = mask_key
    CROSS JOIN (SELECT x, y FROM range(48) r(x), range(48) s(y)) g LEFT JOIN mm m ON m.image_key = k.image_key AND m.x = g.x AND m.y = g.y) GROUP BY image_key)"""


@query("SELECT image_key, h, w, h * w AS n, maps FROM vi JOIN sz USING (image_key) JOIN io USING (image_key) WHERE iou < 0.05", *BOTH, "classes", "dims", "masks", extra=WHOLE)
def w1_prepare(t):
    """The whole job: classes, participants, canvases and blur of the images' own sizes, masks."""
    verdicts = t.submissions.select("sub_id", F.when(F.col("sub_id") % 3 != 0, 1).otherwise(0).alias("good"))
    masks = t.masks.select("mask_key", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("mask_key", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    heat, counts = jobs.prepare(t.subs, TEST, t.classes, verdicts, t.dims, masks, 0.05)
    return heat.join(counts, "image_key").select("image_key", "h", "w", F.size("data").alias("n"), "maps")


# --- sinks -----------------------------------------------------------------------------


@query("SELECT image_key, replace(image_key, '/', '_') AS name, 32 AS h, 32 AS w, 1024 AS n, maps FROM vi", *BOTH, extra=CLEAN)
def snk1_heatmaps(t):
    path = scratch(t.spark, "heatmaps")
    rows = cleaned(t)
    rasters = raster.keep_valid(raster.rasterise(rows, SIDE, SIDE), TEST.min_clicks, TEST.min_subjects)
    sinks.write_heatmaps(jobs.heatmaps(rows, TEST), path, rasters.groupBy("image_key").agg(F.countDistinct("sub_id").alias("maps")))
    return t.spark.read.parquet(path).select("image_key", "name", "h", "w", F.size("data").alias("n"), "maps")


@query("""SELECT 1 AS generation, image_key, maps FROM vi
  UNION ALL SELECT 2, image_key, CASE WHEN split_part(image_key, '/', 1) IN ('c1', 'c3') THEN -maps ELSE maps END FROM vi""", *BOTH, extra=CLEAN)
def snk1_replaced_heatmaps(t):
    """Two generations of a store: all images, then those of two classes written again."""
    path, rows = scratch(t.spark, "store"), cleaned(t)
    rasters = raster.keep_valid(raster.rasterise(rows, SIDE, SIDE), TEST.min_clicks, TEST.min_subjects)
    counts = rasters.groupBy("image_key").agg(F.countDistinct("sub_id").alias("maps"))
    maps = jobs.heatmaps(rows, TEST)
    first = sinks.replace_heatmaps(maps, path, counts)
    again = maps.where(F.split_part("image_key", F.lit("/"), F.lit(1)).isin("c1", "c3"))
    second = sinks.replace_heatmaps(again, path, counts.withColumn("maps", -F.col("maps")))
    read = lambda g: sinks.read_heatmaps(t.spark, path, g).select(F.lit(g).alias("generation"), "image_key", "maps")
    return read(first).unionAll(read(second))


@query("SELECT image_key, 32 AS h FROM vi WHERE EXISTS (SELECT 1 FROM listing WHERE contains(path, image_key))", *BOTH, "listing", extra=CLEAN)
def snk2_existing_only(t):
    return sinks.existing_only(jobs.heatmaps(cleaned(t), TEST), t.listing).select("image_key", "h")


@query("SELECT image_key, count(*) AS n FROM cl GROUP BY image_key", *BOTH, extra=CLEAN)
def snk3_click_counts(t):
    path = scratch(t.spark, "counts")
    sinks.write_click_counts(stats.maps_per_image(cleaned(t)), path)
    return t.spark.read.schema("image_key string, n long").json(path)


@query("""SELECT 'image' AS kind, image_key AS key, CAST(floor(median(size)) AS BIGINT) AS median FROM cl GROUP BY image_key
  UNION ALL SELECT 'category', split_part(image_key, '/', 1), CAST(floor(median(n)) AS BIGINT) FROM (SELECT image_key, count(*) AS n FROM cl GROUP BY image_key) GROUP BY 2
  UNION ALL SELECT 'all', '', CAST(floor(median(n)) AS BIGINT) FROM (SELECT count(*) AS n FROM cl GROUP BY image_key)""", *BOTH, extra=CLEAN)
def snk4_medians(t):
    path, rows = scratch(t.spark, "medians"), cleaned(t)
    sinks.write_medians(stats.medians_image(rows), stats.medians_category(rows), stats.medians_all(rows), path)
    read = lambda kind, key: t.spark.read.schema(f"{key or 'unused'} string, median long").json(f"{path}/{kind}").select(F.lit(kind).alias("kind"), (F.col(key) if key else F.lit("")).alias("key"), "median")
    return read("image", "image_key").unionAll(read("category", "category")).unionAll(read("all", None))


@query("SELECT image_id, kind, score FROM scores", "scores")
def snk5_scores(t):
    path = scratch(t.spark, "scores")
    sinks.write_scores(t.scores, stats.ceiling_floor_summary(t.scores), path)
    return t.spark.read.parquet(f"{path}/scores").select("image_id", "kind", "score")


@query("""SELECT sub_id AS ord, image_path, user_id, n FROM sub WHERE image_key IN (
  SELECT image_key FROM (SELECT image_key, row_number() OVER (PARTITION BY split_part(image_key, '/', 1) ORDER BY min(ord), image_key) AS r FROM sub GROUP BY image_key HAVING count(*) > 20) WHERE r <= 5)""", *BOTH, extra=SUB)
def snk6_sampled_csv(t):
    from attnmaps.functions.paths import image_key
    from attnmaps.sources import readers

    path = scratch(t.spark, "sampled")
    rows = t.subs.withColumn("image_key", image_key(F.col("image_path")))
    sinks.write_sampled(stats.sample_per_class(rows, 20, 5, None), path)
    return readers.read_submissions_csv(t.spark, path).select("ord", "image_path", "user_id", F.size("clicks").cast("long").alias("n"))


@query("SELECT image_key, count(*) AS n FROM sub GROUP BY image_key HAVING count(*) < 155", *BOTH, extra=SUB)
def snk6_missing_json(t):
    from attnmaps.functions.paths import image_key

    path = scratch(t.spark, "missing")
    sinks.write_missing(filters.under_annotated(t.submissions.withColumn("image_key", image_key(F.col("image_path"))), 155), path)
    return t.spark.read.schema("image_key string, n long").json(path)


