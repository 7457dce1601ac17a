"""Queries of rasters, heatmaps and metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attnmaps.functions import clicks as C
from attnmaps.functions import dense, metrics
from attnmaps.operators import raster
from attnmaps.plans import jobs
from attnmaps.plans.base import CLEAN, KERNEL, SIDE, query
from attnmaps.plans.q_filters import BOTH, TEST


def cleaned(t):
    return jobs.clean(t.subs, TEST)


def rasters(t):
    return raster.rasterise(cleaned(t), SIDE, SIDE)


def means(t):
    return jobs.mean_maps(cleaned(t), TEST, SIDE, SIDE)


@query("SELECT image_key, sub_id, y, x, n FROM ra", *BOTH, extra=CLEAN)
def ras1_rasterise(t):
    return rasters(t)


@query("SELECT image_key, sub_id, y, x, CAST(count(*) AS DOUBLE) AS v FROM px WHERE pos = 0 GROUP BY ALL", *BOTH, extra=CLEAN)
def ras2_rasterise_decay(t):
    return raster.rasterise_decay(cleaned(t), SIDE, SIDE)


@query("SELECT image_key, sub_id, y, x, round(sum(exp(-pos / 0.5)), 9) AS v FROM px GROUP BY ALL", *BOTH, extra=CLEAN)
def ras2_rasterise_decay_float(t):
    return raster.rasterise_decay(cleaned(t), SIDE, SIDE, mode="float").withColumn("v", F.round("v", 9))


@query("SELECT image_key, y, x, round(v, 9) AS v FROM mm", *BOTH, extra=CLEAN)
def ras3_mean_map(t):
    return means(t).withColumn("v", F.round("v", 9))


@query("SELECT image_key, sub_id, y, x, n FROM ra JOIN va USING (image_key, sub_id) JOIN vi USING (image_key)", *BOTH, extra=CLEAN)
def ras4_stack_maps(t):
    return raster.keep_valid(rasters(t), TEST.min_clicks, TEST.min_subjects)


@query("SELECT image_key, y, x, CAST(sum(n) AS BIGINT) AS v FROM ra GROUP BY ALL", *BOTH, extra=CLEAN)
def ras5_sum_maps(t):
    return raster.sum_maps(rasters(t))


BINS = """bn AS (SELECT image_key, list_concat(
    [CAST(trunc(m * 0.1) AS INT), CAST(trunc(m * 0.1 + (m + 1 - m * 0.1) / 4) AS INT), CAST(trunc(m * 0.1 + 2 * ((m + 1 - m * 0.1) / 4)) AS INT), CAST(trunc(m * 0.1 + 3 * ((m + 1 - m * 0.1) / 4)) AS INT), m + 1],
    [m + 1, CAST(trunc(m + 1 + (t - m) / 4) AS INT), CAST(trunc(m + 1 + 2 * ((t - m) / 4)) AS INT), CAST(trunc(m + 1 + 3 * ((t - m) / 4)) AS INT), t + 1]) AS bins
  FROM (SELECT image_key, CAST(floor(avg(size)) AS INT) AS m, CAST(max(size) AS INT) AS t FROM cl GROUP BY image_key)),
lv AS (SELECT image_key, unnest(bins) AS cut, unnest(range(10)) AS level FROM bn)"""


@query("SELECT image_key, array_to_string(bins, ',') AS bins FROM bn", *BOTH, extra=f"{CLEAN},\n{BINS}")
def ras6_count_bins(t):
    return raster.image_bins(cleaned(t)).select("image_key", F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"))


@query("""SELECT sub_id, string_agg(CAST(trunc(lo + k * ((size - lo) / 9.0)) AS INT), ',' ORDER BY k) AS bins
  FROM (SELECT sub_id, size, greatest(size // 2 * 0.1, 1.0)::DOUBLE AS lo FROM cl), (SELECT unnest(range(10)) AS k) GROUP BY sub_id""", *BOTH, extra=CLEAN)
def ras7_time_bins(t):
    bins = C.time_bins(F.size("clicks"), TEST.min_clicks, 10)
    return cleaned(t).select("sub_id", F.array_join(bins.cast("array<string>"), ",").alias("bins"))


LEVELS = f"""{CLEAN},
{BINS},
ls AS (SELECT px.image_key, CAST(level AS INT) AS level, sub_id, y, x, count(*) AS n FROM px JOIN lv ON lv.image_key = px.image_key AND lv.cut > px.pos GROUP BY ALL)"""


@query("""SELECT image_key, level, y, x, round(s / maps, 9) AS v FROM (SELECT image_key, level, y, x, sum(n) AS s FROM ls GROUP BY ALL)
  JOIN (SELECT image_key, level, count(DISTINCT sub_id) AS maps FROM ls GROUP BY ALL) USING (image_key, level)""", *BOTH, extra=LEVELS)
def ras8_cumulative_maps(t):
    rows = cleaned(t)
    return raster.cumulative_maps(rows, raster.image_bins(rows), SIDE, SIDE, 1).withColumn("v", F.round("v", 9))


@query("SELECT image_key, CAST(level AS INT) AS level, CAST(sum(least(size, cut)) AS BIGINT) AS clicks FROM cl JOIN lv USING (image_key) GROUP BY ALL", *BOTH, extra=f"{CLEAN},\n{BINS}")
def ras8_bin_counts(t):
    rows = cleaned(t)
    return raster.bin_counts(rows, raster.image_bins(rows))


@query("""SELECT image_key, level, sub_id, CAST(sum(n) AS BIGINT) AS clicks FROM ls
  JOIN (SELECT image_key, level, sub_id FROM (SELECT *, row_number() OVER (PARTITION BY image_key, level ORDER BY sub_id) AS r, min(c) OVER (PARTITION BY image_key) AS m
    FROM (SELECT image_key, level, sub_id, count(*) OVER (PARTITION BY image_key, level) AS c FROM (SELECT DISTINCT image_key, level, sub_id FROM ls))) WHERE m >= 2 AND r <= m)
  USING (image_key, level, sub_id) GROUP BY ALL""", *BOTH, extra=LEVELS)
def ras9_align_levels(t):
    rows = cleaned(t)
    stack = raster.cumulative_maps(rows, raster.image_bins(rows), SIDE, SIDE, 1, average=False)
    return raster.align_levels(stack).groupBy("image_key", "level", "sub_id").agg(F.sum("v").alias("clicks"))


SIZES = "(SELECT DISTINCT CAST(2 * (l_linenumber % 7) + 3 AS INT) AS size FROM lineitem)"
DISK = f"""dk AS (SELECT size, CAST(y - c AS INT) AS dy, CAST(x - c AS INT) AS dx, 1.0::DOUBLE / count(*) OVER (PARTITION BY size) AS weight
  FROM (SELECT size, (size - 1) / 2 AS c, unnest(range(size)) AS y FROM {SIZES}), range(15) r(x) WHERE x < size AND (x - c) * (x - c) + (y - c) * (y - c) <= c * c)"""


@query("SELECT size, dy, dx, round(weight, 9) AS weight FROM dk", extra=DISK)
def ras10_disk_kernel(t):
    sizes = t.lineitem.select((2 * (F.col("l_linenumber") % 7) + 3).cast("int").alias("size")).distinct()
    return raster.disk_offsets(sizes).withColumn("weight", F.round("weight", 9))


BLUR = f"""{CLEAN},
{DISK},
b1 AS (SELECT image_key, y + dy AS y, x + dx AS x, sum(v * weight) AS v FROM mm, dk WHERE size = {KERNEL} AND y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1} GROUP BY ALL),
b2 AS (SELECT image_key, y + dy AS y, x + dx AS x, sum(v * weight) AS v FROM b1, dk WHERE size = {KERNEL} AND y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1} GROUP BY ALL)"""


@query("SELECT image_key, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS v FROM b2", *BOTH, extra=BLUR)
def ras11_blur_sparse(t):
    return raster.blur_sparse(means(t), KERNEL, SIDE, SIDE).withColumn("v", F.round("v", 6))


@query("SELECT image_key, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 5) AS v FROM b2 WHERE v > 1e-4", *BOTH, extra=BLUR)
def ras11_blur_dense(t):
    """Single-precision heatmaps, hence fewer places."""
    maps = raster.to_sparse(jobs.heatmaps(cleaned(t), TEST))
    return maps.where("v > 1e-4").select("image_key", "y", "x", F.round("v", 5).alias("v"))


@query("SELECT image_key, CAST(CASE WHEN width IS NULL THEN 5 WHEN r % 2 = 0 THEN r + 1 ELSE r END AS INT) AS size, true AS mass FROM (SELECT i.image_key, width, CAST(round_even(5.0 * least(width, height) / 32, 0) AS INT) AS r FROM images i LEFT JOIN dims USING (image_key)) WHERE image_key IN (SELECT image_key FROM mm)", *BOTH, "images", "dims", extra=CLEAN)
def ras12_blur_adaptive(t):
    """Every image's kernel size, and whether its blurred map keeps no more than its mass."""
    maps = means(t).withColumns({"h": F.lit(SIDE), "w": F.lit(SIDE)})
    blurred = raster.blur_adaptive(maps, t.dims, KERNEL, (SIDE, SIDE))
    mass = F.aggregate("data", F.lit(0.0), lambda a, v: a + v.cast("double"))
    before = maps.groupBy("image_key").agg(F.sum("v").alias("s"))
    sizes = t.images.join(t.dims, "image_key", "left").select("image_key", C.kernel_size(KERNEL, "width", "height", (SIDE, SIDE)).alias("size"))
    return blurred.join(before, "image_key").join(sizes, "image_key").select("image_key", "size", ((mass > 0) & (mass <= F.col("s") * 1.001)).alias("mass"))


@query("SELECT image_key, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(v, 9) AS v FROM mm JOIN (SELECT ty, CAST(floor((ty + 4 + 0.5) * 32 / 40) AS INT) AS y FROM range(32) r(ty)) a USING (y) JOIN (SELECT tx, CAST(floor((tx + 4 + 0.5) * 32 / 40) AS INT) AS x FROM range(32) r(tx)) b USING (x)", *BOTH, extra=CLEAN)
def ras13_resize_center_crop(t):
    return raster.resize_center_crop(means(t), SIDE, SIDE, 40, 32).withColumn("v", F.round("v", 9))


@query("""SELECT image_key, CAST(ty + 8 AS INT) AS y, CAST(tx + 8 AS INT) AS x, round(s / 4, 9) AS v FROM (SELECT image_key, y // 2 AS ty, x // 2 AS tx, sum(v) AS s FROM mm GROUP BY ALL)""", *BOTH, extra=CLEAN)
def ras14_sparse_scale(t):
    return raster.sparse_scale(means(t), 2.0, SIDE, SIDE).withColumn("v", F.round("v", 9))


def _dense(t, helper):
    """Sparse rows of each image's dense mean map after a helper."""
    maps = means(t).withColumns({"h": F.lit(SIDE), "w": F.lit(SIDE)})
    return raster.to_sparse(raster.dense_by_image(maps, lambda m, row: helper(m), raster.HEATMAP, [])).select("image_key", "y", "x", "v")


@query(f"""SELECT image_key, CAST(ty + 5 AS INT) AS y, CAST(tx + 5 AS INT) AS x, round(v, 5) AS v FROM mm
  JOIN (SELECT ty, CAST(floor((ty + 0.5) * {SIDE} / 21) AS INT) AS y FROM range(21) r(ty)) a USING (y) JOIN (SELECT tx, CAST(floor((tx + 0.5) * {SIDE} / 21) AS INT) AS x FROM range(21) r(tx)) b USING (x)""", *BOTH, extra=CLEAN)
def ras15_nearest_scale(t):
    return _dense(t, lambda m: dense.nearest_scale(m, 1.5)).withColumn("v", F.round("v", 5))


@query(f"SELECT image_key, y, CAST(x + 4 AS INT) AS x, round(v, 5) AS v FROM mm WHERE x + 4 < {SIDE}", *BOTH, extra=CLEAN)
def ras16_reproject(t):
    """Every map as seen by a camera that stands two units to the side."""
    k = [[20.0, 0, 16], [0, 20, 16], [0, 0, 1]]
    source, target = np.eye(4), np.eye(4)
    target[0, 3] = 2.0
    depth = np.full((SIDE, SIDE), 10.0)
    return _dense(t, lambda m: dense.reproject(m, depth, depth, source, target, k, k)).withColumn("v", F.round("v", 5))


@query("""SELECT image_key, unnest(kept) AS sub_id FROM gd WHERE i = last""", *BOTH, extra=f"""{CLEAN},
nq AS (SELECT cl.image_key, sub_id, row_number() OVER (PARTITION BY cl.image_key ORDER BY ord, sub_id) AS i, count(*) OVER (PARTITION BY cl.image_key) AS last, coalesce(q, 0) AS q
  FROM cl LEFT JOIN (SELECT image_key, sub_id, sum(n * n) AS q FROM ra GROUP BY ALL) USING (image_key, sub_id)),
do_ AS (SELECT l.image_key, l.sub_id AS a, r.sub_id AS b, sum(l.n * r.n) AS dot FROM ra l JOIN ra r ON l.image_key = r.image_key AND l.y = r.y AND l.x = r.x AND l.sub_id <> r.sub_id GROUP BY ALL),
ne AS (SELECT l.image_key, r.i, r.sub_id, list(l.sub_id) FILTER (l.i < r.i AND l.q + r.q - 2 * coalesce(dot, 0) < 2.25) AS near, any_value(r.last) AS last
  FROM nq r JOIN nq l USING (image_key) LEFT JOIN do_ ON do_.image_key = r.image_key AND do_.a = l.sub_id AND do_.b = r.sub_id GROUP BY ALL),
gd AS (SELECT image_key, i, last, [sub_id] AS kept FROM ne WHERE i = 1
  UNION ALL SELECT ne.image_key, ne.i, ne.last, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, ne.sub_id) END FROM gd JOIN ne ON ne.image_key = gd.image_key AND ne.i = gd.i + 1)""", recursive=True)
def ras17_near_duplicate_maps(t):
    return raster.near_duplicate_maps(cleaned(t), 1.5, SIDE, SIDE)


@query("""SELECT image_key, a, b, qa + qb - 2 * coalesce(dot, 0) AS d2 FROM (
  SELECT l.image_key, l.sub_id AS a, r.sub_id AS b, l.q AS qa, r.q AS qb FROM (SELECT image_key, sub_id, CAST(sum(n * n) AS BIGINT) AS q FROM ra GROUP BY ALL) l
  JOIN (SELECT image_key, sub_id, CAST(sum(n * n) AS BIGINT) AS q FROM ra GROUP BY ALL) r ON l.image_key = r.image_key AND l.sub_id < r.sub_id)
  LEFT JOIN (SELECT l.image_key, l.sub_id AS a, r.sub_id AS b, CAST(sum(l.n * r.n) AS BIGINT) AS dot FROM ra l JOIN ra r ON l.image_key = r.image_key AND l.y = r.y AND l.x = r.x AND l.sub_id < r.sub_id GROUP BY ALL) USING (image_key, a, b)""", *BOTH, extra=CLEAN)
def ras17_pair_distances(t):
    return raster.pair_distances(rasters(t))


# --- metrics ---------------------------------------------------------------------------


def halves(t):
    """(image_key, a, b): dense mean maps of even and odd submissions of each image, from pixels summed by Spark."""
    rows = raster.counted_cells(cleaned(t), SIDE, SIDE).withColumn("odd", F.col("sub_id") % 2 == 1)
    counts = rows.groupBy("image_key").agg(F.count_if(~F.col("odd")).alias("ca"), F.count_if("odd").alias("cb"))
    part = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(name)
    sums = rows.select("image_key", "odd", F.inline("cells")).groupBy("image_key", "cell").agg(part(~F.col("odd"), "sa"), part(F.col("odd"), "sb"))
    px = sums.groupBy("image_key").agg(F.collect_list("cell").alias("cells"), F.collect_list("sa").alias("sa"), F.collect_list("sb").alias("sb"))  # a row a pixel

    def run(frames):
        def dense_of(cells, values, n):
            out = np.zeros(SIDE * SIDE)
            if cells is not None:
                out[np.asarray(cells, dtype=int)] = values
            return out / max(1, n)

        for pdf in frames:
            own = {name: [dense_of(*x) for x in zip(pdf["cells"], pdf[f"s{name}"], pdf[f"c{name}"], strict=True)] for name in "ab"}
            yield pd.DataFrame({"image_key": pdf["image_key"], **own})

    return counts.join(px, "image_key", "left").mapInPandas(run, "image_key string, a array<double>, b array<double>")


def scored(t, name):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = (SIDE, SIDE)
        pairs = zip(pdf["a"], pdf["b"], strict=True)
        return pd.DataFrame({"image_key": pdf["image_key"], "score": [metrics.score(name, np.asarray(a).reshape(side), np.asarray(b).reshape(side)) for a, b in pairs]})

    out = halves(t).groupBy("image_key").applyInPandas(run, "image_key string, score double")
    return out.withColumn("score", F.round(F.nanvl("score", F.lit(None).cast("double")), 6))


HALVES = f"""{CLEAN},
hc AS (SELECT image_key, count(*) FILTER (sub_id % 2 = 0) AS ca, count(*) FILTER (sub_id % 2 = 1) AS cb FROM cl GROUP BY image_key),
hs AS (SELECT image_key, y, x, sum(n) FILTER (sub_id % 2 = 0) AS sa, sum(n) FILTER (sub_id % 2 = 1) AS sb FROM ra GROUP BY ALL),
ha AS (SELECT hc.image_key, g.y * {SIDE} + g.x AS i, coalesce(sa, 0) / greatest(ca, 1) AS a, coalesce(sb, 0) / greatest(cb, 1) AS b
  FROM hc CROSS JOIN (SELECT y, x FROM range({SIDE}) r(y), range({SIDE}) s(x)) g LEFT JOIN hs ON hs.image_key = hc.image_key AND hs.y = g.y AND hs.x = g.x),
hr AS (SELECT *, rank() OVER (PARTITION BY image_key ORDER BY a) + (count(*) OVER (PARTITION BY image_key, a) - 1) / 2 AS ra_,
    rank() OVER (PARTITION BY image_key ORDER BY b) + (count(*) OVER (PARTITION BY image_key, b) - 1) / 2 AS rb_,
    row_number() OVER (PARTITION BY image_key ORDER BY a, i) - 1 AS place FROM ha)"""


@query("SELECT image_key, round(coalesce(count(*) FILTER (a > 0 AND b > 0) / nullif(count(*) FILTER (a > 0 OR b > 0), 0), 0), 6) AS score FROM ha GROUP BY image_key", *BOTH, extra=HALVES)
def met1_iou_binary(t):
    return scored(t, lambda a, b: metrics.iou_binary(a > 0, b > 0))


@query("""SELECT image_key, round(sum((v + w) / 2 * 0.05), 6) AS score FROM (
  SELECT image_key, k, v, lead(v) OVER (PARTITION BY image_key ORDER BY k) AS w FROM (
    SELECT image_key, k, coalesce(count(*) FILTER (a > k * 0.05 AND b > k * 0.05) / nullif(count(*) FILTER (a > k * 0.05 OR b > k * 0.05), 0), 0) AS v
    FROM (SELECT image_key, (a - min(a) OVER q) / (max(a) OVER q - min(a) OVER q + 1e-8) AS a, (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q + 1e-8) AS b FROM ha WINDOW q AS (PARTITION BY image_key)),
      range(1, 20) r(k) GROUP BY image_key, k)) WHERE w IS NOT NULL GROUP BY image_key""", *BOTH, extra=HALVES)
def met2_auc(t):
    return scored(t, "auc")


@query("""SELECT image_key, round(sum((v + w) / 2 * 0.05), 6) AS score FROM (
  SELECT image_key, k, v, lead(v) OVER (PARTITION BY image_key ORDER BY k) AS w FROM (
    SELECT image_key, k, coalesce(sum(hits / nullif(every, 0) * cum / taken), 0) AS v FROM (
      SELECT image_key, k, hits, sum(hits) OVER (PARTITION BY image_key, k) AS every, sum(hits) OVER (PARTITION BY image_key, k ORDER BY a DESC) AS cum, sum(n) OVER (PARTITION BY image_key, k ORDER BY a DESC) AS taken
      FROM (SELECT image_key, k, a, count(*) FILTER (b > k * 0.05) AS hits, count(*) AS n
        FROM (SELECT image_key, a, (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q + 1e-8) AS b FROM ha WINDOW q AS (PARTITION BY image_key)), range(1, 20) r(k) GROUP BY ALL))
    GROUP BY image_key, k)) WHERE w IS NOT NULL GROUP BY image_key""", *BOTH, extra=HALVES)
def met3_average_precision(t):
    return scored(t, "map")


@query(f"SELECT image_key, round(coalesce(avg(place / {SIDE * SIDE - 1}) FILTER (b > 0), 0), 6) AS score FROM hr GROUP BY image_key", *BOTH, extra=HALVES)
def met4_rankorder(t):
    return scored(t, "rankorder")


@query("SELECT image_key, round(corr(ra_, rb_), 6) AS score FROM hr GROUP BY image_key", *BOTH, extra=HALVES)
def met5_spearman(t):
    return scored(t, "spearman")


@query("SELECT image_key, CASE WHEN var_pop(ra_) FILTER (b <> 0) > 0 AND var_pop(rb_) FILTER (b <> 0) > 0 THEN round(corr(ra_, rb_) FILTER (b <> 0), 6) END AS score FROM hr GROUP BY image_key", *BOTH, extra=HALVES)
def met6_rank_pearson(t):
    return scored(t, "rank_pearson")


@query("SELECT image_key, round(1 - sum(ra_ * rb_) FILTER (b <> 0) / sqrt(sum(ra_ * ra_) FILTER (b <> 0) * sum(rb_ * rb_) FILTER (b <> 0)), 6) AS score FROM hr GROUP BY image_key", *BOTH, extra=HALVES)
def met7_rank_cosine(t):
    return scored(t, "rank_cosine")


def _sinkhorn(rounds=10):
    """The tables of the transport plan's factors u and v after so many rounds; the kernel acts on rows and columns in turn."""
    both = lambda name, of, k1="k", k2="k": (
        f"{name}x AS (SELECT image_key, y, i AS x, sum(v * {k1}) AS v FROM {of} JOIN kr ON j = x GROUP BY ALL),\n"
        f"{name} AS (SELECT image_key, i AS y, x, sum(v * {k2}) AS v FROM {name}x JOIN kr ON j = y GROUP BY ALL)"
    )
    tables, last = [], "v0"
    for r in range(rounds):
        for name, mass, of in (("u", "a", last), ("v", "b", f"u{r + 1}")):
            tables.append(both(f"m{name}{r}", of))
            tables.append(f"{name}{r + 1} AS MATERIALIZED (SELECT image_key, y, x, {mass} / m.v AS v FROM ms JOIN m{name}{r} m USING (image_key, y, x))")
        last = f"v{r + 1}"
    return ",\n".join([*tables, both("cx", last, "k * c", "k"), both("cy", last, "k", "k * c")])


TRANSPORT = f"""{HALVES},
kr AS MATERIALIZED (SELECT i, j, power((i - j) / {SIDE - 1}.0, 2) AS c, exp(-power((i - j) / {SIDE - 1}.0, 2) / 0.2) AS k FROM range({SIDE}) r(i), range({SIDE}) s(j)),
mz AS (SELECT image_key, i // {SIDE} AS y, i % {SIDE} AS x, greatest((a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8), 0) + 1e-12 AS a, greatest((b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-8), 0) + 1e-12 AS b FROM ha WINDOW w AS (PARTITION BY image_key)),
ms AS MATERIALIZED (SELECT image_key, y, x, a / sum(a) OVER w AS a, b / sum(b) OVER w AS b FROM mz WINDOW w AS (PARTITION BY image_key)),
v0 AS MATERIALIZED (SELECT image_key, y, x, 1.0::DOUBLE AS v FROM ms),
{_sinkhorn()}"""


@query("SELECT image_key, round(sum(u10.v * (cx.v + cy.v)), 6) AS score FROM u10 JOIN cx USING (image_key, y, x) JOIN cy USING (image_key, y, x) GROUP BY image_key", *BOTH, extra=TRANSPORT)
def met8_emd(t):
    return scored(t, "emd")


@query("""SELECT image_key, round(-sum(p * ln(q)), 6) AS score FROM (
  SELECT image_key, (b + 1e-12) / sum(b + 1e-12) OVER w AS p, (a + 1e-12) / sum(a + 1e-12) OVER w AS q FROM ha WINDOW w AS (PARTITION BY image_key)) GROUP BY image_key""", *BOTH, extra=HALVES)
def met9_crossentropy(t):
    return scored(t, "crossentropy")


@query(f"""SELECT image_key, CASE WHEN var_pop(u) > 0 AND var_pop(w) > 0 THEN round(corr(u, w), 6) END AS score FROM (
  SELECT l.image_key, l.y, r.y AS z, sum(l.a * r.a) AS u, sum(l.b * r.b) AS w FROM rn l JOIN rn r ON l.image_key = r.image_key AND l.x = r.x AND l.y < r.y GROUP BY ALL) GROUP BY image_key""", *BOTH, extra=f"""{HALVES},
rm AS (SELECT image_key, i // {SIDE} AS y, i % {SIDE} AS x, a - avg(a) OVER q AS a, b - avg(b) OVER q AS b FROM ha WINDOW q AS (PARTITION BY image_key, i // {SIDE})),
rn AS (SELECT image_key, y, x, coalesce(a / nullif(sqrt(sum(a * a) OVER q), 0), 0) AS a, coalesce(b / nullif(sqrt(sum(b * b) OVER q), 0), 0) AS b FROM rm WINDOW q AS (PARTITION BY image_key, y))""")
def met9_rsa(t):
    return scored(t, "rsa")


