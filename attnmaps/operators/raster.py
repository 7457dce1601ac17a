"""Click rasters and heatmaps as sparse rows, and dense steps by image.

A sparse raster has a row for each pixel that was clicked. Rasters are never shuffled
dense; the dense form exists for one image at a time, inside a helper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.functions.clicks import count_bins, kernel_size
from attnmaps.functions.dense import blur, disk_runs
from attnmaps.sources.shared import settled

MAX_COUNT = 255


def pixels(subs: DataFrame, h: int | Column, w: int | Column, keys: tuple[str, ...] = ("image_key", "sub_id")) -> DataFrame:
    """(keys, pos, x, y) of all clicks within bounds; pos counts from 0."""
    rows = subs.select(*keys, F.posexplode("clicks").alias("pos", "c"), *[x.alias(n) for n, x in (("_h", F.lit(h) if isinstance(h, int) else h), ("_w", F.lit(w) if isinstance(w, int) else w))])
    inside = (F.col("c.x") >= 0) & (F.col("c.x") < F.col("_w")) & (F.col("c.y") >= 0) & (F.col("c.y") < F.col("_h"))
    return rows.where(inside).select(*keys, "pos", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


def rasterise(subs: DataFrame, h: int | Column, w: int | Column) -> DataFrame:
    """(image_key, sub_id, y, x, n): clicks by pixel of each submission, at most 255."""
    return pixels(subs, h, w).groupBy("image_key", "sub_id", "y", "x").agg(F.least(F.count(F.lit(1)), F.lit(MAX_COUNT)).alias("n"))


def rasterise_decay(subs: DataFrame, h: int, w: int, tau: float = 0.5, mode: str = "as_written") -> DataFrame:
    """Clicks weighted by order: exp(-pos / tau), truncated to whole numbers "as_written"."""
    weight = F.least(F.exp(-F.col("pos") / tau), F.lit(1.0))
    if mode == "as_written":
        weight = weight.cast("int").cast("double")
    elif mode != "float":
        raise ValueError(f"mode is as_written or float, not {mode}")
    return pixels(subs, h, w).groupBy("image_key", "sub_id", "y", "x").agg(F.sum(weight).alias("v")).where("v > 0")


def counted_cells(subs: DataFrame, h: int | Column, w: int | Column) -> DataFrame:
    """(image_key, sub_id, cells, clicks): each submission's cells y * w + x with their n, and the sum of n.

    A submission's row is all that is needed. Counts end at 255, so only longer lists are
    counted cell by cell; in others a cell may stand several times.
    """
    wide, high = (F.lit(n) if isinstance(n, int) else n for n in (w, h))
    inside = lambda c: c["x"].between(F.lit(0), wide - 1) & c["y"].between(F.lit(0), high - 1)
    cells = F.transform(F.filter("clicks", inside), lambda c: (c["y"] * wide + c["x"]).cast("int"))
    pair = lambda c, n: F.struct(c.alias("cell"), n.cast("int").alias("n"))
    rows = subs.select("image_key", "sub_id", cells.alias("_cells"))
    once = F.transform("_cells", lambda c: pair(c, F.lit(1)))
    capped = F.transform(F.array_distinct("_cells"), lambda c: pair(c, F.least(F.lit(MAX_COUNT), F.size(F.filter("_cells", lambda d: d == c)))))
    rows = rows.select("image_key", "sub_id", F.when(F.size("_cells") <= MAX_COUNT, once).otherwise(capped).alias("cells"))
    return rows.withColumn("clicks", F.aggregate("cells", F.lit(0), lambda a, x: a + x["n"]))


def valid_maps(rasters: DataFrame, min_clicks: int) -> DataFrame:
    """(image_key, sub_id): submissions with at least so many clicks within bounds."""
    return rasters.groupBy("image_key", "sub_id").agg(F.sum("n").alias("clicks")).where(F.col("clicks") >= min_clicks).select("image_key", "sub_id")


def _first_of(*keys: str) -> Column:
    """1 on one row of each group of the keys, 0 on its others."""
    return F.when(F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")) == 1, 1).otherwise(0)


def keep_valid(rasters: DataFrame, min_clicks: int, min_subjects: int = 0) -> DataFrame:
    """Raster rows of valid submissions, of images with enough of them."""
    own = Window.partitionBy("image_key", "sub_id")
    rows = rasters.withColumn("_s", F.sum("n").over(own)).where(F.col("_s") >= min_clicks).drop("_s")
    if min_subjects:
        counts = rows.select("image_key", "sub_id").distinct().groupBy("image_key").agg(F.count(F.lit(1)).alias("_m"))
        rows = rows.join(counts.where(F.col("_m") >= min_subjects).select("image_key"), "image_key", "left_semi")
    return rows


def mean_map(rasters: DataFrame, keys: tuple[str, ...] = ("image_key",)) -> DataFrame:
    """(keys, y, x, v): mean over the submissions that have rows.

    The number of submissions rides along with the sums, so that the rasters are made once.
    """
    marked = rasters.withColumn("_m", _first_of(*keys, "sub_id"))
    sums = marked.groupBy(*keys, "y", "x").agg(F.sum("n").alias("v"), F.sum("_m").alias("_m"))
    maps = F.sum("_m").over(Window.partitionBy(*keys))
    return sums.withColumn("_m", maps).select(*keys, "y", "x", (F.col("v") / F.col("_m")).alias("v"))


def sum_maps(rasters: DataFrame) -> DataFrame:
    return rasters.groupBy("image_key", "y", "x").agg(F.sum("n").alias("v"))


def image_bins(subs: DataFrame, t: int = 10) -> DataFrame:
    """(image_key, bins): cut points of each image from its submissions' click counts."""
    sizes = subs.groupBy("image_key").agg(F.avg(F.size("clicks")).alias("mean"), F.max(F.size("clicks")).alias("most"))
    return sizes.select("image_key", count_bins(F.col("mean"), F.col("most"), t).alias("bins"))


def cumulative_maps(subs: DataFrame, bins: DataFrame, h: int, w: int, min_clicks: int, average: bool = True) -> DataFrame:
    """Rasters of click prefixes: (image_key, level, [sub_id,] y, x, v).

    A click at place p belongs to all levels whose cut point is over p, so one pass over
    the clicks makes all levels. Submissions with too few clicks at a level have no part
    in it.
    """
    rows = pixels(subs, h, w).join(bins, "image_key")
    levels = F.filter(F.transform(F.col("bins"), lambda b, i: F.when(b > F.col("pos"), i)), lambda i: i.isNotNull())
    at = rows.select("image_key", "sub_id", "y", "x", F.explode(levels).alias("level"))
    stack = at.groupBy("image_key", "level", "sub_id", "y", "x").agg(F.least(F.count(F.lit(1)), F.lit(MAX_COUNT)).alias("n"))
    own = Window.partitionBy("image_key", "level", "sub_id")
    stack = stack.withColumn("_s", F.sum("n").over(own)).where(F.col("_s") >= min_clicks).drop("_s")
    if not average:
        return stack.withColumnRenamed("n", "v")
    return mean_map(stack, ("image_key", "level"))


def bin_counts(subs: DataFrame, bins: DataFrame) -> DataFrame:
    """(image_key, level, clicks): clicks of all prefixes at each cut point."""
    rows = subs.select("image_key", F.size("clicks").alias("n")).join(bins, "image_key").select("image_key", "n", F.posexplode("bins").alias("level", "cut"))
    return rows.groupBy("image_key", "level").agg(F.sum(F.least("n", "cut")).alias("clicks"))


def align_levels(stack: DataFrame) -> DataFrame:
    """Every level's stack cut to the least number of maps of any level of the image.

    Images whose least level has fewer than two maps go.
    """
    maps = stack.select("image_key", "level", "sub_id").distinct()
    counts = maps.groupBy("image_key", "level").agg(F.count(F.lit(1)).alias("c")).groupBy("image_key").agg(F.min("c").alias("least"))
    rank = F.row_number().over(Window.partitionBy("image_key", "level").orderBy("sub_id"))
    kept = maps.withColumn("rank", rank).join(counts, "image_key").where("least >= 2 and rank <= least")
    return stack.join(kept.select("image_key", "level", "sub_id"), ["image_key", "level", "sub_id"], "left_semi")


def disk_offsets(sizes: DataFrame) -> DataFrame:
    """(size, dy, dx, weight): the disk kernel of each odd size in the column ``size``."""
    span = F.sequence(F.lit(0), F.col("size") - 1)
    c = (F.col("size") - 1) / 2
    cells = sizes.select("size", F.explode(span).alias("ky")).select("size", "ky", F.explode(span).alias("kx"))
    disk = cells.where((F.col("kx") - c) * (F.col("kx") - c) + (F.col("ky") - c) * (F.col("ky") - c) <= c * c)
    counts = disk.groupBy("size").agg(F.count(F.lit(1)).alias("cells"))
    return disk.join(counts, "size").select("size", (F.col("ky") - c).cast("int").alias("dy"), (F.col("kx") - c).cast("int").alias("dx"), (1.0 / F.col("cells")).alias("weight"))


def blur_sparse(maps: DataFrame, size: int, h: int, w: int) -> DataFrame:
    """Two passes of the disk kernel on sparse rows, cut at the edges.

    A row of the disk is a run, so a pixel adds two steps to a row of the target, up where the
    run begins and down behind its end, and a running sum along the row gives the values: a
    pixel costs twice the disk's size, not its area. Cells in no run have no row.
    """
    runs = disk_runs(size)
    weight = 1.0 / sum(2 * half + 1 for _, half in runs)
    along = Window.partitionBy("image_key", "y").orderBy("x")  # at most w + 1 rows
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(2):
        spans = F.array(*[F.struct((F.col("y") + dy).alias("y"), F.greatest(F.col("x") - half, F.lit(0)).alias("x"), F.least(F.col("x") + half + 1, F.lit(w)).alias("end")) for dy, half in runs])
        moved = maps.select("image_key", "v", F.inline(spans)).where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") < F.col("end")))
        turns = F.array(F.struct(F.col("x").alias("x"), F.col("v").alias("v"), F.lit(1).alias("on")), F.struct(F.col("end").alias("x"), (-F.col("v")).alias("v"), F.lit(-1).alias("on")))
        steps = moved.select("image_key", "y", F.inline(turns)).groupBy("image_key", "y", "x").agg(F.sum("v").alias("v"), F.sum("on").alias("on"))
        levels = steps.select("image_key", "y", "x", F.lead("x").over(along).alias("end"), F.sum("v").over(so_far).alias("v"), F.sum("on").over(so_far).alias("on"))
        maps = levels.where("on > 0").select("image_key", "y", F.explode(F.sequence("x", F.col("end") - 1)).alias("x"), (F.col("v") * weight).alias("v"))
    return maps


def dense_by_image(maps: DataFrame, helper: Callable[[np.ndarray, dict], np.ndarray], schema: str, extra: list[str]) -> DataFrame:
    """Apply a numpy helper to every image's dense map; ``extra`` holds per-image columns.

    ``maps`` has rows (image_key, y, x, v, h, w), maybe a level, and the extra columns.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "px"]
            px = batch.column("px")
            y, x, v = (px.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
            starts = px.offsets.to_numpy()
            for i, row in enumerate(batch.select(names).to_pylist()):
                own = slice(starts[i], starts[i + 1])
                dense = np.zeros((row["h"], row["w"]))
                dense[y[own], x[own]] = v[own]
                out = helper(dense, row)
                values = pa.array(out.ravel().astype(np.float32))
                columns = [pa.array([row["image_key"]]), pa.array([row["level"]], pa.int32()), pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
                yield pa.RecordBatch.from_arrays(columns, names=["image_key", "level", "h", "w", "data"])

    level = F.col("level") if "level" in maps.columns else F.lit(0)
    rows = maps.withColumn("level", level.cast("int"))
    one = [F.first(c).alias(c) for c in dict.fromkeys(["h", "w", *extra])]
    images = rows.groupBy("image_key", "level").agg(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))).alias("px"), *one)  # h * w pixels at most
    return images.mapInArrow(run, schema)


HEATMAP = "image_key string, level int, h int, w int, data array<float>"


def blur_dense(maps: DataFrame, size: int | None = None, size_col: str = "size") -> DataFrame:
    """Heatmaps (image_key, level, h, w, data) blurred twice, by one size or each image's own."""
    if size is not None:
        maps = maps.withColumn(size_col, F.lit(size))
    return dense_by_image(maps, lambda m, row: blur(m, int(row[size_col])), HEATMAP, [size_col])


def blur_adaptive(maps: DataFrame, dims: DataFrame, blur_size: int, image_shape: tuple[int, int]) -> DataFrame:
    """Blur every image by its own kernel size; dims has (image_key, width, height)."""
    sized = maps.join(dims.select("image_key", "width", "height"), "image_key", "left")
    return blur_dense(sized.withColumn("size", kernel_size(blur_size, "width", "height", image_shape)))


def to_sparse(heatmaps: DataFrame) -> DataFrame:
    """(image_key, level, y, x, v) of the pixels that aren't zero."""
    rows = heatmaps.select("image_key", "level", "w", F.posexplode("data").alias("i", "v")).where("v <> 0")
    return rows.select("image_key", "level", F.expr("cast(i div w as int)").alias("y"), (F.col("i") % F.col("w")).alias("x"), F.col("v").cast("double").alias("v"))


def resize_center_crop(maps: DataFrame, h: int, w: int, short_side: int, crop: int) -> DataFrame:
    """Nearest-exact resize to a short side, then the centre crop, on sparse rows.

    Every target pixel takes the source pixel that its centre falls on; a source pixel
    may fill several target pixels or none.
    """
    scale = short_side / min(h, w)
    nh, nw = (short_side if n == min(h, w) else int(n * scale) for n in (h, w))
    top, left = (round_half_even((n - crop) / 2) for n in (nh, nw))
    spark = maps.sparkSession
    axis = lambda n, size, start, name: F.broadcast(  # noqa: E731  at most crop rows
        spark.range(max(0, -start), min(crop, size - start)).select(F.col("id").cast("int").alias(f"t{name}"), F.floor((F.col("id") + start + 0.5) * n / size).cast("int").alias(name))
    )
    out = maps.join(axis(h, nh, top, "y"), "y").join(axis(w, nw, left, "x"), "x")
    return out.select("image_key", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def round_half_even(x: float) -> int:
    return int(np.rint(x))


def sparse_scale(maps: DataFrame, scale: float, h: int, w: int, pad: bool = True) -> DataFrame:
    """Mean of the source pixels of each target cell, centred on the old canvas.

    Pixels without a row count as zeros of their cell.
    """
    th, tw = int(h / scale), int(w / scale)
    cell = lambda c, n: F.least(F.floor(F.col(c) / scale).cast("int"), F.lit(n - 1))
    spark = maps.sparkSession
    size = lambda n, c, t: spark.range(n).select(F.col("id").cast("int").alias(c)).groupBy(cell(c, t).alias(f"t{c}")).agg(F.count(F.lit(1)).alias(f"n{c}"))
    sums = maps.groupBy("image_key", cell("y", th).alias("ty"), cell("x", tw).alias("tx")).agg(F.sum("v").alias("s"))
    rows = sums.join(F.broadcast(size(h, "y", th)), "ty").join(F.broadcast(size(w, "x", tw)), "tx")
    top, left = ((h - th) // 2, (w - tw) // 2) if pad else (0, 0)
    moved = rows.select("image_key", (F.col("ty") + top).alias("y"), (F.col("tx") + left).alias("x"), (F.col("s") / (F.col("ny") * F.col("nx"))).alias("v"))
    return moved.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)) if pad else moved


def pair_distances(rasters: DataFrame) -> DataFrame:
    """(image_key, a, b, d2): squared L2 distances of the maps of an image, a before b.

    By |p|^2 + |q|^2 - 2 pq over shared pixels; for the submissions of one image only.
    """
    norms = rasters.groupBy("image_key", "sub_id").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    a, b = (norms.select("image_key", F.col("sub_id").alias(x), F.col("q").alias(f"q{x}")) for x in "ab")
    pairs = a.join(b, "image_key").where("a < b")
    left, right = (rasters.select("image_key", "y", "x", F.col("sub_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    dots = left.join(right, ["image_key", "y", "x"]).where("a < b").groupBy("image_key", "a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    joined = pairs.join(dots, ["image_key", "a", "b"], "left")
    return joined.select("image_key", "a", "b", (F.col("qa") + F.col("qb") - 2 * F.coalesce("dot", F.lit(0))).alias("d2"))


#: Squared thresholds up to which maps are looked up by two pixels at once.
TWO_PIXELS = 64.0


def distinct_maps(subs: DataFrame, h: int, w: int) -> DataFrame:
    """(image_key, at, px, q): every different map of an image, its first place (ord, sub_id) and its squared norm.

    ``px`` is the sorted array of (cell, n), n at most 255; clicks out of bounds don't count.
    """
    inside = lambda c: c["x"].between(0, w - 1) & c["y"].between(0, h - 1)
    rows = subs.select("image_key", F.struct("ord", "sub_id").alias("at"), F.explode_outer(F.filter("clicks", inside)).alias("c")).repartition("image_key", "at")
    counts = rows.groupBy("image_key", "at", (F.col("c.y") * w + F.col("c.x")).alias("cell")).agg(F.least(F.count(F.lit(1)), F.lit(MAX_COUNT)).cast("int").alias("n"))
    maps = counts.groupBy("image_key", "at").agg(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n")))).alias("px"))
    first = maps.groupBy("image_key", "px").agg(F.min("at").alias("at"))
    return first.select("image_key", "at", "px", F.aggregate("px", F.lit(0).cast("long"), lambda a, p: a + p["n"] * p["n"]).alias("q"))


def near_maps(maps: DataFrame, thresh: float) -> DataFrame:
    """(image_key, a, b): the different maps of an image that share pixels and lie under thresh from each other, a before b.

    If two maps share no pixel of one's rarest ones, these alone make up their distance. So a map
    needs a look-up only by its rarest pixels, as many as have a squared norm of thresh squared. For
    small thresholds it has one more such pixel and is looked up by two of them at a time; maps
    too light for that are looked up by all pairs of theirs, and among themselves by single pixels.
    """
    limit = float(thresh) ** 2
    pairs = limit <= TWO_PIXELS
    cells = maps.select("image_key", "at", "q", F.explode("px").alias("p")).select("image_key", "at", "q", "p.cell", "p.n")
    known = cells.groupBy("image_key", "cell").agg(F.count(F.lit(1)).alias("c"))
    ranked = cells.join(known, ["image_key", "cell"]).groupBy("image_key", "at", "q").agg(F.array_sort(F.collect_list(F.struct("c", "cell", "n"))).alias("o"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("top"), F.lit(0).alias("m"))
    bar = lambda a: a["sum"] - (a["top"] if pairs else F.lit(0)) >= limit
    add = lambda a, x: F.struct((a["sum"] + x["n"] * x["n"]).cast("long").alias("sum"), F.greatest(a["top"], (x["n"] * x["n"]).cast("long")).alias("top"), (a["m"] + 1).alias("m"))
    prefix = F.aggregate("o", start, lambda a, x: F.when(bar(a), a).otherwise(add(a, x)))
    found = ranked.withColumn("a", prefix).select("image_key", "at", "q", bar(F.col("a")).alias("heavy"), F.transform(F.slice("o", F.lit(1), F.greatest(F.col("a.m"), F.lit(1))), lambda x: x["cell"].cast("long")).alias("k"))
    single = F.transform("k", lambda c: -c - 1)
    if pairs:
        double = F.flatten(F.transform("k", lambda x, i: F.transform(F.filter("k", lambda y, j: j > i), lambda y: F.shiftleft(F.least(x, y), 32) + F.greatest(x, y))))
        tokens = F.when(F.col("heavy"), double).otherwise(F.concat(double, single))
    else:
        tokens = single
    listed = found.select("image_key", F.explode(tokens).alias("token"), "at", "q")
    a, b = (listed.select("image_key", "token", F.col("at").alias(x), F.col("q").alias(f"q{x}")) for x in "ab")
    apart = F.abs(F.sqrt("qa") - F.sqrt("qb")) < float(thresh)
    candidates = a.join(b, ["image_key", "token"]).where((F.col("a") < F.col("b")) & apart).select("image_key", "a", "b").distinct()
    with_pixels = lambda x: maps.select("image_key", F.col("at").alias(x), F.col("px").alias(f"p{x}"), F.col("q").alias(f"q{x}"))
    met = candidates.join(with_pixels("a"), ["image_key", "a"]).join(with_pixels("b"), ["image_key", "b"])
    other = F.map_from_entries("pb")
    dot = F.aggregate("pa", F.lit(0).cast("long"), lambda s, p: s + p["n"] * F.coalesce(F.try_element_at(other, p["cell"]), F.lit(0)))
    return met.where(F.col("qa") + F.col("qb") - 2 * dot < limit).select("image_key", "a", "b")


def near_duplicate_maps(subs: DataFrame, thresh: float, h: int, w: int) -> DataFrame:
    """(image_key, sub_id): submissions left after greedy removal, in file order.

    A map goes if its squared distance to an earlier one that stays is under thresh
    squared. Equal maps go first. The rest is decided in rounds, for all images at once: a map stays
    if no earlier undecided map is near, and takes the later ones near it away. Very light maps
    are near each other whatever their pixels; for these, the first of each norm speaks for all.
    """
    if thresh <= 0:
        return subs.select("image_key", "sub_id")
    limit = float(thresh) ** 2
    maps = settled(distinct_maps(subs, h, w), "maps")
    near = settled(near_maps(maps, thresh), "near-maps")
    touched = near.select("image_key", F.explode(F.array("a", "b")).alias("at")).distinct()
    places = maps.select("image_key", "at", "q")
    open_ = settled(places.where(F.col("q") < limit).unionAll(places.where(F.col("q") >= limit).join(touched, ["image_key", "at"], "left_semi")), "open-maps")
    kept = places.join(open_, ["image_key", "at"], "left_anti").select("image_key", "at")
    after = lambda df: df.join(near.select("image_key", F.col("a").alias("at"), "b"), ["image_key", "at"]).select("image_key", F.col("b").alias("at"))

    def light(df: DataFrame, of: DataFrame) -> DataFrame:
        """Places of ``of`` behind a place of ``df`` that is near for their norms alone."""
        first = df.where(F.col("q") < limit).groupBy("image_key", F.col("q").alias("_q")).agg(F.min("at").alias("_at"))  # norms under the limit
        met = of.where(F.col("q") < limit).join(first, "image_key").where((F.col("q") + F.col("_q") < limit) & (F.col("_at") < F.col("at")))
        return met.select("image_key", "at")

    while open_.limit(1).count():
        blocked = after(open_).unionAll(light(open_, open_)).distinct()
        stay = settled(open_.join(blocked, ["image_key", "at"], "left_anti"), "kept-maps")
        kept = kept.unionAll(stay.select("image_key", "at"))
        gone = stay.select("image_key", "at").unionAll(after(stay)).unionAll(light(stay, open_)).distinct()
        open_ = settled(open_.join(gone, ["image_key", "at"], "left_anti"), "open-maps")
    return kept.select("image_key", F.col("at.sub_id").alias("sub_id"))
