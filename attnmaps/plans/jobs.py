"""The three main jobs, as plans over submissions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.functions.clicks import kernel_size
from attnmaps.functions.paths import image_key
from attnmaps.functions.paths import without_extension
from attnmaps.operators import agreement, filters, joins, players, raster, stats
from attnmaps.sources.shared import settled


@dataclass(frozen=True)
class Prepare:
    """Semantic parameters of the prepare job."""

    image_shape: tuple[int, int] = (256, 256)
    blur_size: int = 21
    min_clicks: int = 1
    max_clicks: int = 1_000_000
    clicks_mode: str = "trim"
    min_subjects: int = 1
    max_subjects: int = 0
    catch_threshold: float = 0.95
    mobile: bool = False
    duplicates: bool = False
    include: str | None = None
    exclude: tuple[str, ...] = ()
    recheck: bool = True
    levels: int = 1


def clean(subs: DataFrame, p: Prepare, classes: DataFrame | None = None, participants: DataFrame | None = None) -> DataFrame:
    """Submissions after all filters, by class and by the verdicts (sub_id, good) on participants if given.

    Deduplication comes before the click limits, so a short first submission hides a
    later one. No step gathers the rows of an image: a user's rows of an image meet, and
    images are counted in two stages. Where images are counted, what is left is written to the shared
    folder first, so that counting reads one column of it.
    """
    rows = filters.filter_catch(subs, p.catch_threshold)
    if not p.mobile:
        rows = filters.filter_mobile(rows)
    rows = rows.withColumn("image_key", image_key(F.col("image_path")))
    if not p.duplicates:
        rows = filters.dedupe_first(rows)
    if p.include:
        rows = filters.include_paths(rows, p.include)
    rows = filters.exclude_paths(rows, list(p.exclude))
    rows = filters.limit_clicks(filters.drop_trivial(rows), p.min_clicks, p.max_clicks, p.clicks_mode)
    if classes is not None:
        rows = filters.filter_classes(rows, classes)
    if participants is not None:
        rows = players.participant_filter(rows, participants)
    if p.min_subjects > 1:
        rows = settled(rows, "clean")
    return filters.max_subjects(filters.min_subjects(rows, p.min_subjects), p.max_subjects)


def sized_means(sized: DataFrame, p: Prepare) -> DataFrame:
    """(image_key, y, x, v, h, w, maps): mean raster of the valid submissions of each image, on its own canvas (h, w).

    Cells are counted within a submission's row and summed in two stages, so a task of an image
    of very many submissions sends its pixels once.
    """
    rows = raster.counted_cells(sized, F.col("h"), F.col("w")).where(F.col("clicks") >= max(1, p.min_clicks))
    counts = rows.groupBy("image_key").agg(F.count(F.lit(1)).alias("maps"))
    if p.recheck:
        counts = counts.where(F.col("maps") >= p.min_subjects)
    counts = counts.join(sized.groupBy("image_key").agg(F.first("h").alias("h"), F.first("w").alias("w")), "image_key")
    sums = rows.select("image_key", F.inline("cells")).groupBy("image_key", "cell").agg(F.sum("n").alias("v"))
    cell = F.col("cell")
    return sums.join(counts, "image_key").select(
        "image_key", F.floor(cell / F.col("w")).cast("int").alias("y"), (cell % F.col("w")).cast("int").alias("x"), (F.col("v") / F.col("maps")).alias("v"), "h", "w", "maps"
    )


def mean_maps(cleaned: DataFrame, p: Prepare, h: int, w: int) -> DataFrame:
    """(image_key, y, x, v): the same on one canvas for all."""
    return sized_means(cleaned.withColumns({"h": F.lit(h), "w": F.lit(w)}), p).select("image_key", "y", "x", "v")


def prepare(
    subs: DataFrame, p: Prepare, classes: DataFrame | None = None, participants: DataFrame | None = None, dims: DataFrame | None = None,
    masks: DataFrame | None = None, mask_threshold: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(heatmaps, counts): the whole job in one call.

    ``dims`` (image_key, width, height) gives images a canvas and a blur of their own, others
    have the stated ones. ``masks`` (mask_key, y, x) keeps the images whose map overlaps their mask by
    less than the threshold. Counts are (image_key, maps) of the images that are left.
    """
    rows = clean(subs, p, classes, participants)
    h, w = p.image_shape
    if dims is None:
        rows = rows.withColumns({"h": F.lit(h), "w": F.lit(w), "size": F.lit(p.blur_size + (p.blur_size % 2 == 0))})
    else:
        own = joins.attach_dimensions(rows.select("image_key").distinct(), dims, p.image_shape)
        rows = rows.join(own.withColumn("size", kernel_size(p.blur_size, "width", "height", p.image_shape)).select("image_key", "h", "w", "size"), "image_key")
    means = settled(sized_means(rows, p), "means")
    if masks is not None:
        keyed = means.select(without_extension(F.col("image_key")).alias("mask_key"), F.lit(0).alias("level"), "y", "x", "v", "h", "w")
        kept = filters.filter_foreground(keyed, masks, mask_threshold).select("mask_key")
        means = means.withColumn("mask_key", without_extension(F.col("image_key"))).join(kept, "mask_key", "left_semi").drop("mask_key")
    sizes = rows.groupBy("image_key").agg(F.first("size").alias("size"))
    heat = raster.blur_dense(means.join(sizes, "image_key"))
    return heat, means.groupBy("image_key").agg(F.first("maps").alias("maps"))


def heatmaps(cleaned: DataFrame, p: Prepare) -> DataFrame:
    """Blurred mean heatmap of each image, and of each level if there is more than one.

    Clicks are counted by pixel before a map is made dense, so a helper call holds one map
    however many submissions an image has.
    """
    h, w = p.image_shape
    if p.levels == 1:
        maps = mean_maps(cleaned, p, h, w)
    else:
        maps = raster.cumulative_maps(cleaned, raster.image_bins(cleaned, p.levels), h, w, p.min_clicks)
    return raster.blur_dense(maps.withColumns({"h": F.lit(h), "w": F.lit(w)}), p.blur_size + (p.blur_size % 2 == 0))


def with_kernel(cleaned: DataFrame, dims: DataFrame, blur_size: int, map_shape: tuple[int, int]) -> DataFrame:
    """Submissions with their image's own blur size, for the agreement jobs; dims has (image_key, width, height)."""
    sized = cleaned.join(dims.select("image_key", "width", "height"), "image_key", "left")
    return sized.withColumn("kernel", kernel_size(blur_size, "width", "height", map_shape)).drop("width", "height")


def ceiling_floor(cleaned: DataFrame, p: agreement.Agreement) -> tuple[DataFrame, DataFrame]:
    """(scores by image and kind, one-row summary) of ceilings and floors."""
    per_image = stats.integrate_scores(agreement.ceiling_floor(cleaned, p), ["image_key", "kind"])
    return per_image, stats.ceiling_floor_summary(per_image)


def scale_constancy(cleaned: DataFrame, pairs: DataFrame, scales: DataFrame, p: agreement.Agreement) -> tuple[DataFrame, DataFrame]:
    """(scores by frame, axis, diff and kind, summary by axis and diff)."""
    return _summed(agreement.scale_constancy(cleaned, pairs, scales, p))


def rotation_constancy(cleaned: DataFrame, pairs: DataFrame, cameras: DataFrame, p: agreement.Agreement) -> tuple[DataFrame, DataFrame]:
    """The same across directions; cameras has (key, w2c, k, depth)."""
    return _summed(agreement.rotation_constancy(cleaned, pairs, cameras, p))


def _summed(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_pair = stats.integrate_scores(scores, ["image_key", "axis", "diff", "kind"], skip_nan_levels=True)
    return per_pair, stats.constancy_summary(per_pair)
