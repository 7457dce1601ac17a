"""Filters on submissions and images."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.functions.paths import category, image_key


def filter_catch(subs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Submissions of users who passed so many catch trials."""
    return subs.where(F.col("user_catch_trial") >= threshold)


def filter_mobile(subs: DataFrame) -> DataFrame:
    return subs.where(~F.col("is_mobile"))


def include_paths(subs: DataFrame, text: str, col: str = "image_key") -> DataFrame:
    return subs.where(F.col(col).contains(text))


def exclude_paths(subs: DataFrame, texts: str | list[str], col: str = "image_key") -> DataFrame:
    for text in [texts] if isinstance(texts, str) else texts:
        subs = subs.where(~F.col(col).contains(text))
    return subs


#: Characters of the pieces by which keys are looked up in paths.
GRAM = 6


def _pieces(text: str, n: int):
    """Array of all pieces of n characters."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contained(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """The distinct keys (image_key) that occur anywhere in a path (_path).

    Paths are indexed by their pieces of ``GRAM`` characters. A key is looked up by the piece
    of its own that fewest paths have, and the paths found are searched for the whole key; a key
    with a piece that no path has is done at once. Shorter keys equal pieces of their length.
    """
    keys = keys.select("image_key").where("image_key is not null").distinct()
    paths = paths.select("_path").where("_path is not null").distinct()
    index = paths.select("_path", F.explode(F.array_distinct(_pieces("_path", GRAM))).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    long = keys.where(F.length("image_key") >= GRAM).select("image_key", F.explode(F.array_distinct(_pieces("image_key", GRAM))).alias("_gram"))
    rarest = long.join(counts, "_gram", "left").groupBy("image_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
    asked = rarest.where("_r.n > 0").select("image_key", F.col("_r.gram").alias("_gram"))
    found = asked.join(index, "_gram").where(F.contains("_path", "image_key")).select("image_key")
    pieces = F.array_distinct(F.concat(*[_pieces("_path", n) for n in range(1, GRAM)], F.array(F.lit(""))))
    short = paths.select(F.explode(pieces).alias("image_key")).distinct()
    return found.distinct().unionAll(keys.where(F.length("image_key") < GRAM).join(short, "image_key", "left_semi"))


def restrict_to_listing(subs: DataFrame, listing: DataFrame, path_col: str = "path", theta: bool = False) -> DataFrame:
    """Submissions whose image key occurs in a listed path.

    The key is a path's last two parts, so this is an equi-join; ``theta`` looks for the
    key anywhere in the path, by an index of the paths' pieces.
    """
    if theta:
        return subs.join(contained(subs, listing.select(F.col(path_col).alias("_path"))), "image_key", "left_semi")
    return subs.join(listing.select(image_key(F.col(path_col)).alias("image_key")), "image_key", "left_semi")


def constancy_key(key: str = "image_key") -> Column:
    """Key whose file part starts with its class, unless it has the class in it already."""
    own, file = category(F.col(key)), F.element_at(F.split(key, "/"), -1)
    return F.concat(own, F.lit("/"), F.when(F.contains(file, own), file).otherwise(F.concat(own, F.lit("_"), file)))


def constancy_rename(subs: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Rename the keys as above and keep those that are listed."""
    renamed = subs.withColumn("image_key", constancy_key())
    return restrict_to_listing(renamed, listing, path_col)


def filter_classes(subs: DataFrame, classes: DataFrame) -> DataFrame:
    """Submissions whose category is in the one-column table."""
    own = subs.withColumn("_category", category(F.col("image_key")))
    return own.join(classes.select(F.col("category").alias("_category")), "_category", "left_semi").drop("_category")


def drop_trivial(subs: DataFrame) -> DataFrame:
    """No submissions of one click or none."""
    return subs.where(F.size("clicks") > 1)


def limit_clicks(subs: DataFrame, min_clicks: int, max_clicks: int, mode: str = "trim") -> DataFrame:
    """More than ``min_clicks``; over ``max_clicks`` cut short ("trim") or left out ("exclude")."""
    enough = subs.where(F.size("clicks") > min_clicks)
    if mode == "trim":
        return enough.withColumn("clicks", F.slice("clicks", 1, max_clicks))
    if mode == "exclude":
        return enough.where(F.size("clicks") <= max_clicks)
    raise ValueError(f"mode is trim or exclude, not {mode}")


def min_subjects(subs: DataFrame, n: int) -> DataFrame:
    """Images with at least n submissions, counted in two stages; the rows of an image needn't meet in a task."""
    if n <= 1:
        return subs.where(F.col("image_key").isNotNull())
    counts = subs.groupBy("image_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return subs.join(counts.select("image_key"), "image_key", "left_semi")


def max_subjects(subs: DataFrame, n: int) -> DataFrame:
    """The first n submissions of each image; all if n is 0 or less.

    Spark keeps n rows of an image in each task before they meet.
    """
    if n <= 0:
        return subs
    own = Window.partitionBy("image_key").orderBy("ord", "sub_id")
    return subs.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= n).drop("_rank")


def dedupe_first(subs: DataFrame, key: str | None = "image_key") -> DataFrame:
    """The earliest submission of each user and image path, by time, else by file order.

    The rows of one user meet, never those of an image, and each task sends its earliest.
    """
    if "user_id" not in subs.columns:
        warnings.warn("no user_id: duplicates can't be told", stacklevel=2)
        return subs
    order = [F.col(c).asc_nulls_last() for c in ("ts", "ord") if c in subs.columns]
    own = Window.partitionBy(*[c for c in (key, "user_id", "image_path") if c]).orderBy(*order)
    return subs.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def drop_empty_coords(df: DataFrame, x: str = "clickmap_x", y: str = "clickmap_y") -> DataFrame:
    return df.where((F.size(x) > 0) | (F.size(y) > 0))


def filter_players(df: DataFrame, players: DataFrame) -> DataFrame:
    """Submissions of listed users with their label."""
    return df.join(players.select("user_id", "label"), "user_id")


def missing_files(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """Listed (category, file) rows that don't exist."""
    return listing.join(existing, ["category", "file"], "left_anti")


def under_annotated(subs: DataFrame, n: int = 5) -> DataFrame:
    """Images with fewer than n submissions and their counts."""
    return subs.groupBy("image_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n)


def filter_foreground(maps: DataFrame, masks: DataFrame, mask_threshold: float, quantize: float = 0.5) -> DataFrame:
    """(mask_key, iou) of images whose map overlaps its mask by less than the threshold.

    ``maps`` are sparse rows (mask_key, level, y, x, v) with the grid as (h, w); ``masks``
    hold the set pixels (mask_key, y, x). The mean over levels is binarised above
    ``quantize`` of its maximum, or above its mean over the grid if ``quantize`` is 0 or
    less. Images without a mask go.
    """
    levels = maps.groupBy("mask_key").agg(F.countDistinct("level").alias("levels"))
    pixels = maps.groupBy("mask_key", "y", "x").agg(F.sum("v").alias("v"), F.first("h").alias("h"), F.first("w").alias("w"))
    mean = pixels.join(levels, "mask_key").withColumn("v", F.col("v") / F.col("levels"))
    if quantize > 0:
        bars = mean.groupBy("mask_key").agg((F.max("v") * quantize).alias("bar"))
    else:
        bars = mean.groupBy("mask_key").agg((F.sum("v") / F.first(F.col("h") * F.col("w"))).alias("bar"))
    on = mean.join(bars, "mask_key").where("v > bar").select("mask_key", "y", "x", F.lit(1).alias("a"))
    known = maps.select("mask_key").distinct().join(masks.select("mask_key").distinct(), "mask_key")
    both = on.join(masks.select("mask_key", "y", "x", F.lit(1).alias("b")), ["mask_key", "y", "x"], "full")
    iou = both.groupBy("mask_key").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1))).alias("iou"))
    return known.join(iou, "mask_key").where(F.col("iou") < mask_threshold)
