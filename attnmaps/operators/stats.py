"""Counts, medians, activity and other summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.functions.paths import category, hashed_number, is_animal


def maps_per_image(subs: DataFrame) -> DataFrame:
    """(image_key, n): usable submissions of each image."""
    return subs.groupBy("image_key").agg(F.count(F.lit(1)).alias("n"))


def run_summary(subs: DataFrame, deduped: bool) -> DataFrame:
    return subs.agg(F.count(F.lit(1)).alias("total_maps"), F.countDistinct("image_key").alias("unique_images")).withColumn("deduped", F.lit(deduped))


def filter_report(subs: DataFrame, thresh: float = 0.95) -> DataFrame:
    """One row: rows before and after each filter, removed duplicates with their share, empties.

    Every row is marked with the filters that it passes, so that the table is read once.
    """
    order = [F.col(c).asc_nulls_last() for c in ("ts", "ord")]
    own = Window.partitionBy("image_key", "user_id", "image_path", "_caught").orderBy(*order)
    rows = subs.withColumn("_caught", F.coalesce((F.col("user_catch_trial") >= thresh) & ~F.col("is_mobile"), F.lit(False)))
    rows = rows.withColumn("_first", F.col("_caught") & (F.row_number().over(own) == 1))
    clicks = F.size("clicks")
    row = rows.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if("_caught").alias("n_caught"), F.count_if("_first").alias("n_deduped"),
        F.count_if(F.col("_first") & (clicks > 1)).alias("n_kept"), F.count_if(F.col("_first") & (clicks == 0)).alias("n_empty"),
    )
    gone = F.col("n_caught") - F.col("n_deduped")
    return row.withColumns({"n_duplicates": gone, "share_duplicates": gone / F.nullif(F.col("n_caught"), F.lit(0))})


def medians_image(subs: DataFrame) -> DataFrame:
    """(image_key, median): of clicks per submission, truncated."""
    return subs.groupBy("image_key").agg(F.percentile(F.size("clicks"), F.lit(0.5)).cast("long").alias("median"))


def medians_category(subs: DataFrame) -> DataFrame:
    """(category, median): of submissions per image, truncated."""
    per_image = maps_per_image(subs).withColumn("category", category(F.col("image_key")))
    return per_image.groupBy("category").agg(F.percentile("n", F.lit(0.5)).cast("long").alias("median"))


def medians_all(subs: DataFrame, thresh: float = 0.95) -> DataFrame:
    """Median, percentile (both truncated) and mean of submissions per image."""
    at = lambda p: F.percentile("n", F.lit(p)).cast("long")
    return maps_per_image(subs).agg(at(0.5).alias("median"), at(thresh).alias("percentile"), F.avg("n").alias("mean"))


def medians_batched(subs: DataFrame, n_batches: int, thresh: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """By category and over all: medians of batches' medians, mean of their means.

    An approximation of the exact forms above, with images in batches by key hash.
    """
    per_image = maps_per_image(subs).withColumns({"category": category(F.col("image_key")), "batch": F.expr(f"pmod(cast(conv(substring(md5(image_key), 1, 7), 16, 10) as long), {n_batches})")})
    at = lambda c, p: F.percentile(c, F.lit(p)).cast("long")
    by_category = per_image.groupBy("category", "batch").agg(at("n", 0.5).alias("m")).groupBy("category").agg(at("m", 0.5).alias("median"))
    batches = per_image.groupBy("batch").agg(at("n", 0.5).alias("m"), at("n", thresh).alias("p"), F.avg("n").alias("a"))
    return by_category, batches.agg(at("m", 0.5).alias("median"), at("p", 0.5).alias("percentile"), F.avg("a").alias("mean"))


def subjects_per_file(df: DataFrame, contains: str = "ILSVRC2012_val", path_col: str = "image_path") -> DataFrame:
    """(file, n): submissions by base name, of paths with the given part."""
    return df.where(F.col(path_col).contains(contains)).groupBy(F.element_at(F.split(path_col, "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


def maps_stats_by_group(pointers: DataFrame, path_col: str = "file_pointer", over: int = 5) -> DataFrame:
    """By animal or not: mean and quartiles of maps per image, percent of images with over five."""
    per_image = pointers.groupBy(path_col).agg(F.count(F.lit(1)).alias("n")).withColumn("is_animal", is_animal(F.col(path_col))).where("is_animal is not null")
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = per_image.groupBy("is_animal").agg(F.avg("n").alias("mean"), q.alias("q"), (100.0 * F.count_if(F.col("n") > over) / F.count(F.lit(1))).alias("percent_over"))
    return rows.select("is_animal", "mean", *[F.get("q", i).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "percent_over")


def user_activity(subs: DataFrame, bin: int = 50) -> DataFrame:
    """Thresholds of super and light users, their numbers, and the number of users."""
    per_user = subs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    up = lambda p: (F.ceil(F.percentile("n", F.lit(p)) / bin) * bin).cast("long")
    limits = per_user.agg(up(0.95).alias("super_at"), F.greatest(F.lit(bin), up(0.25)).cast("long").alias("light_at"))
    joined = per_user.crossJoin(F.broadcast(limits))  # one row
    return joined.groupBy("super_at", "light_at").agg(
        F.count_if(F.col("n") > F.col("super_at")).alias("n_super"), F.count_if(F.col("n") < F.col("light_at")).alias("n_light"), F.count(F.lit(1)).alias("n_users")
    )


def user_histogram(subs: DataFrame, bin: int) -> DataFrame:
    """(bin_start, n_users): users by number of maps; the last bin's upper edge belongs to it."""
    per_user = subs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    last = per_user.agg((F.ceil((F.max("n") + bin) / bin) - 2).alias("last"))
    at = F.least(F.floor(F.col("n") / bin), F.col("last"))
    return per_user.crossJoin(F.broadcast(last)).groupBy((at * bin).alias("bin_start")).agg(F.count(F.lit(1)).alias("n_users"))


def class_weights(df: DataFrame) -> DataFrame:
    """(label, weight): n / (k * count)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))


def class_balance(df: DataFrame) -> DataFrame:
    """Rows with their label's weight; the weights are one row a label."""
    return df.join(F.broadcast(class_weights(df)), "label")


def coord_extent(df: DataFrame, div: int, x: str = "clickmap_x", y: str = "clickmap_y") -> DataFrame:
    top = F.greatest(F.max(F.array_max(x)), F.max(F.array_max(y)))
    return df.agg(F.floor(top / div).cast("long").alias("extent"))


def well_covered_per_class(subs: DataFrame, n: int = 20) -> DataFrame:
    """(category, n_images): images of each class with over n maps."""
    per_image = maps_per_image(subs).withColumn("category", category(F.col("image_key")))
    return per_image.groupBy("category").agg(F.count_if(F.col("n") > n).alias("n_images")).where("n_images > 0")


def _mean(col: str, skip_nan: bool):
    return F.avg(F.nanvl(F.col(col), F.lit(None).cast("double"))) if skip_nan else F.avg(col)


def ceiling_floor_summary(scores: DataFrame, skip_nan: bool = True) -> DataFrame:
    """Mean ceiling, mean floor and their ratio; NaN skipped or carried."""
    pick = lambda kind: F.when(F.col("kind") == kind, F.col("score"))
    rows = scores.select(pick("ceiling").alias("c"), pick("floor").alias("f"))
    means = rows.agg(_mean("c", skip_nan).alias("mean_ceiling"), _mean("f", skip_nan).alias("mean_floor"))
    return means.withColumn("ratio", F.col("mean_ceiling") / F.nullif(F.col("mean_floor"), F.lit(0.0)))


def constancy_summary(scores: DataFrame) -> DataFrame:
    """By axis and diff: mean ceiling and floor and their ratio.

    Only the rotation ceiling skips NaN; the other means carry it.
    """
    score = F.when((F.col("axis") == "rotation") & (F.col("kind") == "ceiling"), F.nanvl("score", F.lit(None).cast("double"))).otherwise(F.col("score"))
    rows = scores.withColumn("score", score).groupBy("axis", "diff").pivot("kind", ["ceiling", "floor"]).agg(F.avg("score"))
    return rows.select("axis", "diff", F.col("ceiling").alias("mean_ceiling"), F.col("floor").alias("mean_floor"), (F.col("ceiling") / F.nullif(F.col("floor"), F.lit(0.0))).alias("ratio"))


def integrate_scores(scores: DataFrame, keys: list[str], skip_nan_levels: bool = False) -> DataFrame:
    """Mean over iterations, NaN skipped, then over levels (NaN skipped on demand)."""
    per_level = scores.groupBy(*keys, "level").agg(_mean("score", True).alias("score"))
    per_level = per_level.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    return per_level.groupBy(*keys).agg(_mean("score", skip_nan_levels).alias("score"))


def sample_per_class(subs: DataFrame, min_maps: int = 20, k: int = 5, contains: str | None = "ILSVRC2012_val") -> DataFrame:
    """All submissions of each class's first k images with over ``min_maps`` maps."""
    own = subs if contains is None else subs.where(F.col("image_path").contains(contains))
    per_image = own.groupBy("image_key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where(F.col("n") > min_maps)
    rank = F.row_number().over(Window.partitionBy(category(F.col("image_key"))).orderBy("first", "image_key"))
    chosen = per_image.withColumn("rank", rank).where(F.col("rank") <= k)
    return own.join(chosen.select("image_key"), "image_key", "left_semi")


def top_bottom(scores: DataFrame, k: int = 10, score_col: str = "score", key_col: str = "image_key") -> DataFrame:
    """(side, key, score): the k best and k worst images; ties by key."""
    part = lambda side, order: scores.orderBy(order, key_col).limit(k).select(F.lit(side).alias("side"), key_col, score_col)
    return part("top", F.desc(score_col)).unionAll(part("bottom", F.asc(score_col)))


def most_clicked_until(counts: DataFrame, keep: int = 50) -> DataFrame:
    """Images by count, descending, until their sum reaches ``keep``, with all that tie with the last.

    The running total is over distinct counts, which are few, and not over images.
    """
    by_count = counts.groupBy("n").agg((F.col("n") * F.count(F.lit(1))).alias("mass"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    bar = by_count.withColumn("before", F.coalesce(F.sum("mass").over(before), F.lit(0))).where(F.col("before") < keep).agg(F.min("n").alias("bar"))
    return counts.crossJoin(F.broadcast(bar)).where("n >= bar").drop("bar")


def display_keys(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "image_key").limit(k)


#: Hash buckets in which the rows of a label are numbered.
BUCKETS = 256


def _long_hash(*parts: Column) -> Column:
    """A number of 60 bits from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def balanced_resample(df: DataFrame, id_col: str, seed: int, n: int | None = None) -> DataFrame:
    """Exactly n rows (by default as many as there are) drawn with replacement by their label's weight.

    Every label has the same share of all weight, so a draw takes a label and one of its rows,
    both by a hash of its number and the seed; rows are numbered within hash buckets, whose sizes
    are added up. Any partitioning gives the same. Adds ``weight`` and ``draw``.
    """
    spark = df.sparkSession
    rows = class_balance(df).withColumn("_b", F.pmod(hashed_number(F.col(id_col).cast("string")), F.lit(BUCKETS)))
    sizes = rows.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("label")  # at most BUCKETS rows
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("label", "_b").orderBy(id_col)) - 1
    numbered = rows.withColumn("_i", place).join(F.broadcast(starts.select("label", "_b", "_start")), ["label", "_b"]).withColumn("_i", F.col("_i") + F.col("_start"))
    labels = sizes.groupBy("label").agg(F.sum("_n").alias("_total")).withColumn("_l", F.row_number().over(Window.orderBy("label")) - 1)  # a row a label
    labels = labels.withColumn("_labels", F.count(F.lit(1)).over(Window.partitionBy()))
    known = {r["_l"]: r for r in labels.collect()}
    if not known:
        return numbered.drop("_b", "_i", "_start").withColumn("draw", F.lit(0).cast("long"))
    draws = spark.range(df.count() if n is None else n).withColumnRenamed("id", "draw")
    text = lambda tag: _long_hash(F.col("draw").cast("string"), F.lit(str(seed)), F.lit(tag))
    drawn = draws.withColumn("_l", F.pmod(text("label"), F.lit(len(known))).cast("int")).join(F.broadcast(labels.select("_l", "label", "_total")), "_l")
    drawn = drawn.select("draw", "label", F.pmod(text("row"), F.col("_total")).alias("_i"))
    return numbered.join(drawn, ["label", "_i"]).drop("_b", "_i", "_start")


def match_good_players(good: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the good users, in the order of a seeded hash."""
    return good.orderBy(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.lit(str(seed))).cast("binary")), "user_id").limit(n)
