"""Outputs: heatmaps, counts, medians, scores and lists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnmaps.functions.paths import flat_name, image_key
from attnmaps.sources.shared import settled

#: Folders that heatmaps are spread over by hash; never one by image.
BUCKETS = 16


def write_heatmaps(heatmaps: DataFrame, path: str, counts: DataFrame | None = None) -> None:
    """Heatmaps with their flat name, original key and counts; an older entry is replaced."""
    rows = heatmaps.withColumn("name", flat_name(F.col("image_key")))
    if counts is not None:
        rows = rows.join(counts, "image_key", "left")
    rows.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_heatmaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries that the new ones don't replace, and the new ones."""
    return old.join(new.select("image_key", "level"), ["image_key", "level"], "left_anti").unionByName(new, allowMissingColumns=True)


def read_heatmaps(spark: SparkSession, path: str, generation: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The heatmaps of a store as of a generation (the last one by default); None if it has none."""
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException:
        return None
    asked = manifest if generation is None else manifest.where(F.col("generation") <= generation)
    newest = asked.groupBy("bucket").agg(F.max_by("folder", "generation").alias("folder"))
    folders = sorted(f"{path}/data/{r['folder']}/bucket={r['bucket']}" for r in newest.collect() if buckets is None or r["bucket"] in buckets)  # BUCKETS at most
    return spark.read.option("recursiveFileLookup", True).parquet(*folders) if folders else None


MANIFEST = "generation int, bucket int, folder string"


def replace_heatmaps(heatmaps: DataFrame, path: str, counts: DataFrame | None = None) -> int:
    """Add heatmaps to a store, in place of its older entries of the same image and level; returns the new generation.

    Only the buckets that new entries fall into are read, merged and written, to a folder of their own. Then
    one file is appended to the manifest, which switches all of them at once; a run that fails
    before that changes nothing, and readers keep the generation that they began with. Without new
    entries there is no new generation.
    """
    spark, folder = heatmaps.sparkSession, uuid.uuid4().hex
    rows = heatmaps.withColumn("name", flat_name(F.col("image_key")))
    if counts is not None:
        rows = rows.join(counts, "image_key", "left")
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")
    new = settled(rows, "staged-heatmaps")
    touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # BUCKETS at most
    try:
        last = spark.read.schema(MANIFEST).json(f"{path}/manifest").agg(F.max("generation")).first()[0]
    except AnalysisException:
        last = 0
    if not touched:
        return last
    old = read_heatmaps(spark, path, buckets=touched)
    merged = new if old is None else merge_heatmaps(old, new)
    merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    entries = spark.createDataFrame([(last + 1, b, folder) for b in touched], MANIFEST)
    entries.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return last + 1


def existing_only(heatmaps: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Heatmaps of images that are in the listing."""
    return heatmaps.join(listing.select(image_key(F.col(path_col)).alias("image_key")), "image_key", "left_semi")


def write_click_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").json(path)


def write_medians(image: DataFrame, category: DataFrame, overall: DataFrame, path: str) -> None:
    """Three tables below a folder: image, category, all."""
    for name, df in (("image", image), ("category", category), ("all", overall)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_scores(scores: DataFrame, summary: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_sampled(subs: DataFrame, path: str) -> None:
    """Sampled submissions as CSV with the click text of the first form."""
    text = F.concat(F.lit("["), F.array_join(F.transform("clicks", lambda c: F.concat(F.lit("("), c["x"].cast("string"), F.lit(", "), c["y"].cast("string"), F.lit(")"))), ", "), F.lit("]"))
    rows = subs.select(F.col("ord"), "image_path", text.alias("clicks"), "user_id", F.col("ts").cast("string").alias("timestamp"))
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_missing(images: DataFrame, path: str) -> None:
    images.write.mode("overwrite").json(path)
