"""Readers of submissions, dimensions, cameras, packed records and masks."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnmaps.functions.clicks import normalise_mobile, parse_clicks, zip_clicks


def read_submissions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Submissions with click text; the columns are found by their header names.

    A first column that holds the file order, under "ord" or no name, becomes ``ord``. Without
    one, ``ord`` is a struct (file, block, row) that sorts in file order: files by path, splits
    by where they begin, and rows by their place within a split, however Spark deals out splits.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    order = next((c for c in ("ord", "_c0", "Unnamed: 0") if c in raw.columns), None)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    ord_col = F.col(f"`{order}`").cast("long") if order else place
    ts = F.col("timestamp").cast("timestamp") if "timestamp" in raw.columns else F.lit(None).cast("timestamp")
    return raw.select(ord_col.alias("ord"), "image_path", F.col("user_id").cast("long").alias("user_id"), ts.alias("ts"), parse_clicks(F.col("clicks")).alias("clicks"))


ARCHIVE = "image_path string, clickmap_x array<int>, clickmap_y array<int>, user_id long, user_catch_trial double, is_mobile array<boolean>, ord long"


def read_submissions_archive(spark: SparkSession, path: str) -> DataFrame:
    """Submissions from the six parallel columns, pairs cut to the shorter coordinate list."""
    raw = spark.read.schema(ARCHIVE).parquet(path)
    return raw.select("ord", "image_path", "user_id", "user_catch_trial", normalise_mobile(F.col("is_mobile")).alias("is_mobile"), zip_clicks(F.col("clickmap_x"), F.col("clickmap_y")).alias("clicks"))


def union_splits(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def image_paths(df: DataFrame, contains: str, remove: str, path_col: str = "image_path") -> DataFrame:
    """Distinct paths with a part, and their keys without another part."""
    paths = df.where(F.col(path_col).contains(contains)).select(path_col).distinct()
    return paths.select(path_col, F.replace(path_col, F.lit(remove), F.lit("")).alias("image_key"))


def image_dimensions(spark: SparkSession, df: DataFrame, contains: str, remove: str, image_root: str) -> DataFrame:
    """(image_key, width, height) of the paths that are PNG or JPEG files under the root.

    Only the files' headers are read, and only of the images that are asked for; what has no
    readable header is left out.
    """
    keys = image_paths(df, contains, remove).select("image_key").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(image_root).select("path")  # no content
    named = files.withColumn("image_key", F.regexp_replace("path", ".*?" + re.escape(image_root.split("://")[-1].rstrip("/")) + "/", ""))
    asked = named.join(keys, "image_key").select("image_key", "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [header_size(path) for path in batch.column(1).to_pylist()]
            known = pa.array([s is not None for s in sizes])
            width, height = (pa.array([s[k] for s in sizes if s], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), width, height], names=["image_key", "width", "height"])

    return asked.mapInArrow(run, "image_key string, width int, height int")


def header_size(path: str) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG or JPEG file, None if it is neither or cut short."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        store, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        scheme, _, rest = path.partition("://")
        store, _ = fs.FileSystem.from_uri(f"{scheme}://{rest.partition('/')[0]}/")
        name = rest if scheme in ("s3", "gs") else "/" + rest.partition("/")[2]
    try:
        with store.open_input_file(name) as file:
            head = file.read(24)
            if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) == 24:
                return struct.unpack(">II", head[16:24])
            at = 2
            while head[:2] == b"\xff\xd8":
                file.seek(at)
                part = file.read(9)
                if len(part) < 4 or part[0] != 0xFF:
                    return None
                if part[1] == 0xFF:  # a fill byte
                    at += 1
                elif part[1] == 1 or 0xD0 <= part[1] <= 0xD8:  # markers without a length
                    at += 2
                elif 0xC0 <= part[1] <= 0xCF and part[1] not in (0xC4, 0xC8, 0xCC):  # a frame
                    return struct.unpack(">HH", part[5:9])[::-1] if len(part) == 9 else None
                else:
                    at += 2 + struct.unpack(">H", part[2:4])[0]
    except OSError:
        return None
    return None


CAMERAS = "scale map<string,double>, w2c map<string,array<array<double>>>, K map<string,array<array<double>>>"


def read_camera_json(spark: SparkSession, path: str, depth: DataFrame | None = None) -> DataFrame:
    """(image_key, scale, w2c, k[, depth]): one row an image from maps keyed by image."""
    raw = spark.read.schema(CAMERAS).json(path, multiLine=True)
    one = lambda c, name: raw.select(F.explode(c).alias("image_key", name))
    rows = one("scale", "scale").join(one("w2c", "w2c"), "image_key", "left").join(one("K", "k"), "image_key", "left")
    return rows if depth is None else rows.join(depth, "image_key", "left")


def decode_packed_records(df: DataFrame, side: int = 256, order_col: str = "ord") -> DataFrame:
    """(name, label, click_count, image array<int>, heatmap array<float>) of packed bytes.

    The name is ``{label}_{order}.png``; images go from floats to whole bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"name": [], "label": [], "click_count": [], "image": [], "heatmap": []}
            for r in batch.to_pylist():
                image = np.frombuffer(r["image"], dtype="<f4").reshape(side, side, -1)
                rows["name"].append(f"{r['label']}_{r['o']}.png")
                rows["label"].append(r["label"])
                rows["click_count"].append(r["click_count"])
                rows["image"].append(image.astype(np.uint8).ravel().astype(np.int32))
                rows["heatmap"].append(np.frombuffer(r["heatmap"], dtype="<f4"))
            kinds = [("name", pa.string()), ("label", pa.int64()), ("click_count", pa.int64()), ("image", pa.list_(pa.int32())), ("heatmap", pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(kinds))

    rows = df.select("label", "click_count", "image", "heatmap", F.col(order_col).alias("o"))
    return rows.mapInArrow(run, "name string, label long, click_count long, image array<int>, heatmap array<float>")


def mask_key(category, path):
    """Category, which may come as a list of one, and base name without extension."""
    return F.concat_ws("/", category, F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1)))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(mask_key, h, w, data) from (image_path, category array, h, w, data)."""
    raw = spark.read.parquet(path)
    return raw.select(mask_key(F.get("category", 0), F.col("image_path")).alias("mask_key"), "h", "w", "data")
