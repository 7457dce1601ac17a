"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of a block and blocks of a large one, in running folds.
BLOCK, LARGE = 16, 64


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only on a local master, where one machine runs all (as in tests), is a folder made for
    a session that has none. On a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(name: str) -> str:
    """A column name that no table of the caller has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there (lineage ends)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """The same for larger tables: Parquet in the shared folder, read by columns."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, fold: Callable[..., Column]) -> Column:
    """Array of the folds of the first 0, 1, 2, ... values of an array.

    ``fold`` takes arrays that are to be put together and folds all their elements. A
    beginning is the folds of whole large blocks and whole blocks, and single values, so
    each element is made of few others however long the array is. Spark's slices copy the
    array that they cut; here these are small as well.
    """

    def cut(of: Column, size: int, most: int | None = None) -> Column:
        last = F.floor(F.size(of) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last if most is None else F.least(last, F.lit(most))), lambda k: F.slice(of, k * size + 1, size))

    def all_of(blocks: Column, inner: Column, outer: Column) -> Column:
        upto = lambda b, k, d, j: fold(F.slice(outer, 1, b), F.slice(F.get(inner, b), 1, k), F.slice(d, 1, j))
        in_block = lambda b, d, k: F.transform(F.sequence(F.lit(0), F.least(F.size(d), F.lit(BLOCK - 1))), lambda j: upto(b, k, d, j))
        return F.flatten(F.transform(blocks, lambda c, b: F.flatten(F.transform(c, lambda d, k: in_block(b, d, k)))))

    in_blocks = lambda large: F.transform(large, lambda c: cut(c, BLOCK, LARGE - 1))
    folded = lambda nested: F.transform(nested, lambda c: F.transform(c, lambda d: fold(d)))
    return bound(
        cut(values, BLOCK * LARGE),
        lambda large: bound(
            F.struct(in_blocks(large).alias("blocks"), F.transform(large, lambda c: fold(c)).alias("outer")),
            lambda x: bound(folded(x["blocks"]), lambda inner: all_of(x["blocks"], inner, x["outer"])),
        ),
    )


def total(*arrays: Column) -> Column:
    """Sum of all elements of some arrays of whole numbers; a fold for ``running``."""
    return reduce(lambda a, b: a + b, [F.aggregate(x, F.lit(0), lambda acc, v: acc + v) for x in arrays])


#: Code points of a chunk in which a text is cut to find places in it.
CHUNK_BITS = 10


def slices(text: Column, spans: Column) -> Column:
    """The parts of a text at an array of spans (start, end) in code points.

    A place in a string is found by walking from its start, so the text is cut in chunks
    once and places are sought within these.
    """
    size = 1 << CHUNK_BITS

    def part(chunks: Column, s: Column) -> Column:
        first, last = F.shiftright(s["start"], CHUNK_BITS), F.shiftright(s["end"] - 1, CHUNK_BITS)
        offset = s["start"].bitwiseAND(size - 1)
        between = F.transform(F.sequence(first + 1, F.greatest(first + 1, last - 1)), lambda i: F.when(i < last, F.get(chunks, i)).otherwise(""))
        long = F.concat(F.substring(F.get(chunks, first), offset + 1, F.lit(size)), F.array_join(between, ""), F.substring(F.get(chunks, last), F.lit(1), s["end"] - F.shiftleft(last, CHUNK_BITS)))
        own = F.when(first == last, F.substring(F.get(chunks, first), offset + 1, s["end"] - s["start"])).otherwise(long)
        return F.when(s["end"] > s["start"], own).otherwise("")

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda chunks: F.transform(spans, lambda s: part(chunks, s)))
