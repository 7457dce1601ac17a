"""Adapters: the inputs of the library's jobs, derived from the given tables.

Each adapter is SQL that both Spark and DuckDB run unchanged.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "concat('c', CAST((o_orderkey % 97) % 7 AS STRING), '/im_', lpad(CAST(o_orderkey % 97 AS STRING), 5, '0'), '.png')"

#: Adapter SQL by name, in order of need; later ones may read earlier ones.
SQL = {
    "submissions": f"""
        SELECT o_orderkey AS sub_id, o_orderkey AS ord, concat('dump/imgs/', {IMAGE}) AS image_path,
          o_custkey % 50 AS user_id, o_orderdate AS ts,
          CAST(90 + o_orderkey % 11 AS DOUBLE) / CAST(100 AS DOUBLE) AS user_catch_trial, (o_custkey % 50) % 5 = 0 AS is_mobile
        FROM orders""",
    "clicks": """
        SELECT l_orderkey AS sub_id,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
          CAST(l_partkey % 34 - 1 AS INT) AS x, CAST((l_suppkey * 7 + l_linenumber) % 34 - 1 AS INT) AS y
        FROM lineitem""",
    "images": f"SELECT DISTINCT o_orderkey % 97 AS image_id, {IMAGE} AS image_key FROM orders",
    "dims": """
        SELECT image_key, CAST(32 + 8 * (image_id % 3) AS INT) AS width, CAST(32 + 8 * (image_id % 2) AS INT) AS height
        FROM images WHERE image_id % 10 <> 9""",
    "masks": """
        SELECT split_part(image_key, '.', 1) AS mask_key, CAST(image_id % 8 AS INT) AS x0, CAST(image_id % 5 AS INT) AS y0,
          CAST(image_id % 8 + 15 AS INT) AS x1, CAST(image_id % 5 + 15 AS INT) AS y1
        FROM images WHERE image_id % 4 <> 3""",
    "listing": "SELECT concat('/data/images/', image_key) AS path FROM images WHERE image_id % 6 <> 5",
    "classes": "SELECT concat('c', CAST(r_regionkey AS STRING)) AS category FROM region",
    "devices": "SELECT DISTINCT user_id, event_type = 'signup' AND value > 150 AS is_mobile FROM events WHERE user_id < 120",
    "players": "SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 END AS label FROM events WHERE user_id % 10 < 4",
    "frames": """
        SELECT image_id, image_key,
          concat('seq_', CAST(CAST(floor(image_id / 24) AS INT) AS STRING), '_', lpad(CAST(image_id % 24 AS STRING), 5, '0'), '.png') AS frame_key,
          CAST(1.0 AS DOUBLE) + CAST(image_id % 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS scale
        FROM images""",
    "scores": """
        SELECT event_id % 5000 AS image_id, CASE WHEN event_id < 5000 THEN 'ceiling' ELSE 'floor' END AS kind, value / 500 AS score
        FROM events""",
    "pointers": """
        SELECT event_id, concat('imagenet/train/n', lpad(CAST(1500000 + user_id * 20011 AS STRING), 8, '0'), '/f', CAST(event_id % 700 AS STRING), '.JPEG') AS file_pointer, user_id
        FROM events""",
}
_GIVEN = ("orders", "lineitem", "region", "events", "embeddings", "part", "supplier", "customer", "nation")


class Inputs:
    """The adapters as DataFrames over a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in _GIVEN:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = SQL[name]
                needs = {n for n in (*_GIVEN, *SQL) if f"FROM {n}" in text}
                for n in needs:
                    text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needs})
        return self._made[name]

    @cached_property
    def subs(self) -> DataFrame:
        """Submissions with their clicks in order; those without clicks have an empty array."""
        clicks = self.clicks.groupBy("sub_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
        pairs = F.transform(F.coalesce("c", F.array().cast("array<struct<pos:int,x:int,y:int>>")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
        return self.submissions.join(clicks, "sub_id", "left").withColumn("clicks", pairs).drop("c")


def ctes(*names: str) -> str:
    """WITH clause that gives DuckDB the adapters named and those that they read."""
    wanted = set(names)
    for name in reversed(SQL):
        if name in wanted:
            wanted |= {n for n in SQL if f"FROM {n}" in SQL[name]}
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in SQL if n in wanted)
