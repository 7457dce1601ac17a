"""Streaming ingest over files."""

from datetime import datetime

from attnmaps.streaming import ingest

SCHEMA = "user_id long, image_path string, ts timestamp"


def run(spark, tmp_path, plan, name, mode):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(1, "d/c0/a.png", at(1)), (1, "d/c0/a.png", at(1, 5)), (2, "d/c0/a.png", at(1, 6)), (2, "d/c1/b.png", at(3)), (9, "d/c9/z.png", at(9))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_first_submissions(spark, tmp_path):
    found = run(spark, tmp_path, ingest.first_submissions, "firsts", "append")
    assert sorted((r.user_id, r.image_path) for r in found) == [(1, "d/c0/a.png"), (2, "d/c0/a.png"), (2, "d/c1/b.png"), (9, "d/c9/z.png")]


def test_running_counts(spark, tmp_path):
    found = run(spark, tmp_path, ingest.running_counts, "counts", "update")
    assert {(r.image_key, r.n) for r in found} == {("c0/a.png", 3), ("c1/b.png", 1), ("c9/z.png", 1)}
