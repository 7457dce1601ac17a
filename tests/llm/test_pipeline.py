"""The whole pipeline against a plain version of every stage."""

import itertools
import re

import pyarrow as pa
from pyspark.sql import functions as F
from test_nearcopies import plain_groups
from test_overlap_rule import plain_leaks, plain_tokens
from test_tokens import check_packed, plain

import corpus_pipeline
from attnmaps.llm import langid, queries

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = next((k for k in range(short) if a[k] != b[k]), short)
    back = next((k for k in range(short) if a[-1 - k] != b[-1 - k]), short)
    return front + back >= max(len(a), len(b)) - 1


def without_copied_lines(rows):
    lines = [(i, k, re.findall(r"[^\x20\x09-\x0D]+", x)) for i, t in rows for k, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    gone = set()
    for (i, k, a), (j, m, b) in itertools.combinations(lines, 2):
        if a == b or (len(a) >= 5 and len(b) >= 5 and one_edit(a, b)):
            gone.add((j, m))
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]


def test_pipeline_against_plain_stages(spark):
    table = queries.table(spark, SF, "documents")
    model = langid.Classifier(langid.train(table.where(~langid.held_out())))
    rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    judged = [(i, t, model.predict(t)) for i, t in rows]
    rows = without_copied_lines([(i, t) for i, t, (lang, _, margin, share) in judged if lang != "und" and margin and share >= 0.01])
    groups = plain_groups(rows)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    items = [plain_tokens(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not plain_leaks(t, items)]
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    check_packed(out, {i: plain(t) for i, t in rows}, 0)


def test_stages_keep_the_columns_of_documents(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs.limit(20), SF).dtypes) == dict(docs.dtypes), name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_on_nulls_and_no_rows(spark):
    docs = queries.table(spark, SF, "documents")
    line = "the text of no one at all, and of no great length either"
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (None, line, None, "s", 3), (2, "", None, None, None), (3, line, "fr", "", 9), (3, line, "fr", "", 9)]
    odd = spark.createDataFrame(rows, docs.schema)
    language, lines, near, clean, pack = (stage for _, stage in corpus_pipeline.STAGES)
    both = spark.createDataFrame([*rows[:1], *[(10 + k, f"{w} " * 90, lang, "s", 1) for k, (w, lang) in enumerate([("the house", "en"), ("la maison", "fr")])]], docs.schema)
    assert sorted(r.doc_id for r in language(spark, both, SF).collect()) == [10, 11]
    assert language(spark, odd, SF).where("text is null or text = ''").count() == 0
    texts = sorted((r.doc_id or -1, r.text) for r in lines(spark, odd, SF).where("text is not null").collect())
    assert texts == [(-1, ""), (2, ""), (3, line), (3, line)] and lines(spark, odd, SF).count() == 6
    assert sorted((r.doc_id, r.text) for r in near(spark, odd, SF).collect()) == [(1, None), (3, line), (3, line)]
    assert clean(spark, odd, SF).count() == 6
    assert sorted((r.doc_id or -1, r.length) for r in pack(spark, odd, SF).collect())[:2] == [(-1, 1), (-1, 15)] and pack(spark, odd, SF).count() == 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_batches_of_stages_are_bounded_by_bytes(spark):
    """Thousands of texts don't go to a worker at once; a bound that the session has stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    docs, key = queries.table(spark, SF, "documents").limit(20), corpus_pipeline.BATCH
    wide = spark.range(0, 4000, 1, 1).select(F.expr("repeat('some text ', 400)").alias("text"))
    before = spark.conf.get(key, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, SF)
            if name != "line_dedup":  # no Python there
                assert wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 6 << 20, name
        spark.conf.set(key, "1m")
        corpus_pipeline.pack(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
