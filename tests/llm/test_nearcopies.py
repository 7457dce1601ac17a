"""Near copies of the pipeline against the plain definition of their similarity."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from attnmaps.llm import nearcopies, queries

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(500)]


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Smallest id of each document's group, by comparing all pairs."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            u, v = sorted((top(i), top(j)))
            root[v] = u
    return {i: top(i) for i, _ in rows}


def planted(rng):
    rows = []
    for k in range(40):
        words = list(rng.choice(WORDS, rng.integers(3, 300)))
        for _ in range(rng.integers(1, 6)):
            copy = list(words)
            for _ in range(rng.integers(0, 1 + len(words) // 30)):
                copy[rng.integers(len(copy))] = str(rng.choice(WORDS))
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("firsts", [nearcopies.FIRSTS, 0])
def test_planted_near_copies(spark, firsts, monkeypatch):
    monkeypatch.setattr(nearcopies, "FIRSTS", firsts)  # without firsts, rarest shingles find what lies beyond three bits
    rows = planted(np.random.default_rng(3))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    groups = plain_groups(rows)
    unlike = {i for i, t in rows if groups[i] != i and t != dict(rows)[groups[i]]}
    assert len(unlike) > 20
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {i for i, _ in rows if groups[i] == i}


def test_near_copies_of_documents(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    groups = plain_groups(rows)
    assert kept == {i for i, _ in rows if groups[i] == i}
    assert not {2, 56} <= kept


def test_rows_without_ids_or_words(spark):
    rows = [(None, "only here", None, None, None), (1, "a b", None, None, None), (None, "A  b", None, None, None), (2, " ", None, None, None), (3, None, None, None, None)]
    kept = nearcopies.keep_first(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "only here"), (1, "a b"), (2, " ")]
    assert nearcopies.keep_first(spark.createDataFrame([], DOC)).count() == 0


def texts_of(spark, rows):
    docs = spark.createDataFrame(rows, "fp long, text string")
    return docs, nearcopies.settle(nearcopies.sketches(docs))


def test_rarest_shingles_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    common = list(rng.choice(WORDS, 60))
    rows = []
    for k in range(120):
        words = common[: rng.integers(20, 61)] + list(rng.choice(WORDS, rng.integers(0, 30)))
        rows += [(len(rows) + j, " ".join(w if rng.random() > 0.02 * j else "x" for w in words)) for j in range(2)]
    docs = spark.createDataFrame(rows, "fp long, text string")
    classes = docs.select(nearcopies.F.col("fp").alias("node"), nearcopies.F.col("fp").alias("root"))
    left = docs.select(nearcopies.F.col("fp").alias("root_u"), nearcopies.F.lit(0).cast("long").alias("root_v"))
    found = {(r.u, r.v) for r in nearcopies.verified(nearcopies.rest_pairs(left, classes, docs), docs).collect()}
    sets = [plain_set(t) for _, t in rows]
    near = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert found == near and len(near) > 40


def test_boilerplate_costs_no_comparisons(spark):
    """Three quarters in common and a quarter of its own: no two are near, and none is compared."""
    common = " ".join(WORDS[:75])
    rows = [(k, common + " " + " ".join(f"own{k}x{j}" for j in range(25)), None, None, None) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOC)
    texts = docs.selectExpr("doc_id as fp", "text")
    classes = texts.selectExpr("fp as node", "fp as root")
    assert nearcopies.rest_pairs(texts.selectExpr("fp as root_u", "cast(0 as long) as root_v"), classes, texts).count() == 0
    assert nearcopies.keep_first(docs).count() == 3000


def test_links_by_source(spark):
    """What each source of candidates finds among the documents, and that all of them are needed."""
    docs = queries.table(spark, SF, "documents").where("text is not null").dropDuplicates(["text"]).selectExpr("doc_id as fp", "text")
    rows = {r.fp: plain_set(r.text) for r in docs.collect()}
    near = {(i, j) for i, j in itertools.combinations(sorted(rows), 2) if rows[i] and len(rows[i] & rows[j]) >= 0.8 * len(rows[i] | rows[j])}
    found = nearcopies.settle(nearcopies.sketches(docs))
    pairs = lambda df: {tuple(sorted((r.u, r.v))) for r in df.collect()} & near
    ring, bands = pairs(nearcopies.close_pairs(found)), pairs(nearcopies.band_pairs(found))
    every = docs.selectExpr("fp as root_u", "cast(0 as long) as root_v")
    rare = pairs(nearcopies.rest_pairs(every, docs.selectExpr("fp as node", "fp as root"), docs))
    assert rare == near and len(ring | bands) >= 0.9 * len(near)
    assert 0 < len(ring) < len(near)  # within three bits lie the closest only
