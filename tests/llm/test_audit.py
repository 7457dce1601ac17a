"""Filter audit against SQL and against applying filters one after the other."""

import re
from itertools import permutations

import numpy as np
from oracle import compare, connect
from pyspark.sql import functions as F

from attnmaps.llm import audit, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, mask int"
LABEL = "doc_id long, quality int, toxic int"


def test_query_against_sql(spark):
    assert compare(spark, connect(SF), SF, queries.QUERIES["op13_filter_audit"], queries.ORACLES["op13_filter_audit"]) == 2400


def test_gray_walk_against_every_subset():
    counts = np.random.default_rng(0).integers(0, 1000, (32, 3))
    states = audit.gray_walk(counts)
    for subset in range(32):
        assert (states[subset] == sum(counts[m] for m in range(32) if not m & subset)).all()


def plain(docs, labels):
    """Rows of every part, order and step, by taking documents away one filter after the other."""
    def fails(key, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(o is not None and (key is None or o < key) for o, t, _ in docs if (t or "") == text)
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": smaller,
        }

    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out = set()
    for part in {lang or "" for _, _, lang in docs}:
        own = [(k, fails(k, t or "")) for k, t, lang in docs if (lang or "") == part]
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                rows.append((
                    "".join(order), step, len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ))
        total = {f: sum(r[3] for r in rows if r[0][r[1] - 1] == f) for f in "ABCDE"}
        out |= {(part, *r, total[r[0][r[1] - 1]]) for r in rows}
    return out


def test_plain_removal_and_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "de"), (None, None, "en"), (None, None, ""), (4, "", "en"),
        (5, "LOUD " * 200, "en"), (6, "a b $", "fr"), (7, "a " * 300_000, "fr"), (8, " ".join("ab"), "fr"), (1, long, "de"), (9, "LOUD " * 200, "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1), (9, 1, 0), (77, 1, 1)]
    df = spark.createDataFrame([(*r, 0) for r in docs], DOC).repartition(3)
    found = audit.audit(df, spark.createDataFrame(labels, LABEL))
    assert {tuple(r) for r in found.collect()} == plain(docs, labels)
    assert audit.audit(df.limit(0), spark.createDataFrame([], LABEL)).count() == 0


def test_own_filters(spark):
    df = spark.createDataFrame([(1, "ab", "x", 0), (2, None, "x", 0), (3, "ab", "x", 0)], DOC)
    fails = {"short": F.length("text") < 3, "null": F.col("text").isNull()}
    found = audit.audit(df, spark.createDataFrame([], LABEL), fails, duplicate="copy").collect()
    assert len(found) == 6 * 3
    row = next(r for r in found if r.filter_order == "shortnullcopy" and r.step == 1)
    assert (row.kept, row.removed, row.unique_fails) == (1, 2, 1)
