"""Decontamination against the stated rule, counted token by token."""

import itertools
import re

import numpy as np
import pytest

from attnmaps.llm import decontam

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def most_equal(doc, item):
    """Equal tokens of the best stretch of any diagonal of which four fifths are equal."""
    best = 0
    for shift in range(1 - len(item), len(doc)):
        marks = [doc[i + shift] == x for i, x in enumerate(item) if 0 <= i + shift < len(doc)]
        for s in range(len(marks)):
            for e in range(s + 1, len(marks) + 1):
                equal = sum(marks[s:e])
                if 5 * equal >= 4 * (e - s):
                    best = max(best, equal)
    return best


def leaks(doc, item):
    if len(item) < 5:
        return bool(item) and doc == item
    return bool(item) and most_equal(doc, item) >= min(13, 0.8 * len(item))


def plain_tokens(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def plain_leaks(text, items):
    """Whether a text overlaps with one of many items (lists of tokens), without seeds."""
    doc = plain_tokens(text)
    known, whole = set(doc), np.array(doc, dtype=object)
    for item in items:
        least = min(13, 0.8 * len(item))
        if 0 < len(item) < 5 and doc == item:
            return True
        if len(item) < 5 or sum(x in known for x in item) < least:
            continue
        own = np.array(item, dtype=object)
        for shift in range(1 - len(item), len(doc)):
            a, b = max(0, -shift), min(len(item), len(doc) - shift)
            marks = (whole[a + shift : b + shift] == own[a:b]).tolist()
            if sum(marks) >= least:
                sums = [0, *itertools.accumulate(marks)]
                if any(sums[e] - sums[s] >= least and 5 * (sums[e] - sums[s]) >= 4 * (e - s) for s in range(len(marks)) for e in range(s + 1, len(marks) + 1)):
                    return True
    return False


@pytest.mark.parametrize("n", range(12, 20))
def test_fixed_masks_miss_no_overlap(n):
    """Every row of equal and other tokens that an overlap of an item of n tokens can be."""
    rows = np.arange(1 << n, dtype=np.uint32)
    equal = np.bitwise_count(rows)
    span = np.array([int(r).bit_length() - ((int(r) & -int(r)).bit_length() - 1) if r else 0 for r in rows[1::2]])  # odd rows start with an equal token
    rows, equal = rows[1::2], equal[1::2]
    able = rows[(equal >= min(13, 0.8 * n)) & (5 * equal.astype(int) >= 4 * span)]
    hit = np.zeros(len(able), dtype=bool)
    for mask in decontam.SPACED:
        for at in range(n - len(mask) + 1):
            own = np.uint32(int(mask, 2) << at)
            hit |= (able & own) == own
    assert len(able) and hit.all()


def test_one_repeated_word_takes_no_long_time(spark):
    item = ["same"] * 400
    docs = spark.createDataFrame([(1, "same " * 100_000), (2, "same " * 5 + "x " * 100_000), (None, "other " * 50_000 + "same " * 400)], DOC)
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join([*item[:300], "x", *item[:99]]))], ITEM)
    found = sorted((r.id or -1, r.item_id, r.n_equal, r.start) for r in decontam.overlaps(docs, items).collect())
    assert found == [(-1, 7, 400, 50_000), (-1, 8, 399, 50_000), (1, 7, 400, 0), (1, 8, 399, 0)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_rows_of_one_id_and_of_none(spark, limit):
    item = [f"t{k}" for k in range(20)]
    whole, part = " ".join(item), " ".join(item[:14])
    rows = [(1, whole), (1, whole), (1, "clean"), (None, part), (None, "clean"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS key", "2 AS item_id", "3 AS id")
    items = spark.createDataFrame([(5, whole), (5, " ".join(item[:16])), (None, whole), (None, " ".join(item[3:])), (None, None), (6, "")], ITEM).selectExpr("*", "1 AS key")
    found = sorted((r.id or -1, r.item_id or -1, r.n_equal, r.start, r.end) for r in decontam.overlaps(docs, items, broadcast_seeds=limit).collect())
    assert found == sorted([(1, 5, 20, 0, 20), (1, -1, 20, 0, 20)] * 2 + [(-1, 5, 14, 0, 14), (-1, -1, 14, 0, 14)])
    kept = decontam.keep_clean(docs, items, broadcast_seeds=limit)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in kept.where("text is not null").collect()) == [(-1, "clean"), (1, "clean"), (3, "")] and kept.count() == 4
    worst = {r.id: (r.n_items, r.item_id, r.n_equal) for r in decontam.contamination(decontam.overlaps(docs, items, broadcast_seeds=limit)).collect()}
    assert worst == {1: (2, 5, 20), None: (2, 5, 14)}


@pytest.mark.parametrize("n, gone, equal", [(18, (8, 9), 16), (27, (12, 13, 14), 24), (16, (7, 8), 14), (5, (2,), 4), (7, (3,), 6), (15, (3, 7, 11), 12)])
@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_clustered_substitutions(spark, n, gone, equal, limit):
    item = [f"t{k}" for k in range(n)]
    text = "some words before " + " ".join("other" if k in gone else w for k, w in enumerate(item)) + " and after"
    docs, items = spark.createDataFrame([(1, text), (2, "nothing of it")], DOC), spark.createDataFrame([(7, " ".join(item))], ITEM)
    found = decontam.overlaps(docs, items, broadcast_seeds=limit).collect()
    assert [tuple(r) for r in found] == [(1, 7, equal, 3, 3 + n)]
    assert [r.doc_id for r in decontam.keep_clean(docs, items).collect()] == [2]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_random_substitutions_against_the_rule(spark, limit):
    rng = np.random.default_rng(5)
    items = [[f"w{x}" for x in rng.integers(0, 30, n)] for n in range(1, 31)]
    docs = []
    for item in items * 4:
        at = int(rng.integers(0, len(item)))
        part = item[at // 4 :]
        marks = rng.random(len(part)) < rng.choice([0.0, 0.1, 0.2, 0.3])
        docs.append([f"x{rng.integers(9)}" for _ in range(5)] + [f"y{k}" if m else w for k, (m, w) in enumerate(zip(marks, part, strict=True))])
    want = {(i, j) for i, d in enumerate(docs) for j, x in enumerate(items) if leaks(d, x)}
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], DOC)
    found = decontam.overlaps(rows, spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], ITEM), broadcast_seeds=limit)
    assert {(r.id, r.item_id) for r in found.collect()} == want and len(want) > 60


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_items_of_few_words_are_no_passages(spark, limit):
    items = spark.createDataFrame([(1, "yes"), (2, "The house"), (3, "one two three four"), (4, "a b c d e")], ITEM)
    rows = [(1, "Yes, it was a long day"), (2, "we went into the house"), (3, "yes!"), (4, "the House"), (5, "house the"), (6, "one two three four five"), (7, "x a b c d e y"), (8, "yes yes"), (9, "One two, three four")]
    docs = spark.createDataFrame(rows, DOC)
    found = {(r.id, r.item_id, r.n_equal, r.start, r.end) for r in decontam.overlaps(docs, items, broadcast_seeds=limit).collect()}
    assert found == {(3, 1, 1, 0, 1), (4, 2, 2, 0, 2), (7, 4, 5, 1, 6), (9, 3, 4, 0, 4)}
    assert {r.doc_id for r in decontam.keep_clean(docs, items, broadcast_seeds=limit).collect()} == {1, 2, 5, 6, 8}


def test_a_seed_in_every_document(spark):
    """Every document begins with five tokens of many items; few overlap, and no task has them all."""
    rows = [(k, "all rights reserved by the " + (" ".join(f"t{k % 7}x{j}" for j in range(14)) if k % 100 == 0 else f"owner {k} of this page")) for k in range(4000)]
    items = [(i, "all rights reserved by the " + " ".join(f"t{i}x{j}" for j in range(14))) for i in range(7)]
    docs, tests = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(items, ITEM)
    wide, narrow = (sorted(tuple(r) for r in decontam.overlaps(docs, tests, broadcast_seeds=n).collect()) for n in (0, decontam.BROADCAST_SEEDS))
    assert wide == narrow and {r[0] for r in wide} == set(range(0, 4000, 100))
