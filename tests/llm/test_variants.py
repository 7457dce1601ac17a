"""Spelling variants against SQL and against comparing all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from attnmaps.llm import queries, variants
from attnmaps.llm.variants import FmIndex

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def made_up(seed, n, letters="abé", least=1, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàéü" * 4])
def test_index_finds_words_with_an_equal_ending(seed, letters):
    known, asked = made_up(seed, 120, letters), made_up(seed + 100, 60, letters) + ["ab", "zzzq"]
    asked = sorted({*asked, *known[:40]})
    index = FmIndex(known)
    assert index.words == known
    for part in (0, 1, 2):
        exact = [min(len(w), part if part < 2 else len(w) - len(w) // 2) for w in asked]
        a, b = index.within_one(asked, np.array(exact))
        found = {(asked[i], known[j]) for i, j in zip(a.tolist(), b.tolist())}
        expected = {(w, v) for w, e in zip(asked, exact) for v in known if one_edit(w, v) and len(v) >= e and w[len(w) - e :] == v[len(v) - e :] and one_edit(w[: len(w) - e], v[: len(v) - e])}
        assert found == expected


def test_wide_intervals_and_nothing():
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = [a + b + c for a in letters for b in letters for c in "xy"]
    a, b = FmIndex(known).within_one(["abx", "axxy", "é"], np.array([1, 1, 0]))
    index = FmIndex(known)
    assert {index.words[k] for k, i in zip(b, a) if i == 0} == {w for w in known if one_edit("abx", w) and w[-1] == "x"}
    assert {index.words[k] for k, i in zip(b, a) if i == 1} == {w for w in known if one_edit("axxy", w) and w[-1] == "y"} and not (a == 2).any()
    assert all(len(x) == 0 for x in FmIndex([]).within_one(["ab"], np.array([1]))) and all(len(x) == 0 for x in index.within_one([], np.array([], dtype=int)))


def plain(counts, times=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def found(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [3, 50, 20_000])
def test_all_pairs(spark, shard):
    rng = random.Random(5)
    counts = {w: rng.choice([1, 2, 4, 8, 16, 32, 64]) for w in made_up(7, 400, "abc", 1, 7) + ["q" * 300, "q" * 301, "q" * 302]}
    counts |= {"samehalf" + x + y: 3 for x in "abcdefg" for y in "abc"}  # one half of many words
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert found(variants.variants(words, shard=shard)) == sorted(plain(counts), key=str)


def test_query_against_sql(spark):
    assert compare(spark, connect(SF), SF, queries.QUERIES["op12_spelling_variants"], queries.ORACLES["op12_spelling_variants"]) > 1000


def test_words_of_the_contract(spark):
    rows = [(k, "Straße ÉCOLE colour-Colour colouring naïve×÷ abcd", 0) for k in range(1, 300)]
    docs = spark.createDataFrame([*rows, (None, "colours " * 3, 0), (7, None, 0), (8, "", 0), (1, "colour", 0)], "doc_id long, text string, word int")
    counts = Counter()
    for key, text, _ in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    words = variants.counted_words(docs)
    assert {r.word: r.n for r in words.collect()} == expected and expected["colours"] >= 3
    assert found(variants.variants(words)) == sorted(plain(expected), key=str)


def test_edges(spark):
    words = spark.createDataFrame([("aaaaa", 1), ("aaaaa", 2), (None, 9), ("aaaab", 6), ("", 1)], "word string, n long").withColumn("key", F.lit(1))
    assert found(variants.variants(words)) == sorted([("aaaaa", 3, 1, "aaaab", 6, "aaaab"), ("aaaab", 6, 1, None, None, "aaaab"), ("", 1, 0, None, None, "")], key=str)
    assert variants.variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.variants(words, times=1)
