"""Line dedup, SimHash groups and decontamination against brute force."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F
from test_overlap_rule import plain_leaks, plain_tokens

from attnmaps.llm import decontam, linededup, queries, simhash
from attnmaps.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs(spark, *rows, extra=False):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    return df.selectExpr("*", "1 AS fp", "2 AS words", "3 AS _lines", "4 AS id", "5 AS key") if extra else df


# --- line dedup ------------------------------------------------------------------------


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows):
    lines = [(i, k, re.findall(r"[^\x20\x09-\x0D]+", x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    gone = set()
    for (i, k, a), (j, m, b) in itertools.permutations(lines, 2):
        near = a == b or (len(a) >= 5 and len(b) >= 5 and word_edits(a, b) <= 1)
        if a and b and near and (j, m) < (i, k):
            gone.add((i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


@pytest.mark.parametrize("broadcast_rows", [linededup.BROADCAST_ROWS, 0])
def test_line_dedup_against_brute_force(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(1)
    base = [list(rng.choice(WORDS, n)) for n in (1, 2, 4, 5, 6, 8, 12, 20, 21, 40, 70)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.integers(1, 6)):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(len(words))
                match rng.integers(3):
                    case 0:
                        words[at] = str(rng.choice(WORDS[:4]))
                    case 1:
                        words.insert(at, str(rng.choice(WORDS[:4])))
                    case 2 if len(words) > 1:
                        words.pop(at)
            lines.append(str(rng.choice([" ", "  ", "\t"])).join(words))
        rows.append((i, "\n".join(lines)))
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, *rows, extra=True)).collect()}
    assert found == brute_lines(rows)


def test_line_dedup_edges(spark):
    long = " ".join(WORDS)
    rows = [(1, long + "\n\n" + "a b"), (2, None), (3, ""), (4, "a b\n" + long), (5, "\n"), (None, long), (6, "w " * 3000 + "x")]
    out = linededup.dedup_lines(docs(spark, *rows))
    found = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()}
    assert found[1][0] == rows[0][1] and found[2] == (None, 0, 0) and found[3] == ("", 1, 0)
    assert found[4] == ("", 2, 2) and found[5] == ("\n", 2, 0) and found[None] == ("", 1, 1)
    same = linededup.dedup_lines(docs(spark, (1, long), (1, long))).collect()
    assert [r["text"] for r in same] == [long, long]
    assert linededup.dedup_lines(docs(spark, (1, "x")).limit(0)).count() == 0


def test_very_long_lines_and_clashing_counts(spark):
    words = [f"w{k}" for k in range(100_000)]
    other = [*words[:70_000], "other", *words[70_001:]]
    rows = docs(spark, (1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:50_000] + words[50_001:])), (4, "same " * 60_000), (5, "same " * 60_001), (6, "x" * 200_000), (7, "x" * 200_000))
    out = linededup.dedup_lines(rows.withColumn("_n_lines", F.lit("own")))
    assert out.columns == [*rows.columns, "_n_lines", "__n_lines", "_n_dropped"]
    assert {r["doc_id"]: (r["_n_lines"], r["__n_lines"], r["_n_dropped"]) for r in out.collect()} == {k: ("own", 1, int(k not in (1, 4, 6))) for k in range(1, 8)}


def test_line_dedup_query_against_sql(spark):
    compare(spark, connect(SF), SF, queries.QUERIES["op1_line_dedup"], queries.ORACLES["op1_line_dedup"])


# --- SimHash ---------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_groups(ids, fps):
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            root[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(top(k), []).append(ids[k])
    return {i: min(g) for g in groups.values() for i in g}


def test_simhash_query_against_brute_force(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups(ids, fps)
    found = queries.op6_simhash_groups(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{f:016x}", groups[i]) for i, f in zip(ids, fps, strict=True)}


@pytest.mark.parametrize("block", [4096, 4])
def test_links_join_all_near_fingerprints(spark, block, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(30):
            s ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(s)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", block)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    ours = {}
    for k, f in enumerate(signed):
        ours.setdefault(roots.get(f, f), set()).add(k)
    theirs = {}
    for k, g in brute_groups(list(range(len(fps))), fps).items():
        theirs.setdefault(g, set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_edges(spark):
    text = "one two three four five six seven"
    rows = docs(spark, (5, text), (3, text.upper()), (None, text), (7, None), (8, ""), (9, " \n"), (5, text), (10, "x y"), extra=True)
    found = sorted((r.id or -1, r.component, r.fp) for r in simhash.near_duplicate_groups(rows).collect())
    assert [(a, b) for a, b, _ in found] == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 7), (10, 10)]
    assert [f for a, _, f in found if a in (7, 8, 9)] == [0, 0, 0]
    kept = simhash.keep_first(rows)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 10] and kept.columns == rows.columns
    assert simhash.near_duplicate_groups(rows.limit(0)).count() == 0
    other = "eight nine ten eleven twelve thirteen fourteen"
    mixed = simhash.keep_first(docs(spark, (1, text), (None, text), (None, other), (None, other))).collect()
    assert sorted((r.doc_id or -1, r.text) for r in mixed) == [(-1, other), (-1, other), (1, text)]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {roots[k] for k in range(1, 61)} == {1} and {roots[k] for k in range(100, 160)} == {100}


# --- decontamination --------------------------------------------------------------------


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix a strange new potion in silence".split()


def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def changed(*places):
    return " ".join("other" if k in places else w for k, w in enumerate(ITEM))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SEEDS, 0])
def test_decontamination_tolerates_substitutions(spark, limit):
    around = "words before " * 30
    rows = docs(
        spark, (1, around + " ".join(ITEM) + " after"), (2, around + changed(4) + "."), (3, around + changed(3, 9)), (4, around + " ".join(ITEM[:6])),
        (5, around), (6, None), (7, ""), (None, " ".join(ITEM)), (8, around + changed(*range(0, 19, 2))), (9, " ".join(ITEM).upper().replace(" ", ", ")), extra=True,
    )
    items = bench(spark, (1, " ".join(ITEM)), (2, None), (3, ""), (4, "too short"))
    found = decontam.overlaps(rows, items, broadcast_seeds=limit)
    assert {(r.id, r.item_id, r.n_equal) for r in found.collect()} == {(1, 1, 19), (2, 1, 18), (3, 1, 17), (9, 1, 19), (None, 1, 19)}
    assert decontam.overlaps(rows.limit(0), items, broadcast_seeds=limit).count() == 0
    assert decontam.overlaps(rows, items.limit(0), broadcast_seeds=limit).count() == 0


def test_clean_documents_stay(spark):
    rows = docs(spark, (1, "so " + " ".join(ITEM)), (2, "nothing here"), (None, " ".join(ITEM)), (3, None), extra=True)
    kept = decontam.keep_clean(rows, bench(spark, (1, " ".join(ITEM))))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [2, 3] and kept.columns == rows.columns


def test_seeds_ignore_their_free_places():
    a, b = decontam.token_hashes(changed()), decontam.token_hashes(changed(3))
    assert decontam.seeds(a, "11101011", 0)[0] == decontam.seeds(b, "11101011", 0)[0]
    assert decontam.seeds(a, "11011101", 1)[0] != decontam.seeds(b, "11011101", 1)[0]
    assert len(decontam.seeds(a[:7], "11011101", 1)) == 0


def test_decontamination_query_against_brute_force(spark):
    """All aligned stretches of every pair, without seeds."""
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    items = [plain_tokens(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in rows if plain_leaks(r[1], items)}
    assert {r.doc_id for r in queries.op10_decontamination(spark, SF).collect()} == hit and hit
