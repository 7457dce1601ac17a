"""SimHash near-dedup at a similarity: pigeonring links first, MinHash bands for what lies beyond.

A text is the set of its shingles of five words. Two texts are near if their sets' Jaccard
similarity is 0.8 or more, and groups are the components of these links. Every link is
verified on the shingles themselves. Candidates come in two rounds, of which the first is linear in
the number of texts:

1. texts whose SimHash fingerprints lie within three bits, by the pigeonring keys of
   :mod:`attnmaps.llm.simhash`, and texts that share a band of a MinHash sketch, each against
   the first texts of its bands, those that share the most bands with it;
2. where these links leave a band's texts in several classes, the texts of these classes by their
   rarest shingles: similar texts have one in common among their first ones.

Fingerprints alone would not do: texts of similarity 0.8 lie about 10 of 64 bits apart, often
15, and keys for bounds that wide hold unlike texts too. The bands miss a pair of similarity s
with probability (1 - s ** ROWS) ** BANDS, 7e-5 at 0.8 and less beyond.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.llm import simhash
from attnmaps.llm.common import fresh, settle, settle_table
from attnmaps.llm.components import connected_components

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SEED = 42
#: First texts that a text is compared with.
FIRSTS = 3
_STEP = 2048

_DRAWN = np.random.default_rng(SEED)
_FACTORS = _DRAWN.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAWN.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_MIX = _DRAWN.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _DRAWN.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingles(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; shorter texts are one shingle, wordless ones none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    normal = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxh64_intdigest(normal, SEED)], dtype=np.uint64)
    sizes = [len(w) for w in words]
    starts = list(accumulate((n + 1 for n in sizes), initial=0))
    hashes = [xxh64_intdigest(normal[s : e - 1], SEED) for s, e in zip(starts, starts[words_per_shingle:], strict=False)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of empty ones is one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band of the set's MinHash sketch."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        turned = hashes[at : at + _STEP, None] * _FACTORS + _SHIFTS
        np.minimum(least, turned.min(axis=0), out=least)
    mixed = least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(31))
    keys = (mixed * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    return keys ^ (keys >> np.uint64(29))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed number; zero if it is empty."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def sketches(texts: DataFrame) -> DataFrame:
    """(fp, keys, print) of rows (fp, text): band keys and SimHash of the text's shingles."""

    def run(batches):
        for batch in batches:
            sets = [shingles(x.as_py() or b"") for x in batch.column(1)]
            found = [band_keys(x) for x in sets]
            values = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            keys = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([fingerprint(x) for x in sets], pa.int64())], names=["fp", "keys", "print"])

    return texts.select("fp", F.col("text").cast("binary")).mapInArrow(run, "fp long, keys array<long>, print long")


def close_pairs(found: DataFrame) -> DataFrame:
    """(u, v): texts of one fingerprint with their first, and the firsts of fingerprints within three bits."""
    firsts = settle(found.groupBy("print").agg(F.min("fp").alias("first")))
    same = found.join(firsts, "print").select(F.col("fp").alias("u"), F.col("first").alias("v")).where("u <> v")
    links = simhash.near_links(firsts.select(F.col("print").alias("fp")))
    ends = [firsts.select(F.col("print").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv"]
    return same.unionAll(links.join(ends[0], "u").join(ends[1], "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))).distinct()


def band_pairs(found: DataFrame) -> DataFrame:
    """(u, v, shared): every text with the first text of each of its bands, and the number of these bands."""
    keyed = found.select("fp", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(least, "key").select(F.col("fp").alias("u"), "v").where("u <> v")
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """The pairs (u, v) of similar texts."""

    def run(batches):
        last, theirs = None, None
        for batch in batches:
            links = []
            for u, v, a, b in zip(*(batch.column(i) for i in range(4)), strict=True):
                if v.as_py() != last:
                    last, theirs = v.as_py(), shingles(b.as_py())
                own = shingles(a.as_py())
                if min(len(own), len(theirs)) >= least * max(len(own), len(theirs)) and similarity(own, theirs) >= least:
                    links.append((u.as_py(), last))
            us, vs = zip(*links, strict=True) if links else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    ends = [texts.select(F.col("fp").alias(x), F.col("text").cast("binary").alias(f"text_{x}")) for x in "uv"]
    return pairs.join(ends[0], "u").join(ends[1], "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def classes_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every node, from links (u, v) between nodes or roots (u, v)."""
    roots = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    return settle(nodes.join(roots, "root", "left").select("node", F.coalesce("joined", "root").alias("root")))


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, root_u, root_v) of the pairs that lie in two classes."""
    ends = [classes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    return pairs.join(ends[0], "u").join(ends[1], "v").where("root_u <> root_v").select("u", "v", "root_u", "root_v")


def ordered_sets(texts: DataFrame) -> DataFrame:
    """(fp, class, n, ordered): every text's shingles that others have as (count, token), the rarest first."""

    def run(batches):
        for batch in batches:
            sets = [shingles(x.as_py() or b"") for x in batch.column(2)]
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            tokens = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["fp", "class", "tokens"])

    sets = texts.select("fp", "class", F.col("text").cast("binary")).mapInArrow(run, "fp long, class long, tokens array<long>")
    sets = settle_table(sets, "near-sets")
    rows = sets.select("fp", F.explode("tokens").alias("token"))  # narrow: most tokens have one text only
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = rows.join(counts, "token").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("ordered"))
    return sets.select("fp", "class", F.size("tokens").alias("n")).join(shared, "fp")


def rest_pairs(left: DataFrame, classes: DataFrame, texts: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """(u, v): pairs of texts in different classes, among all those that ``left`` puts together, that may be similar.

    The shingles of a text are a ring without a common beginning, so they are put in one order for
    all, the rarest first. Similar texts have a shingle in common among their first ones, as many
    as may be missing and one more. At the first one in common, what comes behind it must
    suffice for the overlap. Texts with enough shingles of their own, as where
    they share boilerplate only, have no such first ones in common with any and cost no comparison.
    """
    some = left.select(F.explode(F.array("root_u", "root_v")).alias("class")).distinct()
    rows = classes.select(F.col("node").alias("fp"), F.col("root").alias("class")).join(some, "class").join(texts, "fp")
    own = F.col("n") - F.size("ordered")  # shingles that no other text has come first
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    heads = ordered_sets(rows).withColumn("own", own).where(own < first)
    index = heads.select("fp", "class", "n", "own", F.posexplode(F.slice("ordered", F.lit(1), (first - F.col("own")).cast("int"))).alias("at", "x"))
    index = index.select(F.col("x.token").alias("token"), "fp", "class", "n", (F.col("n") - F.col("own") - F.col("at")).alias("behind"))
    a, b = (index.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "class", "n", "behind")]) for x in "uv")
    enough = F.least("behind_u", "behind_v") * (1 + least) >= least * (F.col("n_u") + F.col("n_v")) - 1e-6
    sizes = F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v") - 1e-9
    met = a.join(b, "token").where((F.col("fp_u") < F.col("fp_v")) & (F.col("class_u") != F.col("class_v")) & enough & sizes)
    return met.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")).distinct()


def near_classes(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root): the class of every text that has a candidate, from rows (fp, text) and (fp, keys, print).

    Rows of one ``fp`` hold the same text.
    """
    bands = settle(band_pairs(found))
    best = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), "v"))  # at most BANDS rows of a text
    pairs = bands.withColumn("rank", best).where(F.col("rank") <= FIRSTS).select("u", "v")
    pairs = settle(pairs.unionAll(close_pairs(found)).distinct())
    nodes = pairs.unionAll(bands.select("u", "v")).select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    known = settle_table(texts.groupBy("fp").agg(F.first("text").alias("text")).join(nodes, "fp"), "near-texts")
    classes = classes_of(known.select(F.col("fp").alias("node"), F.col("fp").alias("root")), verified(pairs, known))
    left = settle(apart(bands, classes))
    if left.isEmpty():
        return classes
    links = verified(settle(rest_pairs(left, classes, known)), known)
    return classes_of(classes, apart(links, classes).select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, component): every distinct text's hash and its group's smallest id.

    Null texts and texts with no word are one group. Null ids never name a group; the name
    is null if all ids are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    found = settle_table(sketches(rows).dropDuplicates(["fp"]), "near-sketches")
    classes = near_classes(rows.select("fp", "text"), found)
    named = firsts.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least, "root").select("fp", "first", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each is the smallest id of its group.

    All rows of that id stay. A group with null ids only is kept whole, since no
    row of it can be told from the others.
    """
    groups = settle(near_copy_groups(docs, id_col, text_col))
    own = fresh("first")
    firsts = groups.where("first = component").select(F.col("first").alias(own)).distinct()
    kept = docs.join(firsts, F.col(id_col).cast("long") == F.col(own), "left_semi")
    nameless = groups.where("component is null").select(F.col("fp").alias(own))
    if nameless.isEmpty():
        return kept
    unnamed = docs.where(F.col(id_col).isNull()).join(nameless, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own), "left_semi")
    return kept.unionByName(unnamed)
