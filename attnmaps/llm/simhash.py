"""SimHash near-duplicate groups by pigeonring filtering.

A fingerprint has eight segments of eight bits in a ring. If two fingerprints differ in
at most three bits, then from some segment on every chain of l consecutive segments
differs in at most floor(3 l / 8) bits: none in the first two segments, one at most in
the first five, two in the first seven. Hence two segments and one half of the next three
agree exactly, which gives an equi-join key of 28 bits; the longer chains prune the
candidates of a key before the full Hamming check.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from attnmaps.llm.components import connected_components
from attnmaps.llm.common import fresh, settle

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of one key that are compared in one task; larger keys are cut in blocks.
BLOCK = 4096
_ROWS = 1 << 16


def fingerprint_bytes(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> bytes:
    """SimHash of a whole text, big-endian; zero where the text has no word."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    normal = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxh64_digest(normal, SEED)
    sizes = [len(w) for w in words]
    starts = list(accumulate((n + 1 for n in sizes), initial=0))
    ends = [s + n for s, n in zip(starts, sizes, strict=False)]
    spans = list(zip(starts[: len(words) - words_per_shingle + 1], ends[words_per_shingle - 1 :], strict=True))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _ROWS):
        hashes = b"".join([xxh64_digest(normal[s:e], SEED) for s, e in spans[at : at + _ROWS]])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(spans)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; null texts get zero."""

    def run(batches):
        for batch in batches:
            found = [fingerprint_bytes(x or b"") for x in batch.column(1).to_pylist()]
            values = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _rotated(fp, segment: int):
    return fp if segment == 0 else F.shiftleft(fp, 8 * segment).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * segment))


def ring_keys(fps: DataFrame) -> DataFrame:
    """Sixteen (key, fp) rows of each fingerprint: eight chain starts, two halves each."""
    keys = []
    for start in range(8):
        turned = _rotated(F.col("fp"), start)
        first = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        for half, shift in enumerate((36, 24)):
            part = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(0xFFF))
            keys.append(first.bitwiseOR(part).bitwiseOR(F.lit((2 * start + half) << 28)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _spanning_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A link for each fingerprint but the first of every class within a key's block."""
    if len(fps) == 1:
        return []
    turn = lambda x: x if start == 0 else (x << np.uint64(8 * start)) | (x >> np.uint64(64 - 8 * start))
    left, links = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            turned = turn(left ^ at)
            chain = np.bitwise_count(turned >> np.uint64(24)) <= 1
            chain &= np.bitwise_count(turned >> np.uint64(8)) <= 2
            near = np.zeros(len(left), dtype=bool)
            near[chain] = np.bitwise_count(turned[chain]) <= MAX_BITS
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                frontier.extend(left[near])
                left = left[~near]
    return links


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that join all distinct fingerprints within three bits of each other.

    ``fps`` holds distinct fingerprints. Every class that links would form within a key is
    joined by a spanning forest, so that a key of n fingerprints yields fewer than n
    links. Keys over ``BLOCK`` are cut in blocks and every pair of blocks is a task's work.
    """
    keys = ring_keys(fps)
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    rows = (
        keys.join(counts, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )

    def run(batches):
        held: list[np.ndarray] = []
        held_key = None
        links: list[tuple[int, int]] = []

        def emit():
            us, vs = zip(*links, strict=True)
            both = np.array([us, vs], dtype=np.uint64).astype(np.int64)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

        def close():
            links.extend(_spanning_links(np.concatenate(held), int(held_key[0]) >> 29))

        for batch in batches:
            key, a, b, fp = (batch.column(i).to_numpy() for i in range(4))
            fp = fp.astype(np.uint64)
            new = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for s, e in zip([0, *new], [*new, len(key)], strict=True):
                if s == e:
                    continue
                this = (key[s], a[s], b[s])
                if this != held_key:
                    if held:
                        close()
                    held, held_key = [], this
                held.append(fp[s:e])
            if len(links) > 10_000:
                yield emit()
        if held:
            close()
        if links:
            yield emit()

    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): every row with its fingerprint and its group's smallest id.

    Texts with no word share the fingerprint zero and are linked like any others. Rows
    with a null id belong to their group but never name it (the name is null if all
    ids are). Repeated rows come out as often as they go in. Other columns are not read.
    """
    rows = settle(fingerprints(docs, id_col, text_col))
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    classes = connected_components(near_links(firsts.select("fp")))
    named = firsts.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    groups = named.join(least, "root").select("fp", "component")
    return rows.join(groups, "fp").select("id", "fp", "component")


def fingerprint_hex(fp="fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with one column more, the fingerprint of the row's text."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            values = np.frombuffer(b"".join(fingerprint_bytes(x or b"") for x in texts), dtype=">i8").astype(np.int64)
            yield batch.append_column(name, pa.array(values))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each is the smallest id of its group.

    All rows of that id stay; rows without an id go if their group has one with an id. A group
    with null ids only is kept whole, since no row of it can be told from the others.
    """
    groups = settle(near_duplicate_groups(docs, id_col, text_col))
    first, own = fresh("first"), fresh("fp")
    firsts = groups.where(F.col("id") == F.col("component")).select(F.col("id").alias(first)).distinct()
    nameless = groups.where(F.col("component").isNull()).select(F.col("fp").alias(own)).distinct()
    kept = docs.join(firsts, F.col(id_col).cast("long") == F.col(first), "left_semi")
    unnamed = with_fingerprint(docs.where(F.col(id_col).isNull()), own, text_col).join(nameless, own, "left_semi").drop(own)
    return kept.unionByName(unnamed)
