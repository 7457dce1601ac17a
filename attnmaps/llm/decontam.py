"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters, digits and other characters that aren't ASCII
punctuation or white space. A mask names the positions of a window of tokens that count;
the others may differ. Windows of test items and of documents that agree under
a mask are hits, and around a hit the item is laid along the document: of the
stretches whose substitutions stay within the bound the one with most equal tokens is the
overlap.

The fixed masks miss no overlap of an item of 12 tokens or more. An overlap has S other tokens, S at most
a fourth of its E equal ones, which form S + 1 runs. Unless a run has five tokens (first mask), the
runs lack 4 (S + 1) - E tokens of four each: 4 at most, and with E = 13, S = 3 or fewer tokens
3 at most. Then two neighbouring runs lack at most two between them, and one of the other
masks lies on these. Shorter items have no such pair; their mask is the run of equal tokens
that none of their overlaps lacks, as it is under a rule of other numbers. Items of less than five tokens stand
in texts of all kinds by chance; these are hit by documents that consist of them only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import fresh, settle

#: An overlap counts with so many equal tokens, or with this share of a shorter item, and
#: so many of its tokens equal.
MIN_EQUAL = 13
MIN_SHARE = 0.8
MIN_IDENTITY = 0.8
#: Fixed masks, one for a long run and three for neighbouring runs that are cut by one token.
SPACED = ("11111", "1101111", "1110111", "1111011")
#: Shorter items must be the whole document; they have a seed of all their tokens.
MIN_ITEM = 5
WHOLE = "="
#: Items of so many tokens or more are found by the fixed masks under the rule above.
SPACED_TOKENS = 12
#: The test items' seeds are broadcast up to this number; more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
BROADCAST_BYTES = 64 << 20
_FILTER_BITS = 22

_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) % 2**64 | 1 for k in range(64)], dtype=np.uint64)


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every token of a whole text."""
    from xxhash import xxh64_digest

    words = (text or "").lower().encode().translate(_TABLE).split()
    return np.frombuffer(b"".join(map(xxh64_digest, words)), dtype=">u8").astype(np.uint64)


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash of the counted positions of each window; shorter texts have none.

    Under ``WHOLE`` a text of less than ``MIN_ITEM`` tokens has one seed of all of them.
    """
    if mask == WHOLE:
        if not 0 < len(hashes) < MIN_ITEM:
            return np.zeros(0, dtype=np.uint64)
        return seeds(hashes, "1" * len(hashes), len(_ODD) // 2 + number)
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, _ODD[-1 - number], dtype=np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            total += hashes[k : k + n] * _ODD[k]
    return total ^ (total >> np.uint64(29))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int]:
    """(equal tokens, start, end in the document) of the best stretch along a diagonal.

    Token i of the item lies on token i + shift of the document. Of all stretches with the
    share of equal tokens the one with most of these is best, then the shortest and first.
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[a + shift : b + shift] == item[a:b]
    if not same.any():
        return 0, a + shift, a + shift
    share = Fraction(str(min_identity))
    # a stretch has the share where the gains' sum isn't negative; each end goes with its earliest start
    gains = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    starts = np.searchsorted(-np.minimum.accumulate(gains), -gains)
    count = np.concatenate([[0], np.cumsum(same)])
    places = np.flatnonzero(same)
    equal = count - count[starts]
    ends = np.flatnonzero(equal == equal.max())
    # other tokens at either side go
    firsts, lasts = places[count[starts[ends]]], places[count[ends] - 1] + 1
    k = int(np.argmin(lasts - firsts))
    return int(equal.max()), a + shift + int(firsts[k]), a + shift + int(lasts[k])


def _counts(equal: int, length: int, item: int, min_equal: int, min_share: float, min_identity: float) -> bool:
    return length > 0 and equal >= min(min_equal, min_share * item) and equal >= min_identity * length


@cache
def seed_mask(n: int, min_equal: int = MIN_EQUAL, min_share: float = MIN_SHARE, min_identity: float = MIN_IDENTITY) -> str:
    """Mask of the longest run of equal tokens that every overlap with an item of n tokens has.

    E equal tokens and S others make a run of E / (S + 1) equal ones, rounded up.
    """
    share = Fraction(str(min_identity))
    least = max(1, -int(-min(min_equal, Fraction(str(min_share)) * n) // 1))
    others = lambda e: min(n - e, int(e * (1 - share) / share)) if share else n - e
    return "1" * min((-(-e // (others(e) + 1)) for e in range(least, n + 1)), default=1)


def item_masks(n: int, masks: tuple[str, ...] | None, rule: tuple) -> tuple[str, ...]:
    """The masks for an item of n tokens: given ones, the whole, the fixed ones, or a run."""
    if masks:
        return masks
    if n < MIN_ITEM:
        return (WHOLE,)
    return SPACED if n >= SPACED_TOKENS and rule == (MIN_EQUAL, MIN_SHARE, MIN_IDENTITY) else (seed_mask(n, *rule),)


def best_overlap(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, rule: tuple) -> tuple[int, int, int] | None:
    """(equal tokens, start, end) of the best overlap along the ascending shifts, if any counts.

    Most equal tokens come first, then the least shift. Equal tokens of all shifts are counted
    at once; a shift that can't be better is not looked at further.
    """
    n, least = len(item), min(rule[0], rule[1] * len(item))
    found: list[tuple[int, int]] = []
    beside = np.full(n, np.bitwise_xor.reduce(np.unique(item)) ^ np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
    padded = np.concatenate([beside, doc, beside])
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)
    step = max(1, (1 << 20) // n)
    for at in range(0, len(shifts), step):
        part = shifts[at : at + step]
        equal = (windows[part + n] == item).sum(axis=1)
        able = equal >= least
        found += zip((-equal[able]).tolist(), part[able].tolist(), strict=True)
    best = None
    for most, shift in sorted(found):
        if best and (-most < best[0] or -most == best[0] and shift > best[1]):
            continue
        equal, start, end = overlap(doc, item, shift, rule[2])
        if _counts(equal, end - start, n, *rule) and (best is None or (-equal, shift) < (-best[0], best[1])):
            best = (equal, shift, start, end)
    return best and (best[0], best[2], best[3])


class SeedIndex:
    """Seeds of the test items, sorted, behind a bit filter."""

    def __init__(self, items: list[str], masks: tuple[str, ...] | None, rule: tuple):
        self.rule, self.tokens = rule, [token_hashes(x) for x in items]
        own = [item_masks(len(t), masks, rule) for t in self.tokens]
        self.masks = sorted(set().union(*own))
        found = [(seeds(t, m, self.masks.index(m)), i) for i, (t, ms) in enumerate(zip(self.tokens, own, strict=True)) for m in ms]
        hashes = np.concatenate([s for s, _ in found]) if found else np.zeros(0, dtype=np.uint64)
        owner = np.concatenate([np.full(len(s), i) for s, i in found]) if found else np.zeros(0, dtype=int)
        place = np.concatenate([np.arange(len(s)) for s, _ in found]) if found else np.zeros(0, dtype=int)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def shifts(self, doc: np.ndarray) -> dict[int, np.ndarray]:
        """Ascending shifts of every item that a seed of the document hits.

        Places of one seed are taken together, so text that repeats costs a step for
        each place in an item and not for each pair of places.
        """
        found: dict[int, list[np.ndarray]] = {}
        for k, mask in enumerate(self.masks):
            own = seeds(doc, mask, k)
            hits = np.flatnonzero(self.filter[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(hits):
                continue
            order = hits[np.argsort(own[hits], kind="stable")]
            values, starts = np.unique(own[order], return_index=True)
            first, last = (np.searchsorted(self.hashes, values, side=x) for x in ("left", "right"))
            ends = np.append(starts[1:], len(order))
            for v in np.flatnonzero(first < last):
                places = order[starts[v] : ends[v]]
                for j in range(first[v], last[v]):
                    found.setdefault(int(self.owner[j]), []).append(places - self.place[j])
        return {i: _distinct(x) for i, x in found.items()}

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(number of the item, equal tokens, start, end) of every item that overlaps."""
        best = ((i, best_overlap(doc, self.tokens[i], shifts, self.rule)) for i, shifts in sorted(self.shifts(doc).items()))
        return [(i, *x) for i, x in best if x]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values of many arrays, by marks, since each may hold most of them."""
    if len(parts) == 1:
        return np.unique(parts[0])
    least = min(int(x.min()) for x in parts)
    marks = np.zeros(max(int(x.max()) for x in parts) - least + 1, dtype=bool)
    for x in parts:
        marks[x - least] = True
    return np.flatnonzero(marks) + least


_FOUND = "item_id long, n_equal long, start long, end long"


def _record(rows: list[tuple], own: pa.DataType, name: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [own, *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[name, "item_id", "n_equal", "start", "end"])


def _by_item(hits: list[tuple[int, int, int, int]], ids: list[int | None]) -> list[tuple]:
    """(item id, equal, start, end): the best of the texts that share an item's id."""
    best: dict[int | None, tuple[int, int, int]] = {}
    for i, equal, start, end in hits:
        if ids[i] not in best or (-equal, start, end) < (-best[ids[i]][0], *best[ids[i]][1:]):
            best[ids[i]] = (equal, start, end)
    return [(k, *x) for k, x in best.items()]


class _Searcher:
    """The items on every executor: an index made once a task."""

    def __init__(self, docs: DataFrame, items: DataFrame, masks: tuple[str, ...] | None, rule: tuple):
        rows = [tuple(r) for r in items.orderBy("item_id", "text").collect()]
        self.shared, self.masks, self.rule = docs.sparkSession.sparkContext.broadcast(rows), masks, rule

    def open(self):
        ids, index = [i for i, _ in self.shared.value], SeedIndex([t for _, t in self.shared.value], self.masks, self.rule)
        return lambda text: _by_item(index.search(token_hashes(text)), ids)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def _fit_broadcast(items: DataFrame, masks: tuple[str, ...] | None, most: int) -> bool:
    """Whether the items' seeds are few enough for every executor; the results don't depend on it."""
    size = items.agg(F.sum(F.size(F.split("text", r"\W+"))).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return (size["n"] or 0) * len(masks or SPACED) <= most and (size["b"] or 0) <= BROADCAST_BYTES


def _text_key(text):
    return F.md5(text.cast("binary"))


class _Text:
    """A document's tokens, and its seeds under each mask in order, made when first asked for."""

    def __init__(self, text: str, every: list[str]):
        self.tokens, self.every, self.sorted = token_hashes(text), every, {}

    def best(self, item: np.ndarray, masks: tuple[str, ...], rule: tuple) -> tuple[int, int, int] | None:
        """(equal tokens, start, end) of the best overlap with an item, if any counts."""
        found = []
        for mask in masks:
            number = self.every.index(mask)
            if mask not in self.sorted:
                own = seeds(self.tokens, mask, number)
                order = np.argsort(own, kind="stable")
                self.sorted[mask] = own[order], order
            values, order = self.sorted[mask]
            asked = seeds(item, mask, number)
            first, last = (np.searchsorted(values, asked, side=x) for x in ("left", "right"))
            found += [order[first[k] : last[k]] - k for k in np.flatnonzero(first < last)]
        return best_overlap(self.tokens, item, _distinct(found), rule) if found else None


def _by_shuffle(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] | None, rule: tuple) -> DataFrame:
    """(key, item_id, n_equal, start, end) by text, for test sets of any size.

    Distinct seeds of the texts and of the items are joined; a seed that very many texts have is
    split by the join. Every text that is hit then travels once, with the tokens of
    the items that hit it behind it, and its own seeds are made once.
    """

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [token_hashes(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(">u8").tobytes() for x in found], pa.binary())], names=["item_key", "item_id", "item"])

    tests = items.select(_text_key(F.concat_ws("\n", "item_id", "text")).alias("item_key"), "item_id", "text").mapInArrow(tokens, "item_key string, item_id long, item binary")
    sizes = [] if masks else tests.select((F.octet_length("item") / 8).cast("int").alias("n")).distinct().collect()  # at most a row for each length
    every = sorted(set(masks or ()).union(*[item_masks(r["n"], masks, rule) for r in sizes]))

    def emit(whole: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, data in zip(batch.column(0), batch.column(1), strict=True):
                    found = token_hashes(data.as_py()) if whole else np.frombuffer(data.as_py(), dtype=">u8").astype(np.uint64)
                    parts = [seeds(found, m, every.index(m)) for m in (every if whole else item_masks(len(found), masks, rule))]
                    hashes = np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
                    for at in range(0, len(hashes), 50_000):
                        part = hashes[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(part), pa.string()), pa.array(part)], names=["key", "seed"])

        return run

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            rows = []
            for own, text, item_id, item in zip(*(batch.column(c) for c in ("key", "text", "item_id", "item")), strict=True):
                if text.is_valid:
                    held, key = _Text(text.as_py(), every), own.as_py()
                elif own.as_py() == key:
                    asked = np.frombuffer(item.as_py(), dtype=">u8").astype(np.uint64)
                    best = held.best(asked, item_masks(len(asked), masks, rule), rule)
                    rows += [(key, item_id.as_py(), *best)] if best else []
            yield _record(rows, pa.string(), "key")

    texts = docs.select(_text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    theirs = tests.select("item_key", "item").mapInArrow(emit(False), "key string, seed long").withColumnRenamed("key", "item_key")
    pairs = settle(texts.mapInArrow(emit(True), "key string, seed long").join(theirs, "seed").select("key", "item_key").distinct())
    asked = pairs.join(tests, "item_key").select("key", F.lit(1).alias("side"), F.lit(None).cast("string").alias("text"), "item_id", "item")
    hit = texts.join(pairs.select("key").distinct(), "key", "left_semi")
    rows = hit.select("key", F.lit(0).alias("side"), "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("binary").alias("item")).unionAll(asked)
    laid = rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(verify, f"key string, {_FOUND}")
    best = F.min(F.struct((-F.col("n_equal")).alias("n"), "start", "end")).alias("x")
    return laid.groupBy("key", "item_id").agg(best).select("key", "item_id", (-F.col("x.n")).alias("n_equal"), "x.start", "x.end")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    masks: tuple[str, ...] | None = None,
    min_equal: int = MIN_EQUAL,
    min_share: float = MIN_SHARE,
    min_identity: float = MIN_IDENTITY,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(id, item_id, n_equal, start, end): every row of docs and test item that overlap.

    ``start`` and ``end`` count the document's tokens. Null or empty texts and items
    overlap with nothing, and items of less than ``MIN_ITEM`` tokens only with documents
    that are the same tokens. Without ``masks`` every overlap under the rule is found; given ones
    find what agrees under them, and nothing of items shorter than these. Rows that repeat an
    id or have none are judged by their own texts, a row of the result each. Items that
    share an id, or have none, are one item, of which the best overlap counts.
    """
    rule = (min_equal, min_share, min_identity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    items = _items(benchmark)
    if not _fit_broadcast(items, masks, broadcast_seeds):
        found = _by_shuffle(rows, items, masks, rule)
        return rows.select("id", _text_key(F.col("text")).alias("key")).join(found, "key").select("id", "item_id", "n_equal", "start", "end")
    searcher = _Searcher(docs, items, masks, rule)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher.open()
        for batch in batches:
            hits = [(i, *hit) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in search(x.as_py())]
            yield _record(hits, pa.int64(), "id")

    return rows.mapInArrow(run, f"id long, {_FOUND}")


def contamination(found: DataFrame) -> DataFrame:
    """(id, n_items, item_id, n_equal): each overlapping document, its items and the worst.

    Rows that share an id, or have none, are one document here.
    """
    rows = found.groupBy("id", "item_id").agg(F.max("n_equal").alias("n_equal"))
    worst = F.max(F.struct("n_equal", (-F.col("item_id")).alias("i"))).alias("worst")
    rows = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_items"), worst)
    return rows.select("id", "n_items", (-F.col("worst.i")).alias("item_id"), F.col("worst.n_equal").alias("n_equal"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of docs that overlap with no test item, with their own columns.

    Every row is judged by its own text, whatever its id, in the pass that keeps it;
    beyond the broadcast bound the texts that overlap are joined by their hash.
    """
    rule, items = (MIN_EQUAL, MIN_SHARE, MIN_IDENTITY), _items(benchmark)
    if not _fit_broadcast(items, None, broadcast_seeds):
        bad = _by_shuffle(docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")), items, None, rule)
        own = fresh("key")
        return docs.join(bad.select(F.col("key").alias(own)).distinct(), _text_key(F.col(text_col)) == F.col(own), "left_anti")
    searcher, at = _Searcher(docs, items, None, rule), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher.open()
        for batch in batches:
            yield batch.filter(pa.array([not search(x.as_py()) for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
