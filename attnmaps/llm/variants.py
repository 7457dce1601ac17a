"""Spelling variants: words within one edit, and the frequent form of each.

Near words are sought in full-text indexes of the vocabulary. An edit spares one half of a
word, so there are two searches: the first half is matched exactly, then the search goes on to the right
over the second with one error; or the second half exactly, then to the left over the
first. Each goes one way only, so it needs the suffix-rank interval of one index: that of the delimited words
for the way to the left, and that of the words reversed for the way to the right.

The vocabulary is dealt out by halves: a word is indexed under the halves that words of its
own length, one less and one more would look for, four at most, and looks under its own two. A shard
holds the words of some thousands of halves; a half of very many words is
a grid of lots of its own, so that no task grows with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import settle_table

#: Index rows that a shard or a lot has, about.
SHARD = 20_000
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many pairs of a document and a run loses a character (a stand-in for misspellings).
TYPO_EVERY = 97
#: The form of a word is at least so many times as frequent.
TIMES = 2
#: Widths up to which an interval's symbols are looked up one by one.
NARROW = 64
DELIMITER = "\0"


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of so many code points and occurrences, from the maximal runs of Latin letters.

    A-Z are lower-cased. A run whose hash with the document's id is a multiple of
    ``typo_every`` loses a character (0: none does). Null texts have no words; a null id
    counts as an empty string in the hash.
    """
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(rf"[a-zÀ-ÿ]{{{max(1, min_length)},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    word = F.col("run")
    if typo_every:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % typo_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class FmIndex:
    """Full-text index of distinct words, each behind a delimiter, as a sorted table of last symbols.

    Rows are the suffixes in order; the first ones begin with a delimiter, one for each
    word in order. A step to the left from the rows [low, high) by a symbol is two look-ups of
    (symbol, row) among the sorted pairs of the symbols before all suffixes and their rows.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        n = len(self.words)
        points = np.frombuffer((DELIMITER + DELIMITER.join(self.words)).encode("utf-32-le"), dtype="<u4") if n else np.zeros(0, dtype="<u4")
        self.alphabet, codes = np.unique(points, return_inverse=True)
        size = len(codes)
        self.size = size + 1
        order = self._suffixes(codes, n)
        self.before = codes[order - 1]  # the text is taken as a ring
        self.keys = np.sort(self.before.astype(np.int64) * self.size + np.arange(size))

    @staticmethod
    def _suffixes(codes: np.ndarray, n: int) -> np.ndarray:
        """Places of the suffixes in order, by doubling; delimiters are ordered by place, as the words are."""
        rank = codes.astype(np.int64) + n
        rank[codes == 0] = np.arange(n)
        step, size = 1, len(codes)
        while True:
            key = rank * (size + n + len(codes) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if size else np.zeros(0, dtype=np.int64)
            rank = np.empty(size, dtype=np.int64)
            rank[order] = new
            if not size or new[-1] == size - 1:
                return order
            step *= 2

    def codes_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words in a row, start of each word); symbols not in the index get one that nothing matches."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, max(0, len(self.alphabet) - 1))] == points if len(self.alphabet) else np.zeros(len(points), dtype=bool)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        return np.where(known, at, len(self.alphabet)), starts

    def left(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol.astype(np.int64) * self.size
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, low, high) of every step to the left by a letter that some interval has."""
        width, sigma = high - low, len(self.alphabet)
        few = np.flatnonzero((width > 0) & (width <= NARROW))
        state = np.repeat(few, width[few])
        row = np.arange(len(state)) - np.repeat(np.cumsum(width[few]) - width[few], width[few]) + low[state]
        some = np.unique(state * sigma + self.before[row])
        many = np.flatnonzero(width > NARROW)
        every = (many[:, None] * sigma + np.arange(sigma)).ravel()
        state, symbol = np.divmod(np.concatenate([some, every]), sigma)
        state, symbol = state[symbol > 0], symbol[symbol > 0]
        lo, hi = self.left(low[state], high[state], symbol)
        on = hi > lo
        return state[on], symbol[on], lo[on], hi[on]

    def within_one(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked word, number of the indexed word) at one edit exactly.

        The last ``exact`` characters of an asked word match as they are; the error is in
        the rest, which is read to the left. All words go on together, a symbol at a time.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(words) or not self.words:
            return none, none
        flat, starts = self.codes_of(words)
        length = np.diff(starts)
        flat = np.concatenate([flat, [0]])
        at = lambda q, t: flat[np.where(t < length[q], starts[q + 1] - 1 - t, len(flat) - 1)]  # noqa: E731  a delimiter ends the word
        q = np.arange(len(words))
        low, high = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(self.words), dtype=np.int64)
        for t in range(int(exact.max())):
            on = np.flatnonzero((exact[q] > t) & (high > low))
            low[on], high[on] = self.left(low[on], high[on], at(q[on], np.full(len(on), t)))
        free = [q, exact.astype(np.int64), low, high]
        bound = [none] * 4
        found = []
        while len(free[0]) or len(bound[0]):
            free, bound = ([x[s[3] > s[2]] for x in s] for s in (free, bound))
            # those with an error match on, and end at the delimiter
            q, t, low, high = bound
            whole = t == length[q]
            low, high = self.left(low, high, at(q, t))
            over = whole & (high > low)
            found.append((np.repeat(q[over], (high - low)[over]), np.concatenate([none, *(np.arange(a, b) for a, b in zip(low[over], high[over], strict=True))])))
            onward = [x[~whole] for x in (q, t + 1, low, high)]
            # those without one match, or spend it; in a run of equal letters, at its end
            q, t, low, high = free
            open_ = t < length[q]
            symbol = at(q, t)
            lo, hi = self.left(low[open_], high[open_], symbol[open_])
            state, other, clo, chi = self.children(low, high)
            differs = other != symbol[state]
            inserted = differs
            replaced = differs & open_[state]
            skipped = open_ & (symbol != at(q, t + 1))
            bound = [
                np.concatenate(x)
                for x in (
                    (onward[0], q[state][inserted], q[state][replaced], q[skipped]),
                    (onward[1], t[state][inserted], t[state][replaced] + 1, t[skipped] + 1),
                    (onward[2], clo[inserted], clo[replaced], low[skipped]),
                    (onward[3], chi[inserted], chi[replaced], high[skipped]),
                )
            ]
            free = [q[open_], t[open_] + 1, lo, hi]
        pairs = np.unique(np.concatenate([a * len(self.words) + b for a, b in found] or [none]))
        return np.divmod(pairs, len(self.words))


def _halves(lengths: list[Column], word: Column) -> list[Column]:
    """Keys of a word: its beginnings and endings that are halves of words of the lengths."""
    first = [F.concat(F.lit("<"), F.substring(word, F.lit(1), F.floor(n / 2).cast("int"))) for n in lengths]
    last = []
    for n in lengths:
        k = F.floor((n + 1) / 2).cast("int")
        last.append(F.concat(F.lit(">"), F.when(k > 0, F.substring(word, F.greatest(F.length(word) - k + 1, F.lit(1)), k)).otherwise("")))
    return first + last


def _search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best) of a shard's asked words with a near one in it."""
    found = []
    for side, turn in (("<", -1), (">", 1)):
        rows = known[known["side"] == side].drop_duplicates("word")
        words = sorted(set(asked.loc[asked["side"] == side, "word"]))
        if rows.empty or not words:
            continue
        index = FmIndex([w[::turn] for w in rows["word"]])
        half = np.array([len(w) // 2 if side == "<" else len(w) - len(w) // 2 for w in words])
        a, b = index.within_one([w[::turn] for w in words], half)
        theirs = [index.words[k][::turn] for k in b.tolist()]
        pairs = pd.DataFrame({"word": [words[k] for k in a.tolist()], "best": theirs})
        if side == ">":  # the other search has those with an equal first half
            pairs = pairs[np.array([x[: len(x) // 2] != y[: len(x) // 2] for x, y in zip(pairs["word"], pairs["best"], strict=True)], dtype=bool)]
        found.append(pairs.merge(rows.rename(columns={"word": "best", "n": "best_n"})[["best", "best_n"]], on="best"))
    both = pd.concat(found) if found else pd.DataFrame({"word": [], "best": [], "best_n": []})
    best = both.sort_values(["word", "best_n", "best"], ascending=[True, False, True])
    out = best.groupby("word", sort=False).agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")).reset_index()
    return out[["word", "n_near", "best_n", "best"]].astype({"word": object, "best": object})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): how many words are at one edit, and the most frequent of these.

    ``words`` has distinct words and their n. Of equally frequent ones the first in code-point
    order is best. Words without a near one have no row.
    """
    size = F.length("word")
    listed = words.select("word", "n", F.explode(F.array_distinct(F.array(*_halves([size - 1, size, size + 1], F.col("word"))))).alias("key"))
    asked = words.select("word", F.explode(F.array(*_halves([size], F.col("word")))).alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    total = words.count()
    large = sizes.where(F.col("_size") > shard).select("key", F.ceil(F.col("_size") / shard).cast("int").alias("_lots"))
    shards = max(1, -(-4 * total // shard))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row in its shard, or in all cells of its lot where its key has lots."""
        lots = F.coalesce("_lots", F.lit(1))
        rows = rows.join(large, "key", "left").withColumns({own: F.pmod(F.xxhash64("word"), lots), "_other": F.explode(F.sequence(F.lit(0), lots - 1))}).withColumnRenamed("_other", other)
        cell = F.when(F.col("_lots").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string")).otherwise(F.concat_ws("|", "key", F.col("_i").cast("string"), F.col("_j").cast("string")))
        return rows.select(cell.alias("cell"), F.substring("key", 1, 1).alias("side"), *[F.col(c).alias(c) for c in ("word", "n") if c in rows.columns])  # column ids of its own, for the cogroup

    ours, theirs = dealt(asked, "_j", "_i"), dealt(listed, "_i", "_j")
    found = ours.groupBy("cell").cogroup(theirs.groupBy("cell")).applyInPandas(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain, found by jumping twice as far each round.

    Forms are more frequent than their words by a factor, so chains have no rings and
    are short. Each round is written to the shared folder; the driver sees a count.
    """
    at = settle_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = settle_table(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = jumped.select("word", "root")
        if not jumped.where("_moved").limit(1).count():
            return at


def variants(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a table (word, n).

    The form is the most frequent near word, if it is at least ``times`` (two or more) as frequent as
    the word, else null; the root is where following the forms ends. Null words are left
    out, and repeated ones counted together.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent, else chains may be rings")
    words = settle_table(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    better = F.col("best_n") >= times * F.col("n")
    found = words.join(near_words(words, shard), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")
    )
    found = settle_table(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
