"""Near-duplicate lines over a whole corpus, by a deletion-neighbourhood join.

A line is its sequence of words. Lines of ``FUZZY_WORDS`` words or more have an edit bound of
one word (inserted, deleted or substituted), shorter ones must be equal, down to lines of
one word, which may be a whole sentence where no spaces are written. A line is
dropped if an earlier line, by document id and line number, lies within the bound; the
earliest of every such pair thus stays. Built-in DataFrame functions only.

Two lines are within one edit if and only if they are equal, or equal after deletion of one
word at the same place of each, or one is the other after a deletion. So every
line emits its deletion variants as hashed keys, made of the hashes of what stands before
and after a place, and the earliest line of each key is the partner of all others
there: groups are reduced to minima and no pairs within a group are formed. The edit
distance of a line and its partner is then verified word by word. Before that, lines are left out that can have no partner: one edit leaves the
first or the second half of a line as it is, and a line whose halves occur nowhere else
is alone. Work is linear in a line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import bound, fresh, running, settle_table

#: Lines of fewer words are never touched; blank lines are none.
MIN_WORDS = 1
#: Lines of so many words or more may differ by one word, a fifth of them at most.
FUZZY_WORDS = 5
#: A side of a join is broadcast up to so many rows (of at most 48 bytes), else shuffled.
BROADCAST_ROWS = 400_000

#: Columns that the result adds, with more underscores in front where the caller has such columns.
COUNTS = ("_n_lines", "_n_dropped")

_NULL_ID = "9223372036854775808"


def normal_line(line: Column) -> Column:
    """The line with its words one space apart; most lines are so already."""
    words = F.array_remove(F.split(line, r"[\x09-\x0D\x20]+"), "")
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | line.rlike(r"[\x09-\x0D]")
    return F.when(odd, F.array_join(words, " ")).otherwise(line)


def _word_count(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _position(doc_id: Column, line_no: Column) -> Column:
    """Order of lines in the corpus; documents without an id come last."""
    at = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(_NULL_ID).cast("decimal(20,0)"))
    return (at * F.lit(1 << 32).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def corpus_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, version, line_no, pos, line, n, h1, h2) of every line that takes part.

    ``version`` tells rows apart that share an id; ``line`` is normal, ``n`` its number of
    words and (h1, h2) its 128-bit hash.
    """
    lines = F.transform(F.split(text_col, "\n"), normal_line)
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), _word_count(x).alias("n")))
    # all once for each document; the outer form keeps Spark from computing the array for a filter too
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), counted.alias("lines"))
    rows = whole.select("id", "version", F.posexplode_outer("lines").alias("line_no", "x")).select("id", "version", "line_no", "x.line", "x.n").where(F.col("n") >= min_words)
    return rows.select("id", "version", "line_no", _position(F.col("id"), F.col("line_no")).alias("pos"), "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the halves that a line shares with any line within one edit of it.

    The first is of a front half, the second of a back half, the third of a front half for
    even numbers of words and of a back half for odd ones.
    """
    front = lambda c: F.xxhash64(F.lit(0), c, F.call_function("substring_index", line, F.lit(" "), c))
    back = lambda c: F.xxhash64(F.lit(1), c, F.call_function("substring_index", line, F.lit(" "), -c))
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # halves for partners of n words and more, then of n - 1 words; two of the four are equal
    return [front(half), back(n - half), F.when(n % 2 == 0, front(less)).otherwise(back(n - 1 - less))]


def _with_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a settled side that is broadcast if its row count is within the bound."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether the word arrays differ by at most one word inserted, deleted or replaced."""
    short = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: F.when(v.eqNullSafe(w), 1).otherwise(0)), 0)
    run = lambda x, y: F.when(same(x, y) == 0, short).otherwise(F.least(short, (same(x, y) - 1).cast("int")))
    return run(a, b) + run(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def variants(texts: DataFrame) -> DataFrame:
    """(h1, h2, pos, key, gap): hashed keys of every deletion variant of a line.

    A key is made of a place and of the words before and after it. Rows with ``gap`` false
    leave out the word at that place; rows with ``gap`` true stand for the line itself
    as some longer line's variant there, and come from lines with partners of other lengths.
    """
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    # an edit in the front half leaves the back half shared, and the other way round
    first = F.when(F.col("back"), 0).otherwise(F.floor((F.col("n") - 1) / 2)).cast("int")
    last = F.when(F.col("front"), F.col("n")).otherwise(F.floor(F.col("n") / 2)).cast("int")

    def keys(before: Column, after: Column) -> Column:
        key = lambda i, rest: F.xxhash64(i, F.get(before, i), F.get(after, rest))
        places = F.sequence(first, F.least(last, F.col("n") - 1))
        deleted = F.transform(places, lambda i: F.struct(key(i, F.col("n") - 1 - i).alias("key"), F.lit(False).alias("gap")))
        gaps = F.transform(F.sequence(first, last), lambda i: F.struct(key(i, F.col("n") - i).alias("key"), F.lit(True).alias("gap")))
        return F.when(F.col("mixed"), F.concat(deleted, gaps)).otherwise(deleted)

    both = lambda w: F.struct(running(w, F.xxhash64).alias("before"), running(F.reverse(w), F.xxhash64).alias("after"))
    found = bound(hashes, lambda w: bound(both(w), lambda x: keys(x["before"], x["after"])))
    return texts.select("h1", "h2", "pos", F.inline_outer(found))


def near_partners(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, best): position of the earliest line within one edit, where it is earlier."""
    sides = [F.struct(F.col(f"k{i}").alias("key"), front.alias("front")) for i, front in ((1, F.lit(True)), (2, F.lit(False)), (3, F.col("n") % 2 == 0))]
    keys = distinct.where("k1 is not null").select(F.inline(F.array(*sides)), "h1", "h2", "pos", "n")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = settle_table(counts.where("lines > 1").select("key", (F.col("low") < F.col("high")).alias("mixed")), "line-keys")
    alive = _with_small(keys, shared, ["key"]).groupBy("h1", "h2", "pos").agg(F.max("mixed").alias("mixed"), F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))
    alive = settle_table(alive, "line-alive")
    found = _with_small(lines.select("h1", "h2", "pos", "line", "n"), alive, ["h1", "h2", "pos"])
    # rows that repeat a document repeat a line's first place
    texts = settle_table(found, "line-texts").dropDuplicates(["h1", "h2"])

    rows = settle_table(variants(texts), "line-variants")
    first = lambda gap: F.min(F.when(F.col("gap") == gap, F.col("pos")))
    groups = rows.groupBy("key").agg(first(False).alias("deleted"), first(True).alias("whole"), F.count(F.lit(1)).alias("lines"))
    groups = settle_table(groups.where("lines > 1 and deleted is not null").drop("lines"), "line-groups")
    best = F.when(F.col("gap"), F.col("deleted")).otherwise(F.least("deleted", "whole"))
    pairs = settle_table(_with_small(rows, groups, ["key"]).select("h1", "h2", "pos", best.alias("best")).where("best < pos").distinct(), "line-pairs")

    theirs = texts.select(F.col("pos").alias("best"), F.col("line").alias("their_line"))
    checked = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(theirs, "best")
    near = _within_one_edit(F.split("line", " "), F.split("their_line", " "))
    return checked.where(near).groupBy("h1", "h2").agg(F.min("best").alias("best"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """(id, version, lines): numbers of the lines to drop from each document that has any."""
    lines = corpus_lines(docs, id_col, text_col, min_words)
    halves = [F.when(F.col("n") >= fuzzy_words, k).alias(f"k{i + 1}") for i, k in enumerate(_half_keys(F.col("line"), F.col("n")))]
    places = settle_table(lines.select("id", "version", "line_no", "n", "h1", "h2", *halves), "line-places")
    places = places.withColumn("pos", _position(F.col("id"), F.col("line_no")))
    firsts = [F.min(f"k{i}").alias(f"k{i}") for i in (1, 2, 3)]
    distinct = settle_table(places.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.min("n").alias("n"), *firsts), "lines")
    near = near_partners(distinct, lines)
    copied = distinct.where("last > pos").select("h1", "h2", F.col("pos").alias("best"))
    hits = settle_table(copied.unionAll(near).groupBy("h1", "h2").agg(F.min("best").alias("best")), "line-hits")
    found = _with_small(places.select("id", "version", "line_no", "pos", "h1", "h2"), hits, ["h1", "h2"]).where("pos > best")
    return found.groupBy("id", "version").agg(F.collect_set("line_no").alias("lines"))


def count_names(columns: list[str]) -> list[str]:
    """Names of the two counts that none of the columns has."""
    names = []
    for name in COUNTS:
        while name in columns:
            name = "_" + name
        names.append(name)
    return names


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """docs with its own columns, the text without its dropped lines, and two counts.

    Added are ``_n_lines`` and ``_n_dropped`` (see ``COUNTS``). All rows stay, in any number of columns:
    null texts stay null with no lines, and a text may end up empty. Rows that repeat an id
    hold their lines at the same positions, of which none is earlier, so they don't drop
    each other's. Documents with null ids count as the last ones. Blank lines stay.
    """
    known = {name: fresh(name) for name in ("id", "version", "lines")}
    dropped = dropped_lines(docs, id_col, text_col, min_words, fuzzy_words).withColumnsRenamed(known)
    gone, own = F.col(known["lines"]), fresh("text_hash")
    same = F.col(own).eqNullSafe(F.col(known["version"])) & F.col(id_col).cast("long").eqNullSafe(F.col(known["id"]))
    rows = docs.withColumn(own, F.xxhash64(text_col)).join(dropped.hint("shuffle_hash"), same, "left")  # texts needn't be sorted
    # a column of its own, so that texts are split once and not for every line
    held = fresh("split")
    rows, lines = rows.withColumn(held, F.split(text_col, "\n")), F.col(held)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    counts = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)), F.when(gone.isNull(), 0).otherwise(F.size(gone))]
    names = count_names(docs.columns)
    return rows.select(*[text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns], *[c.cast("long").alias(x) for c, x in zip(counts, names, strict=True)])
