"""Language identification by compression.

A model is one raw-content zstandard dictionary for each language, cut from a bounded
sample of labelled texts. A text belongs to the language whose dictionary
compresses it into the fewest bytes. Texts are lower-cased and compressed whole, in chunks
of ``CHUNK`` bytes, each against the fresh dictionary, so that a long text doesn't become its own
dictionary. Margins that are narrow for the compressed size are rejected: on texts of a language
that no dictionary is of, the best of the others wins by little.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Texts of each language that are drawn, on average; characters of each that go into
#: the dictionary; bytes of a dictionary.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 1024
DICTIONARY_BYTES = 64 * 1024
#: A language label takes part if it is among so many most frequent ones.
MAX_LANGUAGES = 200
LEVEL = 6
CHUNK = 8192
#: The best language must win by so large a share of its compressed size, and a byte at least.
MIN_MARGIN = 0.01


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the labelled texts.

    Rows with a null language or no text take no part. Distinct texts are drawn by their
    hash, about ``SAMPLE_TEXTS`` of each language come to the driver and one at least, so
    that the sample's size doesn't depend on the table's or on copies.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and length(text) > 0")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = rows.withColumn("draw", draw)
    # distinct texts, by an estimate within a few hundredths; the least draw is always in
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("draw", 0.02).alias("n"), F.min("draw").alias("least"))
    counts = {r["lang"]: max(SAMPLE_TEXTS / r["n"], r["least"]) for r in sizes.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    some = rows.where(F.col("draw") <= F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(-1.0)))
    # pieces from the middle as well as from the start, chosen by the draw
    start = F.floor(F.col("draw") * 7919 % 1 * F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    pieces = some.select("lang", "draw", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("piece"))
    found = pieces.groupBy("lang", "draw").agg(F.min("piece").alias("piece")).collect()
    texts: dict[str, bytearray] = {lang: bytearray() for lang in sorted(counts)}
    for row in sorted(found, key=lambda r: (r["lang"], r["draw"])):
        own = texts[row["lang"]]
        if len(own) < DICTIONARY_BYTES:
            own += row["piece"].lower().encode() + b"\n"
    return {lang: bytes(x[:DICTIONARY_BYTES]) for lang, x in texts.items() if len(x) >= 8}


class Classifier:
    """Compressed sizes of texts by language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as zstd

        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            own = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.compressors.append(zstd.ZstdCompressor(level=level, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        chunks = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, int, float]:
        """(language, score, margin in bytes, margin as a share); ``und`` and zeros where there is no letter.

        The score is the best language's share if every byte more halves a
        language's weight. Equal sizes go to the first language by name.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        rest = sorted(sizes)[1:]
        score = 1.0 / sum(2.0 ** -min(60, s - best) for s in sizes)
        margin = rest[0] - best if rest else best
        return self.languages[sizes.index(best)], score, margin, margin / best


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row's whole text.

    ``rejected`` is true where the text has no letter (or is null), or where the
    best language's margin is no byte or less than ``min_margin`` of its size. Null ids and repeated rows stay
    as they are; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES a language at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            langs, scores, margins, shares = ([r[k] for r in found] for k in range(4))
            rejected = [not (lang != UNKNOWN and margin and share >= min_margin) for lang, margin, share in zip(langs, margins, shares, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array(rejected, pa.bool_())],
                names=["id", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, margin long, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 1 by 3; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs that aren't rejected, with their own columns.

    The text is judged row by row in the pass that keeps it, so there is no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(at)]
            keep = [lang != UNKNOWN and margin > 0 and share >= min_margin for lang, _, margin, share in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
