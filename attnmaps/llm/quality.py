"""Quality rules by compression bands.

The ratio of a text's bytes to its zstandard bytes is high where the text repeats itself
and near one where it is noise. It also grows with length, so every length band has
limits of its own. The whole document must lie within its band, and so must most of its
fixed chunks, which shows a repetitive or noisy part of an otherwise normal text. What
is left after the last full chunk is judged within a window that ends with the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK = 4096
#: (bytes from, least ratio, greatest ratio). Prose of a few languages keeps well within.
BANDS = (
    (0, 0.0, 1.3),
    (64, 0.6, 1.6),
    (128, 0.8, 2.2),
    (256, 1.0, 2.4),
    (512, 1.15, 2.6),
    (1024, 1.25, 2.8),
    (2048, 1.35, 3.2),
    (8192, 1.5, 3.8),
    (32768, 1.6, 4.5),
)
#: Share of a document's chunks, the last window among them, that may lie outside the band of their length.
BAD_CHUNKS = 0.3
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_NOT_SYMBOLS = bytes(c for c in range(256) if chr(c) not in SYMBOLS)
_TRAILS = bytes(range(0x80, 0xC0))


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    words = text.split()
    n = len(words)
    normal = b" ".join(words)
    chars = len(normal.translate(None, _TRAILS)) - max(0, n - 1)
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= WINDOW:
        sizes = [len(w) for w in words]
        starts = list(accumulate((k + 1 for k in sizes), initial=0))
        windows = [normal[s : e - 1] for s, e in zip(starts, starts[WINDOW:], strict=False)]
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return n, chars, symbols, dup_lines, repeated


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """(least, greatest) ratio for a text of so many bytes."""
    return next((low, high) for start, low, high in reversed(bands) if size >= start)


class Compression:
    """Ratios of whole documents and chunks, and the verdict on them."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        self.bands, self.chunk, self.bad_chunks = bands, chunk, bad_chunks

    def judge(self, text: bytes) -> tuple[float, int, int, bool]:
        """(ratio of the whole, chunks, those outside their band, verdict).

        A text of a chunk's size or less is judged as a whole only.
        """
        ratio = len(text) / len(self.compress(text))
        low, high = band(len(text), self.bands)
        starts = list(range(0, len(text) - self.chunk + 1, self.chunk))
        if starts and len(text) % self.chunk:
            starts.append(len(text) - self.chunk)
        least, most = band(self.chunk, self.bands)
        bad = 0
        for at in starts if len(starts) > 1 else []:
            own = self.chunk / len(self.compress(text[at : at + self.chunk]))
            bad += not least <= own <= most
        return ratio, len(starts), bad, low <= ratio <= high and bad <= self.bad_chunks * len(starts)


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, min_words: int = 10, max_repeat: int = 20
) -> DataFrame:
    """Statistics, compression ratios and verdict of every row.

    A null text has no words and fails, like any text under ``min_words`` words or with
    over ``max_repeat`` percent of its words in repeated windows. Rows with null ids and
    repeated rows come out as they are; no other column is read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compression(bands, chunk, bad_chunks)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or b""
                n, chars, symbols, dups, repeated = text_stats(text)
                ratio, chunks, bad, fine = own.judge(text)
                failed = n < min_words or 100 * repeated > max_repeat * n
                rows.append((n, chars, symbols, dups, repeated, failed, fine and not failed, ratio, chunks, bad))
            columns = [list(c) for c in zip(*rows, strict=True)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
            names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio n_chunks n_bad_chunks".split()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(
        run,
        "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long",
    )
