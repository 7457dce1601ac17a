"""Byte-level BPE by a rank file: encoding with spans of characters, and decoding.

A rank file lists byte strings and their ids, which are also the priorities of merges. The
tokenizers library works on characters, so every byte gets a printable one, and every
way to put an entry together from two others becomes a merge of the entry's priority.
Decoding reverses the table of bytes; a character's bytes may lie in several
tokens, so tokens are put together before characters are read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.tokens import ID_TYPE, PieceEncoder, _byte_letters

#: Bytes of text or ids after which a batch of results is handed on.
BATCH_BYTES = 4 << 20


class RankCodec(PieceEncoder):
    """Ids of texts by a rank file, and texts of ids.

    A matched piece that is an entry is that entry; others are merged from bytes, the entry of
    the lowest rank first. Pieces that recur are kept, as with other byte-level tokenizers.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        letters = _byte_letters()
        shown = lambda x: "".join([letters[b] for b in x])
        parts = ((x, k) for x in sorted(ranks, key=ranks.get) for k in range(1, len(x)))
        merges = [(shown(x[:k]), shown(x[k:])) for x, k in parts if x[:k] in ranks and x[k:] in ranks]
        self.model = models.BPE(vocab={shown(x): k for x, k in ranks.items()}, merges=merges, ignore_merges=True)
        self.letters = dict(enumerate(letters))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.by_piece, self.added = True, []
        self.forget()
        self.bytes_of = {k: x for x, k in ranks.items()}
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for x, k in ranks.items():
            self.sizes[k] = len(x)

    def vocabulary(self) -> int:
        return len(self.sizes)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids; an id that isn't in the file is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last, in code points of the text.

        A token that holds a part of a character has the whole character in its span.
        """
        ends = np.cumsum(self.sizes[ids])
        number = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
        return number[ends - self.sizes[ids]], number[ends - 1] + 1

    def whole_characters(self, ids: np.ndarray, start: int, end: int) -> bytes:
        """Bytes of the characters that begin within the tokens from ``start`` to ``end``.

        The last one is completed from the tokens behind, and what is left of a character
        that began before is cut off, so that neighbouring slices make up the text.
        """
        data = self.decode(ids[start:end])
        head = len(data) - len(data.lstrip(_TRAILS)) if start else 0
        tail = b""
        for k in range(end, min(len(ids), end + 4)):
            own = self.bytes_of[int(ids[k])]
            rest = len(own) - len(own.lstrip(_TRAILS))
            tail += own[:rest]
            if rest < len(own):
                break
        return data[head:] + (tail if head < len(data) else b"")


_TRAILS = bytes(range(0x80, 0xC0))
_codecs: dict[str, RankCodec] = {}


def codec(path: str) -> RankCodec:
    """The worker's codec for a rank file."""
    if path not in _codecs:
        _codecs[path] = RankCodec(path)
    return _codecs[path]


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    columns = list(zip(*held, strict=True)) if held else [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, ids[, starts, ends]) of every row: ids packed as little-endian unsigned 32-bit integers.

    With ``spans``, each token's first character and the one after its last, as arrays. A null
    text is an empty one; null ids and repeated rows stay; no other column is read.
    """
    fields = [("id", pa.int64()), ("ids", pa.binary())] + [(c, pa.list_(pa.int64())) for c in ("starts", "ends") if spans]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, text, ids in zip(batch.column(0), batch.column(1), own.encode_all(batch.column(1)), strict=True):
                    yield (key.as_py(), ids, *(own.spans((text.as_py() or "").encode(), np.frombuffer(ids, dtype=ID_TYPE)) if spans else ()))

        yield from _batches(rows(), pa.schema(fields), lambda r: len(r[1]) * (5 if spans else 1))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary" + (", starts array<long>, ends array<long>" if spans else ""))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded, n_split): the bytes of packed ids, and the tokens that begin within a character.

    Null ids decode to nothing. The bytes of a run that was cut within a character are no valid
    text; ``decode_slices`` gives whole characters.
    """
    fields = [("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("n_split", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, packed in zip(batch.column(0), batch.column(1), strict=True):
                    packed = packed.as_py() or b""
                    ids = np.frombuffer(packed, dtype=ID_TYPE)
                    data = own.decode(ids)
                    first = np.frombuffer(data, dtype=np.uint8)[np.cumsum(own.sizes[ids]) - own.sizes[ids]]
                    yield key.as_py(), packed, data, int(((first & 0xC0) == 0x80).sum())

        yield from _batches(rows(), pa.schema(fields), lambda r: len(r[1]) + len(r[2]))

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, ids binary, decoded binary, n_split long")


def decode_slices(encoded: DataFrame, path: str, size: int, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, slice, text): packed ids in runs of ``size`` tokens, each decoded to whole characters.

    A character belongs to the slice in which it begins, so a row's slices put together are
    its text. A slice in which none begins has an empty text; a row without ids has no slice.
    """
    fields = [("id", pa.int64()), ("slice", pa.int64()), ("text", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, packed in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.frombuffer(packed.as_py() or b"", dtype=ID_TYPE)
                    for k, at in enumerate(range(0, len(ids), size)):
                        yield key.as_py(), k, own.whole_characters(ids, at, min(len(ids), at + size)).decode("utf-8", "replace")

        yield from _batches(rows(), pa.schema(fields), lambda r: 4 * len(r[2]))

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, slice long, text string")
