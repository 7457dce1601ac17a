"""Token-id files with fixed-width bit packing.

A file holds a run of documents in ascending id order. All integers are little-endian:

    magic "ATOK0001" | header length u32 | header JSON
    doc ids i64[n]   | id is there u8[n] | token ends u64[n]
    block ends u64[blocks]               | packed ids

Every id takes the same number of bits, the least that hold the vocabulary (16 for
50,257). Ids are packed in blocks of ``block`` ids, each of whole bytes, lowest bit
first, so that the block of any token is found by division and unpacked with
numpy alone. ``block ends`` are byte offsets in the packed part.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attnmaps.llm.tokens import ID_TYPE, encoder

MAGIC = b"ATOK0001"
BLOCK_IDS = 4096
#: A file is closed when its ids reach this number, or its documents the next one.
FILE_IDS = 4_000_000
FILE_DOCS = 100_000


def id_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(ID_TYPE)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view(ID_TYPE).reshape(n)


def file_bytes(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK_IDS) -> bytes:
    """A whole file of documents whose ids are given as little-endian 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), dtype=ID_TYPE)
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(flat[at : at + block], bits) for at in range(0, len(flat), block)]
    header = json.dumps({"bits": bits, "block": block, "docs": len(doc_ids), "tokens": len(flat)}).encode()
    return b"".join(
        [
            MAGIC,
            struct.pack("<I", len(header)),
            header,
            np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
            np.array([x is not None for x in doc_ids], dtype="u1").tobytes(),
            (np.cumsum([len(x) for x in ids], dtype="<u8") // 4).astype("<u8").tobytes(),
            np.cumsum([len(x) for x in blocks], dtype="<u8").astype("<u8").tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """Random access to a file's documents; only the blocks asked for are unpacked."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.bits, self.block, self.docs, self.tokens = (head[k] for k in ("bits", "block", "docs", "tokens"))
        at = 12 + size
        take = lambda kind, n: np.frombuffer(data, dtype=kind, count=n, offset=at)
        ids, at = take("<i8", self.docs), at + 8 * self.docs
        there, at = take("u1", self.docs), at + self.docs
        self.doc_ids = [int(x) if y else None for x, y in zip(ids, there, strict=True)]
        self.ends, at = take("<u8", self.docs).astype(np.int64), at + 8 * self.docs
        n = -(-self.tokens // self.block)
        self.block_ends, at = take("<u8", n).astype(np.int64), at + 8 * n
        self.packed = memoryview(data)[at:]

    def tokens_at(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``, counted over the whole file."""
        if end <= start:
            return np.zeros(0, dtype=ID_TYPE)
        first, last = start // self.block, (end - 1) // self.block
        found = []
        for k in range(first, last + 1):
            here = self.packed[self.block_ends[k - 1] if k else 0 : self.block_ends[k]]
            found.append(unpack(here, min(self.block, self.tokens - k * self.block), self.bits))
        return np.concatenate(found)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.tokens_at(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_bytes(uri: str, data: bytes) -> None:
    """Put a file in place at once, wherever the folder is; a repeated task rewrites it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


FILES = "file string, part int, first_id long, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files of ``folder``.

    Ids ascend over the files as named, null ids first; rows that repeat an id are
    ordered by their texts' hashes. Null texts are empty ones: the end id alone. The rows
    are dealt by ranges of ids and hashes, so that any number of tasks write without a common
    counter, and rows of one id (or none) need not meet in one task; ``parts`` is the number of
    ranges, by default that of the session's shuffles. Returns the list of files, which is
    a table in the folder itself.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(tokenizer), np.array([end_id], dtype=ID_TYPE).tobytes()
        bits, part = id_bits(max(own.vocabulary(), end_id + 1)), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        total = files = 0

        def close() -> pa.RecordBatch:
            nonlocal total, files
            name = f"tokens-{part:07d}-{files:05d}.bin"
            write_bytes(f"{folder}/{name}", file_bytes(doc_ids, ids, bits))
            row = [[name], [part], [doc_ids[0]], [len(doc_ids)], [total]]
            doc_ids.clear(), ids.clear()
            total, files = 0, files + 1
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1)), strict=True):
                doc_ids.append(doc_id), ids.append(found + end)
                total += len(found) // 4 + 1
                if total >= FILE_IDS or len(doc_ids) >= FILE_DOCS:
                    yield close()
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ordered = dealt.sortWithinPartitions(*order).select("id", "text")
    ordered.mapInArrow(run, FILES).write.parquet(f"{folder}/files")
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def file_starts(files: DataFrame) -> DataFrame:
    """(file, base): number of ids in all files before, by name.

    Sums by part of the writing job run over as many rows as it had tasks; within a
    part the files' own totals add up. No task sees the list of all files.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a writing task
    begins = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = files.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return own.join(begins, "part").select("file", (F.col("own") + F.col("begin")).alias("base"))


def read_bytes(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as file:
        return file.read()


def read_tokens(folder: str, files: DataFrame) -> DataFrame:
    """Read files back: (doc_id, start, n_tokens, ids_crc32) of every document.

    ``start`` counts the ids of all documents before, over all files by name. The list of
    files is dealt to the tasks, each of which opens its own files in the shared folder.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(read_bytes(f"{folder}/{name}"))
                ends = file.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                flat = file.tokens_at(0, file.tokens)
                crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    starts = file_starts(files)
    dealt = starts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
