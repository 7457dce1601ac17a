"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces best-fit, longest first. Its bins go on as items:
groups of eight neighbours are packed again, level by level, until one group is left.

A bin that no merge can use stays where it is. After best-fit at most one bin of a run or
group is half full or less (a light one), and two bins that are fuller never meet, so every bin
saved is a light one that found a host. A group of the first level meets one light bin of each
of its runs, a later one at most eight. All these together take no more hosts of one run
than they are, and a host that they take can be exchanged for an emptier one of the same run. So
the light bin and that many of the emptiest others go on, by a count that follows from the number of
partitions and runs, and leaving the rest in place saves no bin less.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attnmaps.llm.common import settle
from attnmaps.llm.tokens import ID_TYPE, encoder

CAPACITY = 2048
FAN_IN = 8
#: Pieces that a task packs together; a larger partition is packed in runs of so many.
RUN = 200_000
#: A bin's number holds its partition, its run and its place in the run; no run has more pieces than places.
PLACE_BITS, RUN_BITS = 18, 15

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, room long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, after a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, room left in each bin), longest items first.

    An item goes to the fullest bin that has room for it.
    """
    bins, offsets, rooms = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        k = bisect_left(open_rooms, size)
        if k < len(open_rooms):
            room = open_rooms[k]
            own = by_room[room].pop()
            if not by_room[room]:
                open_rooms.pop(k)
        else:
            room, own = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = own, capacity - room
        rooms[own] = room = room - size
        if room:
            if not by_room[room]:
                insort(open_rooms, room)
            by_room[room].append(own)
    return bins, offsets, rooms


def emptiest(rooms: Iterable[int], n: int) -> set[int]:
    """Numbers of the n emptiest bins, full ones aside."""
    return {-k for _, k in sorted(((r, -k) for k, r in enumerate(rooms) if r), reverse=True)[:n]}


def local_pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """Pieces of all documents, packed within each run of a partition; ``room`` is what their bin has left."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(tokenizer), np.array([end_id], dtype=ID_TYPE).tobytes()
        base = TaskContext.get().partitionId() << (RUN_BITS + PLACE_BITS)
        held: list[tuple] = []

        def close():
            nonlocal base
            bins, offsets, rooms = best_fit([x[3] for x in held], capacity)
            columns = [list(c) for c in zip(*held, strict=True)]
            columns += [[base + b for b in bins], offsets, [rooms[b] for b in bins]]
            base += 1 << PLACE_BITS
            held.clear()
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1)), strict=True):
                ids = found + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    held.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    if len(held) >= RUN:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are empty ones and yield the end id alone; rows that repeat an id are
    packed as documents of their own; null ids are kept. Longer documents than
    ``capacity`` are cut, the first piece being the shorter one. Sequences are gapless.
    """
    pieces = settle(local_pieces(docs, tokenizer, end_id, id_col, text_col, capacity))
    run, part = F.shiftright("bin", PLACE_BITS), F.shiftright("bin", RUN_BITS + PLACE_BITS)
    last, runs = pieces.agg(F.max(part), F.max(run.bitwiseAND((1 << RUN_BITS) - 1)) + 1).first()
    levels = 1
    while (last or 0) >= FAN_IN**levels:
        levels += 1
    # hosts of one run that all light bins it can meet would take, and its own light one
    most = 1 + FAN_IN * ((runs or 0) + levels - 1)
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("room"), "bin"))
    bins = pieces.where("at = 0 and room > 0").select("bin", "room", run.alias("run")).withColumn("rank", rank).where(F.col("rank") <= most)
    # root: the bin that a carried bin is part of now, shift: its place there
    moved = settle(bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), (F.lit(capacity) - F.col("room")).alias("fill"), part.alias("node"), F.lit(True).alias("open")))

    def merging(most: int):
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            roots = pdf.groupby("root", sort=True)["fill"].first()
            bins, offsets, rooms = best_fit(roots.tolist(), capacity)
            on = emptiest(rooms, most)
            heads = {b: r for r, b, o in zip(roots.index, bins, offsets, strict=True) if o == 0}
            new = pd.DataFrame({"root": roots.index, "to": [heads[b] for b in bins], "by": offsets, "filled": [capacity - rooms[b] for b in bins], "on": [b in on for b in bins]})
            out = pdf.merge(new, on="root")
            return pd.DataFrame({"bin": out["bin"], "root": out["to"], "shift": out["shift"] + out["by"], "fill": out["filled"], "node": out["node"], "open": out["on"]})

        return merge

    schema, done = "bin long, root long, shift long, fill long, node long, open boolean", None
    for above in reversed(range(levels if last is not None else 0)):  # levels over this one
        up = moved.withColumn("node", F.expr(f"node div {FAN_IN}"))
        packed = settle(up.groupBy("node").applyInPandas(merging(1 + FAN_IN * above), schema))
        closed = packed.where("not open") if above else packed
        done = closed if done is None else done.unionAll(closed)
        moved = packed.where("open")
    if done is None:
        placed = pieces.select("*", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    else:
        placed = pieces.join(done.select("bin", "root", "shift"), "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
