"""Best-fit packing of token sequences, planned on the histogram of their lengths.

The plan never looks at documents. It knows how many pieces have each length, at most ``capacity`` numbers, and fills
sequences best-fit from the longest length down, many equal sequences at a time. Each document piece then takes the
planned slot whose number is the piece's rank among the pieces of its length; ranks come from counts per task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, text_slices, written
from valograph.llm.tokens import encoder

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("_task", pa.int32()), ("_nth", pa.int64())])


def _cut(path: str, end: int, capacity: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        last = end.to_bytes(4, "little")
        for whole in batches:
            for batch in text_slices(whole):
                out = {f.name: [] for f in _PIECES}
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path, True, special).encode(batch.column("text").to_pylist()), strict=True):
                    ids += last
                    total = len(ids) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = (total - start - 1) % capacity + 1 if piece == 0 else capacity
                        for name, value in zip(_PIECES.names, (doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]), strict=True):
                            out[name].append(value)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield batch_of(_PIECES, **out)

    return run


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """The ids of each text with the ``end`` id after it, cut into pieces of at most ``capacity``.

    Only longer texts are cut; all pieces but the first are full. Columns: ``doc_id, piece, start, length, ids`` (binary,
    little-endian unsigned 32-bit), and the task and the rank within task and length that :func:`packed` numbers by. A
    null text is empty and gives one piece with the end id. Write the rows once before packing them. ``special`` gives
    strings of special tokens in a text those tokens' ids.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_cut(vocabulary, end, capacity, special), from_arrow_schema(_PIECES))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length: (length, first rank, slots, first sequence, sequences, offset).

    Rank r of a length has the slot with first <= r < first + slots: sequence first_sequence + (r - first) % sequences at
    offset + length * ((r - first) // sequences). A group of equal sequences is split when only some of them get a piece,
    so there are at most a few groups per length however many pieces there are.
    """
    slots: list[list[int]] = []
    free: list[int] = []  # sorted room that some group of sequences has left
    groups: dict[int, list[list[int]]] = {}  # room -> [first sequence, sequences] that have it
    opened = 0

    def leave(room: int, first: int, count: int) -> None:
        if room:
            if room not in groups:
                insort(free, room)
                groups[room] = []
            groups[room].append([first, count])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    free.pop(at)
            else:  # as many new sequences as the rest fills
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            # The tightest room stays the tightest while it still holds another piece, so each sequence is filled up.
            each = min(room // length, max(1, left // count))
            used = count if left >= count else left
            if used < count:
                leave(room, first + used, count - used)
            slots.append([length, rank, used * each, first, used, capacity - room])
            leave(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return [tuple(s) for s in slots]


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of :func:`pieces`, written once) with ``sequence_id`` and ``offset``; other columns stay."""
    spark = cut.sparkSession
    tally = written(cut.groupBy("_task", F.col("length").alias("_length")).agg(F.count(F.lit(1)).alias("_n")), "tally")
    counts = {r["_length"]: r["n"] for r in tally.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    slots = plan(counts, capacity)
    ahead = tally.selectExpr("_task as _t", "_length as _l", "sum(_n) over (partition by _length order by _task rows between unbounded preceding and 1 preceding) as _ahead")
    ranked = cut.join(ahead, (F.col("_task") == F.col("_t")) & (F.col("length") == F.col("_l"))).withColumn("_rank", F.coalesce("_ahead", F.lit(0)) + F.col("_nth"))
    # One row per length holds its slots in rank order: bounded by the plan, a few per length.
    schema = "_l2 bigint, _slots array<struct<first:bigint,slots:bigint,sequence:bigint,sequences:bigint,offset:bigint>>"
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    table = spark.createDataFrame(list(by_length.items()) or [], schema)
    placed = ranked.join(F.broadcast(table), F.col("length") == F.col("_l2")).withColumn("_slot", F.expr("filter(_slots, s -> _rank >= s.first and _rank < s.first + s.slots)[0]"))
    nth = F.col("_rank") - F.col("_slot.first")
    return placed.withColumns(
        {
            "sequence_id": F.col("_slot.sequence") + nth % F.col("_slot.sequences"),
            "offset": F.col("_slot.offset") + F.col("length") * F.floor(nth / F.col("_slot.sequences")).cast("bigint"),
        }
    ).drop("_task", "_nth", "_t", "_l", "_l2", "_ahead", "_rank", "_slots", "_slot")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """Packed sequences: ``sequence_id``, ``ids`` (the pieces' ids in order) and the pieces they hold. Each has one to ``capacity`` ids."""
    parts = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("pieces"))
