"""Rounds of a sparse matrix over blocks of a graph: Spark deals nodes and edges and shuffles sums, a task holds one block.

Nodes are dealt to blocks by a hash of their number, edges to the block of their source. A block sums what it hands to
each target before it leaves, so a round is one shuffle of plain arrays, without keys: which targets a block writes to is
told once, before the first round. Several rounds run as stages of one job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valograph.session import delete, discard, drop_shuffles, ensure_checkpoint_dir, materialise, shuffles_of

EDGES_PER_BLOCK = 200_000
LEAST_EDGES = 100_000  # for each block beyond the first: with fewer a round is mostly the start of its tasks


def _same(block: int) -> int:
    return block


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names]).astype(np.float64) if names else np.zeros((0, table.num_rows))


def _block(values: Sequence[str], weights: Sequence[str], nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """One block's nodes in order of their numbers, and its edges in order of target, as one pickled row."""
    nodes = nodes.sort_by("_num")
    nums = nodes.column("_num").to_numpy()
    to, target = edges.column("_to").to_numpy(), edges.column("_target").to_numpy()
    order = np.lexsort((target, to))
    to, target = to[order], target[order]
    new = np.ones(len(to), bool)
    new[1:] = (to[1:] != to[:-1]) | (target[1:] != target[:-1])
    cut = np.flatnonzero(new)  # where each target's edges begin
    blocks, begin = np.unique(to[cut], return_index=True)
    held = {
        "nums": nums, "values": _columns(nodes, values), "weights": _columns(edges, weights)[:, order],
        "source": np.searchsorted(nums, edges.column("_source").to_numpy()[order]).astype(np.int32), "cut": cut, "targets": target[cut],
        "to": list(zip(blocks.tolist(), begin.tolist(), [*begin[1:].tolist(), len(cut)], strict=True)),
    }
    return pa.table({"_block": pa.array(nodes.column("_block").to_numpy()[:1], pa.int32()), "held": pa.array([pickle.dumps(held)], pa.binary())})


class Blocks:
    """A graph in blocks. ``nodes(_num, <values>)``, ``edges(_source, _target, <weights>)`` with numbers of nodes.

    ``_num`` is a bigint that tells nodes apart. Both frames should be written, as they are read several times.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, values: Sequence[str], weights: Sequence[str]):
        self.spark, self.names = nodes.sparkSession, list(weights)
        ensure_checkpoint_dir(self.spark)
        count = edges.count()
        self.parts = max(1, min(self.spark.sparkContext.defaultParallelism, -(-count // LEAST_EDGES)), -(-count // EDGES_PER_BLOCK))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")
        placed = nodes.select(place("_num").alias("_block"), "_num", *values)
        leaving = edges.select(place("_source").alias("_block"), place("_target").alias("_to"), "_source", "_target", *weights)
        build = partial(_block, list(values), self.names)
        self.passing: list[int] = []  # shuffles that only the rounds since the last call of settle() read
        self.rows = rows = materialise(placed.groupBy("_block").cogroup(leaving.groupBy("_block")).applyInArrow(lambda n, e: build(n, e), "_block int, held binary"))
        own = self.dealt(rows.rdd.map(lambda r: (r[0], ("block", pickle.loads(r[1])))))
        told = self.dealt(own.flatMap(_tell))
        self.blocks = own.union(told).mapPartitions(_listen, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept: list[RDD] = []
        self.lasting, self.passing = self.passing, []

    def dealt(self, rows: RDD) -> RDD:
        out = rows.partitionBy(self.parts, _same)
        self.passing += shuffles_of(out)
        return out

    def begin(self, start) -> RDD:
        """The state before the first round: ``start(block)`` gives an array of a row per variant."""
        return self.blocks.mapValues(lambda b: ("state", start(b[1]), [], None))

    def rounds(self, states: Sequence[RDD], steps: Sequence, shares: np.ndarray | None = None, extra=None) -> RDD:
        """The state after one round per item of ``steps``, kept; ``step(block, scores, sums, extras)`` gives the next scores.

        The first round starts from the last of ``states``, or from a mixture of them with one share per variant and
        state. ``extra(block, scores)``, a few numbers, goes from every block to all others.
        """
        start = states[-1] if shares is None else self.spark.sparkContext.union([s.mapValues(partial(_tagged, i)) for i, s in enumerate(states)]).mapPartitions(partial(_mixed, shares), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        sent = self.dealt(self.blocks.union(start).mapPartitions(partial(_first, self.parts, extra)))
        for step in steps[:-1]:
            sent = self.dealt(self.blocks.union(sent).mapPartitions(partial(_step, self.parts, step, extra, False)))
        met = self.blocks.union(sent).union(start.mapValues(partial(_tagged, "old")))
        after = met.mapPartitions(partial(_step, self.parts, steps[-1], extra, True), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        after.checkpoint()
        self.kept += [after] if shares is None else [start, after]
        return after

    def settle(self, states: Sequence[RDD]) -> None:
        """Free what the rounds so far needed, once they have run, but for these ``states``."""
        drop_shuffles(self.spark, self.passing)
        self.passing = []
        for rdd in self.kept:
            if not any(rdd is s for s in states):
                rdd.unpersist()
                if rdd.getCheckpointFile():
                    delete(self.spark, rdd.getCheckpointFile())
        self.kept = [rdd for rdd in self.kept if any(rdd is s for s in states)]

    def moves(self, states: Sequence[RDD]) -> tuple[float, np.ndarray]:
        """The last state's greatest move from where its rounds began, and per variant the products of all states' moves."""
        tagged = [s.mapValues(partial(_tagged, i)) for i, s in enumerate(states)]
        found = self.spark.sparkContext.union(tagged).mapPartitions(partial(_products, len(states))).collect()  # a few numbers per block
        if not found:
            return 0.0, np.zeros((len(self.names), len(states), len(states)))
        return max(m for m, _ in found), np.sum([p for _, p in found], axis=0)

    def table(self, state: RDD) -> DataFrame:
        """``_num`` and a column per variant, written."""
        flat = self.blocks.union(state).mapPartitions(_flat)
        schema = ", ".join(["_num bigint", *[f"`{n}` double" for n in self.names]])
        rows = self.spark.createDataFrame(flat, "nums binary, scores binary")
        return materialise(rows.mapInArrow(partial(_rows, self.names), schema))

    def close(self) -> None:
        self.settle([])
        self.blocks.unpersist()
        drop_shuffles(self.spark, self.lasting)
        discard(self.rows)


def _tell(row) -> Iterator[tuple]:
    p, (_, held) = row
    return [(q, ("told", p, held["targets"][a:b])) for q, a, b in held["to"]]


def _listen(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A block that knows where in its nodes the sums of each other block belong."""
    own, told = None, []
    for p, item in rows:
        if item[0] == "block":
            own = (p, item[1])
        else:
            told.append(item)
    if own:
        inbox = {p: np.searchsorted(own[1]["nums"], targets).astype(np.int32) for _, p, targets in told}
        yield own[0], ("block", {**{k: v for k, v in own[1].items() if k != "targets"}, "inbox": inbox})


def _tagged(tag, item: tuple) -> tuple:
    return (tag, *item[1:])


def _mixed(shares: np.ndarray, rows: Iterator[tuple]) -> Iterator[tuple]:
    found = {item[0]: (p, item[1]) for p, item in rows}
    if found:
        scores = sum(shares[:, i : i + 1] * found[i][1] for i in range(shares.shape[1]))
        yield found[0][0], ("state", scores, [], None)


def _products(states: int, rows: Iterator[tuple]) -> list[tuple]:
    found = {item[0]: item[3] for _, item in rows}
    if not found or not found[0].size:
        return []
    moves = np.stack([found[i] for i in range(states)], axis=1)
    return [(float(np.abs(moves[:, -1]).max()), np.einsum("vin,vjn->vij", moves, moves))]


def _met(rows: Iterator[tuple]) -> tuple:
    """A partition's block number, block, state and earlier state, and the sums and numbers sent to it, in a fixed order."""
    number, found, sums, extras = None, {}, [], []
    for p, item in rows:
        if item[0] in ("block", "state", "old"):
            number = p
            found[item[0]] = item[1:]
        elif item[0] == "sums":
            sums.append(item[1:])
        else:
            extras.append(item[1:])
    sums.sort(key=lambda s: s[0])
    extras.sort(key=lambda s: s[0])
    return number, found, sums, extras


def _handed(parts: int, number: int, block: dict, scores: np.ndarray, log: list, extra) -> Iterator[tuple]:
    yield number, ("state", scores, log, None)
    if len(block["cut"]):
        given = np.stack([np.add.reduceat(w * x[block["source"]], block["cut"]) for w, x in zip(block["weights"], scores, strict=True)])
        for q, a, b in block["to"]:
            yield q, ("sums", number, given[:, a:b])
    if extra is not None:
        for q in range(parts):
            yield q, ("extra", number, extra(block, scores))


def _first(parts: int, extra, rows: Iterator[tuple]) -> Iterator[tuple]:
    number, found, *_ = _met(rows)
    if "block" in found:
        yield from _handed(parts, number, found["block"][0], found["state"][0], [], extra)


def _step(parts: int, step, extra, last: bool, rows: Iterator[tuple]) -> Iterator[tuple]:
    number, found, sums, extras = _met(rows)
    if "block" not in found:
        return
    block, (scores, log, _) = found["block"][0], found["state"]
    total = np.zeros_like(scores)
    for p, given in sums:
        total[:, block["inbox"][p]] += given  # a block names each target once
    new, note = step(block, scores, total, [e for _, e in extras])
    if last:
        yield number, ("state", new, [*log, note], new - found["old"][0])
    else:
        yield from _handed(parts, number, block, new, [*log, note], extra)


def _flat(rows: Iterator[tuple]) -> Iterator[tuple]:
    _, found, *_ = _met(rows)
    if "block" in found:
        yield found["block"][0]["nums"].astype("<i8").tobytes(), np.ascontiguousarray(found["state"][0]).tobytes()


def _rows(names: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nums, scores in zip(batch.column("nums"), batch.column("scores"), strict=True):
            ids = np.frombuffer(nums.as_py(), "<i8")
            values = np.frombuffer(scores.as_py(), np.float64).reshape(len(names), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, values)], names=["_num", *names])
