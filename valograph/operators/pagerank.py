"""Weighted PageRank as rounds over blocks of a hash-partitioned adjacency table.

Several weight variants run side by side as rows of a block's arrays, so an ablation over six weightings costs one
shuffle per round, of partially summed contributions. A node whose edges lie in several salts has a row in each of their
blocks, and a sum goes to all of them, so that neither edges nor scores move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.operators.blocks import Blocks
from valograph.operators.relational import semi_both_ends
from valograph.session import discard, materialise


EDGES_PER_SALT = 100_000
MIXED = 5  # states that an extrapolation is mixed of


def _adjacency(edges: DataFrame, ids: DataFrame, source: str, target: str, weights: Mapping[str, str | None]) -> DataFrame:
    """Normalised edges ``_s, _salt, _t`` between known nodes, written.

    Parallel edges are summed per (source, target) first and then divided by the source's sum; a variant without a
    weight column keeps 1 per edge and is not divided. A source with very many edges gets several salts, so that
    its edges lie in several buckets.
    """
    def weight(column: str | None):
        return F.lit(1.0) if column is None else F.coalesce(F.col(column).cast("double"), F.lit(0.0))

    summed = materialise(edges.groupBy(F.col(source).alias("_s"), F.col(target).alias("_t")).agg(
        *[F.sum(weight(c)).alias(v) for v, c in weights.items()]
    ))
    weighted = [v for v, c in weights.items() if c is not None]
    # Written, so that the join below stands on plain shuffles and adaptive execution can split a source of many edges.
    sums = materialise(summed.groupBy("_s").agg(F.count(F.lit(1)).alias("_degree"), *[F.sum(v).alias(f"_sum_{v}") for v in weighted]))
    parts = F.ceil(F.col("_degree") / EDGES_PER_SALT).cast("int")
    share = {v: F.when(F.col(f"_sum_{v}") > 0, F.col(v) / F.col(f"_sum_{v}")).otherwise(F.lit(0.0)) for v in weighted}
    salted = summed.join(sums, "_s").withColumns({**share, "_salt": F.pmod(F.hash("_t"), parts)})
    adjacency = salted.select("_s", "_salt", "_t", *weights)
    known = ids.select("_id")
    adjacency = adjacency.join(known, adjacency["_t"] == known["_id"], "left_semi")
    out = materialise(adjacency.join(known, adjacency["_s"] == known["_id"], "left_semi"))
    discard(summed, sums)
    return out


def _parts(adjacency: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Over how many salts each source's edges lie, and in which of the named variants any of them has a weight."""
    out = [F.max(F.col(v) > 0).alias(f"_out_{v}") for v in names]
    return adjacency.groupBy(F.col("_s").alias("_id")).agg((F.max("_salt") + 1).alias("_parts"), *out)


def _salted(ids: DataFrame) -> DataFrame:
    """A row per salt of a node's edges, one at least; every row holds the node's score."""
    return ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "_parts") - 1)))


def _with_target_parts(adjacency: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges that know over how many salts their target's own edges lie, so that a sum reaches all of its rows."""
    known = parts.select(F.col("_id").alias("_t"), F.col("_parts").alias("_tparts"))
    return adjacency.join(known, "_t", "left").fillna(1, ["_tparts"])


def _numbered(ids: DataFrame, adjacency: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes with a number each, and edges between these numbers: from the row of their salt to all rows of the target."""
    numbered = materialise(ids.withColumn("_num", F.monotonically_increasing_id()))
    key = numbered.select(F.col("_id"), F.col("_salt").alias("_own_salt"), "_num")
    to = adjacency.withColumn("_tsalt", F.explode(F.sequence(F.lit(0), F.col("_tparts") - 1)))
    left = to.join(key, (to["_s"] == key["_id"]) & (to["_salt"] == key["_own_salt"])).select("_t", "_tsalt", F.col("_num").alias("_source"), *names)
    both = left.join(key, (left["_t"] == key["_id"]) & (left["_tsalt"] == key["_own_salt"]))
    return numbered, materialise(both.select("_source", F.col("_num").alias("_target"), *names))


def _weighted_step(damping: float, first: bool, block: dict, scores: np.ndarray, sums: np.ndarray, _) -> tuple:
    base, fixed = block["values"][:1], block["values"][1:]
    share = 1.0 if first else 1.0 - damping  # of the quiet nodes' bases
    return (1.0 - damping) * base + damping * (sums + share * fixed), None


def _shares(products: np.ndarray) -> np.ndarray:
    """Shares, one in all, of states in the mixture whose move is the shortest; ``products`` of their moves with one another."""
    size = np.sqrt(np.diag(products))
    if not (size > 0).all():
        return np.eye(len(size))[-1]
    scaled = np.linalg.lstsq(products / np.outer(size, size), size.min() / size, rcond=1e-12)[0] * (size.min() / size)
    steady = np.isfinite(scaled).all() and np.abs(scaled).sum() < 1000.0 * abs(scaled.sum())  # larger shares would grow the rounding errors
    return scaled / scaled.sum() if steady else np.eye(len(size))[-1]


def _standard_step(damping: float, count: int, block: dict, scores: np.ndarray, sums: np.ndarray, idle: list) -> tuple:
    n = len(scores)
    loose = np.sum(idle, axis=0)
    new = ((1.0 - damping) / count + damping * loose / count)[:, None] + damping * sums
    return new, (np.abs(new - scores) * block["values"][n:]).sum(1)


def _idle(block: dict, scores: np.ndarray) -> np.ndarray:
    return (scores * block["values"][: len(scores)]).sum(1)


def weighted_pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    weights: Mapping[str, str | None],
    node_id: str = "paper_id",
    base: str = "base_value",
    source: str = "source_id",
    target: str = "target_id",
    damping: float = C.DAMPING,
    max_rounds: int = C.MAX_ROUNDS,
    tolerance: float | None = C.TOLERANCE,
    rounds_per_write: int = 10,
) -> DataFrame:
    """``score(v) = (1 - d) base(v) + d sum score(u) w(u, v)``, starting from the base values.

    ``weights`` maps an output column to an edge weight column, or to None for one per edge without
    normalisation. Stops after ``max_rounds``, or once no score of any variant moved by ``tolerance`` or more over
    a batch of ``rounds_per_write`` rounds, after which the scores are written. Scores are not renormalised and dangling
    nodes hand on nothing. With a tolerance, a batch of normalised variants starts from that mixture of the last states whose
    moves cancel best (Anderson); rounds go on from there until they are settled by the same test, so the limit is the
    same and reached in fewer rounds. Variants without normalisation, which may have no limit, are never mixed.

    A node without incoming edges has its base in the first round and a fixed score ever after, so what it hands on is
    summed once per target and only nodes with incoming edges, and the edges between them, take part in the rounds.
    """
    variants = list(weights)
    plain = materialise(nodes.select(F.col(node_id).alias("_id"), F.coalesce(F.col(base).cast("double"), F.lit(0.0)).alias("_base")))
    if max_rounds < 1:
        return plain.select(F.col("_id").alias(node_id), *[F.col("_base").alias(v) for v in variants])
    every = _adjacency(edges, plain, source, target, weights)
    cited = materialise(every.select(F.col("_t").alias("_id")).distinct())
    between = materialise(every.join(cited, every["_s"] == cited["_id"], "left_semi"))
    parts = materialise(_parts(between))
    quiet = plain.join(cited, "_id", "left_anti")
    fixed = every.join(quiet, every["_s"] == quiet["_id"]).groupBy(F.col("_t").alias("_id")).agg(
        *[F.sum(F.col(v) * F.col("_base")).alias(f"_fixed_{v}") for v in variants]
    )
    own = plain.join(cited, "_id", "left_semi").join(fixed, "_id", "left").join(parts, "_id", "left")
    held = ["_base", *[f"_fixed_{v}" for v in variants]]
    ids, adjacency = _numbered(_salted(own.fillna(0, ["_parts", *held[1:]])).drop("_parts"), _with_target_parts(between, parts), variants)
    discard(every, between, parts)
    graph = Blocks(ids, adjacency, held, variants)
    discard(adjacency)
    state = graph.begin(lambda b: np.repeat(b["values"][:1], len(variants), axis=0))
    done, states, quicker = 0, [], [c is not None for c in weights.values()]
    while done < max_rounds:
        steps = [partial(_weighted_step, damping, done + k == 0) for k in range(min(rounds_per_write, max_rounds - done))]
        shares = None
        if len(states) > 1 and tolerance is not None:
            last = np.eye(len(states))[-1]
            shares = np.array([_shares(p) if q else last for p, q in zip(products, quicker, strict=True)])
        state = graph.rounds(states or [state], steps, shares)
        started, done = done > 0, done + len(steps)  # the first round differs, so its move is not one of the others'
        states = [*states, state][-MIXED:] if started else []
        moved, products = graph.moves(states or [state])
        graph.settle(states or [state])
        if tolerance is not None and moved < tolerance and done > 1:
            break
    scores = graph.table(state)
    core = ids.where("_salt = 0").select("_id", "_num").join(scores, "_num").select("_id", *variants)
    rest = quiet.select("_id", *[((1.0 - damping) * F.col("_base")).alias(v) for v in variants])
    done_scores = materialise(core.unionByName(rest))
    graph.close()
    discard(plain, cited, ids, scores)
    return done_scores.withColumnRenamed("_id", node_id)


def standard_pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    weight: str | None,
    out: str = "score",
    node_id: str = "paper_id",
    source: str = "source_id",
    target: str = "target_id",
    damping: float = C.DAMPING,
    max_rounds: int = 100,
    tolerance: float | None = 1e-6,
) -> DataFrame:
    """``standard_pageranks`` for one weight."""
    return standard_pageranks(nodes, edges, {out: weight}, node_id, source, target, damping, max_rounds, tolerance)


def standard_pageranks(
    nodes: DataFrame,
    edges: DataFrame,
    weights: Mapping[str, str | None],
    node_id: str = "paper_id",
    source: str = "source_id",
    target: str = "target_id",
    damping: float = C.DAMPING,
    max_rounds: int = 100,
    tolerance: float | None = 1e-6,
    rounds_per_write: int = 10,
) -> DataFrame:
    """Textbook PageRank: uniform start and teleport, stochastic rows, dangling mass spread over all nodes.

    One column per variant in ``weights``, all from one run; None weighs every edge by 1. Edges with an end outside the
    nodes are left out; parallel edges collapse to one (the largest weight is kept). Stops when the summed change of every
    variant is below ``tolerance`` times the node count. A node dangles in the variants in which its edges weigh nothing.
    The dangling mass of a round is one number per variant, read back from the written scores together with the change.
    """
    names = list(weights)
    ids = materialise(nodes.select(F.col(node_id).alias("_id")).distinct())
    count = ids.count()
    known = semi_both_ends(edges, ids, "_id", source, target)
    single = known.groupBy(source, target).agg(*[(F.max(w) if w else F.lit(1.0)).alias(v) for v, w in weights.items()])
    linked = _adjacency(single, ids, source, target, {v: v for v in names})
    every = linked.where(F.greatest(F.lit(0.0), *names) > 0)
    parts = materialise(_parts(every, names))
    known_parts = ids.join(parts, "_id", "left").fillna(0, ["_parts"]).fillna(False, [f"_out_{v}" for v in names])
    rows, adjacency = _numbered(_salted(known_parts), _with_target_parts(every, parts), names)
    once = F.when(F.col("_salt") == 0, F.lit(1.0)).otherwise(F.lit(0.0))  # a node with several rows counts by its first
    flags = {f"_idle_{v}": F.when(F.col(f"_out_{v}"), F.lit(0.0)).otherwise(once) for v in names} | {f"_once_{v}": once for v in names}
    discard(linked, parts)
    graph = Blocks(rows.select("_num", *[c.alias(n) for n, c in flags.items()]), adjacency, list(flags), names)
    discard(adjacency)
    state = graph.begin(lambda b: np.full((len(names), len(b["nums"])), 1.0 / max(1, count)))
    step, done = partial(_standard_step, damping, max(1, count)), 0
    while done < max_rounds:
        steps = [step] * min(rounds_per_write, max_rounds - done)
        before, state = state, graph.rounds([state], steps, extra=_idle)
        done += len(steps)
        notes = state.map(lambda x: x[1][2]).collect()  # the changes of each round, a few numbers per block
        graph.settle([before, state])
        if tolerance is None:
            continue
        if not notes:
            break
        settled = (np.sum(notes, axis=0) < tolerance * max(1, count)).all(axis=1)
        if settled.any():
            if not settled[:-1].any():
                break
            state = graph.rounds([before], steps[: int(settled.argmax()) + 1], extra=_idle)  # no further than the round that settled
            break
    scores = graph.table(state)
    out = materialise(rows.where("_salt = 0").select("_id", "_num").join(scores, "_num").select(F.col("_id").alias(node_id), *names))
    graph.close()
    discard(ids, rows, scores)
    return out
