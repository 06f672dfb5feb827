"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

Legal conversations are words of a small automaton: an optional system turn, then user and assistant in turn, beginning
with the user. Each given turn is kept, relabelled or merged into the turn before it, and empty turns may be put in; the
dynamic program finds the choice of least cost. What a stretch of turns costs from each state to each is a small matrix,
and matrices of consecutive stretches combine, so a conversation that is too long for one task is solved by stretches:
first their matrices, then the states between them, then the turns inside each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, after a system, a user, an assistant turn. What may follow, by state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (0, 2, 3)
#: Costs: put in an empty turn, give another role, give a role to a turn without one, merge with the same role, with another.
INSERT, RELABEL, NAME, MERGE, MERGE_OTHER = 5, 3, 1, 1, 4
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
STRETCH, STRETCH_BYTES = 10_000, 4_000_000  # turns and text in a stretch, at most (one turn at least)
FAR = 10**12
_STRETCHES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("roles", pa.list_(pa.int8())), ("texts", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("turns", pa.int64()), ("held", pa.int64()), ("tail", pa.int64())])
_STATES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("number", pa.int32()), ("entry", pa.int8()), ("leave", pa.int8())])
_OUT = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int32()), ("n_turns", pa.int64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("cost", pa.int64()), ("rendered", pa.string())])


def role_number(role: str | None) -> int:
    """1, 2 or 3 for a known role, 0 for any other."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _moves() -> dict[int, list[tuple[int, int, int, tuple[int, ...], bool]]]:
    """For a given role: (state, state after, cost, roles put in before, merged) of everything that can be done."""
    moves = {}
    for given in range(4):
        own = []
        for state in range(4):
            if state:
                own.append((state, state, MERGE if given in (0, state) else MERGE_OTHER, (), True))
            for put in ((), *((x,) for x in NEXT[state]), *((x, y) for x in NEXT[state] for y in NEXT[x])):
                for role in NEXT[put[-1] if put else state]:
                    own.append((state, role, INSERT * len(put) + (0 if given == role else RELABEL if given else NAME), put, False))
        own.sort(key=lambda m: (m[2], m[4], len(m[3]), m[0], m[1]))  # the first of equal cost is taken
        moves[given] = own
    return moves


MOVES = _moves()


def matrix(roles: list[int]) -> np.ndarray:
    """Least cost of the turns from each state to each."""
    total = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(total, 0)
    steps = {}
    for given in range(4):
        step = np.full((4, 4), FAR, np.int64)
        for a, b, cost, _, _ in MOVES[given]:
            step[a, b] = min(step[a, b], cost)
        steps[given] = step
    for given in roles:
        total = np.minimum((total[:, :, None] + steps[given][None]).min(axis=1), FAR)
    return total


def repaired(roles: list[int], entry: int = 0, leave: int | None = None) -> tuple[int, list[tuple[int, tuple[int, ...], bool]]]:
    """Cost and, for each turn, its state after it, the roles put in before it, and whether it is merged."""
    best = [FAR] * 4
    best[entry] = 0
    back = []
    for given in roles:
        after, how = [FAR] * 4, [None] * 4
        for move in MOVES[given]:
            a, b, cost, _, _ = move
            if best[a] + cost < after[b]:
                after[b], how[b] = best[a] + cost, move
        best = after
        back.append(how)
    state = min(ENDS, key=lambda s: best[s]) if leave is None else leave
    cost, out = best[state], []
    for how in reversed(back):
        before, after, _, put, merged = how[state]
        out.append((after, put, merged))
        state = before
    return cost, out[::-1]


def rendered(roles: list[int], texts: list[str | None], steps, first: bool, last: bool) -> str:
    """The stretch in the chat format: ``<|role|>``, text, ``<|end|>`` on lines of their own."""
    parts, open_ = [], not first
    for text, (state, put, merged) in zip(texts, steps, strict=True):
        if merged:
            parts.append(f"\n{text or ''}")
            continue
        for role in (*put, state):
            if open_:
                parts.append("\n<|end|>\n")
            parts.append(f"<|{ROLES[role - 1]}|>\n")
            open_ = True
        parts.append(text or "")
    if last and open_:
        parts.append("\n<|end|>\n")
    return "".join(parts)


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, nth = TaskContext.get().partitionId(), 0
    conv, roles, texts, held, begun = None, [], [], 0, False
    out, size = [], 0

    def close():
        nonlocal roles, texts, held, nth, size
        out.append((conv, part, nth, roles, texts, matrix(roles).ravel().tolist(), len(roles), held, len(texts[-1] or "")))
        size += held + 100
        roles, texts, held, nth = [], [], 0, nth + 1

    def flush():
        nonlocal out, size
        batch = batch_of(_STRETCHES, **dict(zip(_STRETCHES.names, zip(*out, strict=True), strict=True)))
        out, size = [], 0
        return batch

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if begun and (conv_id != conv or len(roles) >= STRETCH or held >= STRETCH_BYTES):
                close()
            conv, begun = conv_id, True
            roles.append(role_number(role))
            texts.append(text)
            held += len(text or "")
            if size > STRETCH_BYTES:
                yield flush()
    if begun:
        close()
    if out:
        yield flush()


def _between(table: pa.Table) -> pa.Table:
    """States between the stretches of one conversation, whose matrices are all that is gathered here."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "nth", "costs")), strict=True))
    reach, back = np.array([0, FAR, FAR, FAR], np.int64), []
    for *_, costs in rows:
        step = reach[:, None] + np.array(costs, np.int64).reshape(4, 4)
        back.append(step.argmin(axis=0))
        reach = np.minimum(step.min(axis=0), FAR)
    state = min(ENDS, key=lambda s: reach[s])
    out = []
    for number, ((part, nth, _), choice) in reversed(list(enumerate(zip(rows, back, strict=True)))):
        out.append((part, nth, number, int(choice[state]), state))
        state = int(choice[state])
    return pa.Table.from_batches([batch_of(_STATES, **dict(zip(_STATES.names, zip(*out, strict=True), strict=True)))])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "number", "entry", "leave", "final"))
        for conv_id, roles, texts, number, entry, leave, final in zip(*columns, strict=True):
            cost, steps = repaired(roles, entry or 0, leave)
            merged = sum(s[2] for s in steps)
            put = sum(len(s[1]) for s in steps)
            other = sum(not s[2] and r != s[0] for r, s in zip(roles, steps, strict=True))
            out.append((conv_id, number or 0, len(steps) - merged + put, merged, other, put, cost, rendered(roles, texts, steps, not number, final)))
        if out:
            yield batch_of(_OUT, **dict(zip(_OUT.names, zip(*out, strict=True), strict=True)))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired and rendered conversations: ``conv_id, stretch, n_turns, n_merged, n_relabelled, n_inserted, cost, rendered``.

    A conversation has one row, a very long one a row per stretch, to be joined in order. Turns are ordered by ``turn``
    (null last), then role and text; repeated turns all count. A null text is empty, an unknown or null role gets the
    cheapest one. Rows without a conversation id are one conversation.
    """
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    # Ranges of (conversation, turn, ...): a hot conversation is spread over tasks and stays in order.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = written(dealt.mapInArrow(_stretch, from_arrow_schema(_STRETCHES)), "stretches")
    at = F.struct("part", "nth")
    several = stretches.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("end"), F.sum("turns").alias("turns"), (F.sum("held") - F.max_by("tail", at)).alias("held")).where("n > 1")
    several = written(several.withColumn("fits", (F.col("turns") <= STRETCH) & (F.col("held") < STRETCH_BYTES)), "several")
    # A conversation that would be one stretch but meets a partition border is put together again: one per border at most.
    fits = F.broadcast(several.where("fits").select(F.col("conv_id").alias("_c")))
    cut = F.col("conv_id").eqNullSafe(F.col("_c"))
    pieces = stretches.join(fits, cut).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "nth", "roles", "texts"))).alias("p"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("number", "int"), ("entry", "tinyint"), ("leave", "tinyint"))]
    again = pieces.select("conv_id", F.flatten("p.roles").alias("roles"), F.flatten("p.texts").alias("texts"), *none, F.lit(True).alias("final"))
    stretches = stretches.join(fits, cut, "left_anti")
    long = several.where(~F.col("fits")).select(F.col("conv_id").alias("_c"), "end")
    split = stretches.select("conv_id", "part", "nth", "costs").join(long.select("_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    states = split.select("conv_id", "part", "nth", "costs").groupBy("conv_id").applyInArrow(_between, from_arrow_schema(_STATES))
    joined = stretches.drop("costs", "turns", "held", "tail").join(states, ["part", "nth"], "left")
    ends = long.select(F.col("end.part").alias("part"), F.col("end.nth").alias("nth"), F.lit(True).alias("last"))
    joined = joined.join(ends, ["part", "nth"], "left").withColumn("final", F.col("number").isNull() | F.coalesce("last", F.lit(False)))
    return joined.drop("last", "part", "nth").unionByName(again).mapInArrow(_render, from_arrow_schema(_OUT))
