import itertools
import random

from valograph.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(roles):
    """Least cost over all ways to keep, relabel, merge or put in turns."""
    todo = {(0, 0): 0}
    for i, given in enumerate(roles):
        for state in range(4):
            cost = todo.get((i, state))
            if cost is None:
                continue
            options = [(state, cost + (chat.MERGE if given in (0, state) else chat.MERGE_OTHER))] if state else []
            for n in range(4):
                for put in itertools.product((1, 2, 3), repeat=n):
                    path = [state, *put]
                    if all(b in chat.NEXT[a] for a, b in zip(path, path[1:])):
                        options += [(q, cost + n * chat.INSERT + (0 if q == given else chat.RELABEL if given else chat.NAME)) for q in chat.NEXT[path[-1]]]
            for q, c in options:
                todo[i + 1, q] = min(c, todo.get((i + 1, q), c))
    return min(todo[len(roles), s] for s in chat.ENDS if (len(roles), s) in todo)


def legal(text):
    roles = [x.strip("<|>") for x in text.split("\n") if x in ("<|system|>", "<|user|>", "<|assistant|>")]
    body = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and text.count("<|end|>") == len(roles) and roles != ["system"]


def test_every_short_conversation_has_least_cost():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            cost, steps = chat.repaired(list(roles))
            assert cost == cheapest(roles)
            assert legal(chat.rendered(list(roles), ["t"] * n, steps, True, True))


def test_long_conversations_are_solved_by_stretches(spark, monkeypatch):
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant", "system", None, "Human"]), f"t{i}") for i in range(200)]
    rows += [(2, 0, "user", None), (2, 1, "GPT ", "b"), (3, 0, "assistant", "x"), (None, None, "user", "q"), (4, 0, "system", "s"), (5, 1, "user", "b"), (5, 1, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = {(x.conv_id, x.stretch): x for x in chat.formatted(df).collect()}
    chat_stretch = chat.STRETCH
    try:
        pieces = chat.formatted(df.repartition(2)).collect()
    finally:
        assert chat.STRETCH == chat_stretch
    by = {}
    for x in sorted(pieces, key=lambda x: x.stretch):
        by[x.conv_id] = (by.get(x.conv_id, (0, ""))[0] + x.cost, by.get(x.conv_id, (0, ""))[1] + x.rendered)
    joined = {}
    for (c, _), x in sorted(whole.items(), key=lambda p: p[0][1]):
        joined[c] = (joined.get(c, (0, ""))[0] + x.cost, joined.get(c, (0, ""))[1] + x.rendered)
    assert by == joined
    roles = [chat.role_number(x[2]) for x in rows[:200]]
    assert joined[1][0] == cheapest(roles)
    assert all(legal(t) for _, t in joined.values())
    assert joined[2][1] == "<|user|>\n\n<|end|>\n<|assistant|>\nb\n<|end|>\n"


def test_states_between_stretches_join_to_the_whole():
    import pyarrow as pa

    r = random.Random(5)
    for _ in range(50):
        roles = [r.randrange(4) for _ in range(30)]
        cuts = [0, *sorted(r.sample(range(1, 30), 4)), 30]
        parts = [roles[a:b] for a, b in zip(cuts, cuts[1:])]
        table = pa.table({"part": pa.array([0] * 5, pa.int32()), "nth": pa.array(range(5), pa.int32()), "costs": [chat.matrix(p).ravel().tolist() for p in parts]})
        states = sorted(chat._between(table).to_pylist(), key=lambda s: s["number"])
        costs, text = [], ""
        for p, s in zip(parts, states):
            cost, steps = chat.repaired(p, s["entry"], s["leave"])
            costs.append(cost)
            text += chat.rendered(p, ["t"] * len(p), steps, s["number"] == 0, s["number"] == 4)
        assert sum(costs) == cheapest(roles) and legal(text)


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
