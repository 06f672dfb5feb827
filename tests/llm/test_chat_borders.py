import random

from valograph.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_a_short_conversation_is_one_row_at_any_number_of_partitions(spark):
    r = random.Random(4)
    rows = [(c, i, r.choice(["user", "assistant", "system", None]), f"t{c}-{i}" if i % 5 else None) for c in (1, 2, None) for i in range(300)]
    rows += [(c, i, "user", "x") for c in range(3, 40) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted(map(tuple, chat.formatted(df).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(found[0]) == 40 and {x[1] for x in found[0]} == {0}
    assert found[1] == found[0] and found[2] == found[0]
