import hashlib
import random

from pyspark.sql import functions as F

from valograph.llm.lines import keep_bitmaps, without_repeated_lines

SCHEMA = "doc_id bigint, text string"
LAST = (1, 0)


def place(doc_id):
    return LAST if doc_id is None else (0, doc_id)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), LAST), place(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == place(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    kept = without_repeated_lines(df).select("own.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return sorted(map(tuple, kept.collect()), key=str)


def test_lines_match_brute_force_with_one_line_in_most_documents(spark):
    r = random.Random(3)
    common = [f"a line of text number {i}" for i in range(40)]
    rows = []
    for i in range(400):
        lines = [r.choice([*common, "short", "", f"own {i} {r.random()}", "UPPER case Line É", "upper CASE line É  ", "upper case line é"]) for _ in range(r.randrange(0, 90))]
        if r.random() < 0.7:
            lines += ["The very common line"] * r.randrange(1, 9)
        rows.append((r.randrange(10**9), "\n".join(lines)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(df) == brute(rows)
    some = keep_bitmaps(df).collect()
    assert some and all(w.keep != -1 for x in some for w in x.keep_bitmap)
    assert all(x.n_dropped == sum(64 - (w.keep & (2**64 - 1)).bit_count() for w in x.keep_bitmap) for x in some)


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "\n".join(f"line number {i % 700}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (5, long), (4, "line number 3\nline number 3"), (9, long), (9, long), (9, "line number 5\nanother line of nine")]
    rows += [(None, long), (None, "another line of nine\nonly without an id"), (None, "only without an id"), (7, "x" * 300_000), (8, "x" * 300_000)]
    rows += [(10, "\t padded line 1 \x0b\r\nPADDED LINE 1"), (11, "padded line 1 \npadded line 1"), (12, "ten chars!\nnine char")]
    rows += [(13, "ten chars!\nnine char"), (-4, "ten chars!")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_columns_of_any_name(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    names = ["doc_id", "text", "n_lines", "keep_bitmap", "text_hash", "other_id", "kept_text", "own", "pos", "a.b"]
    rows = [(i, "one line that is repeated", -5, "k", "h", "o", "t", "w", "p", "d") for i in (2, 1)]
    out = without_repeated_lines(spark.createDataFrame(rows, names))
    assert out.schema["own"].dataType.names == names
    got = {x.own.doc_id: (x.own.n_lines, x.own["a.b"], x.n_lines, x.n_dropped, x.kept_text) for x in out.collect()}
    assert got == {1: (-5, "d", 1, 0, "one line that is repeated"), 2: (-5, "d", 1, 1, "")}
