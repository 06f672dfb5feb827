import random

from tests.llm.brute import repeats_removed
from valograph.llm.substring import repeats, without_repeats

SCHEMA = "doc_id bigint, text string"


def check(spark, rows, window=50):
    df, wanted = spark.createDataFrame(rows, SCHEMA), sorted(repeats_removed(rows, window), key=str)
    found = without_repeats(df, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == wanted
    assert sorted(map(tuple, repeats(df, window=window).collect()), key=str) == wanted


def text(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_passages_runs_and_periods_match_brute_force(spark):
    r = random.Random(5)
    passage, run, period = text(1, 70), ["be"] * 90, ["a", "b"] * 60
    rows = []
    for i in range(60):
        parts = [text(100 + i, r.randrange(0, 80)), text(500 + i, r.randrange(0, 60), 3)]
        for extra in (passage, run[: r.randrange(1, 90)], period[: r.randrange(1, 120)], passage[r.randrange(30) :], run[:3] + passage[3:60]):
            if r.random() < 0.4:
                parts.insert(r.randrange(len(parts) + 1), extra)
        rows.append((r.randrange(10**6), " \n".join(" ".join(p) for p in parts)))
    rows += [(rows[0][0] + 1, rows[0][1]), (rows[3][0] - 1, rows[3][1])]
    check(spark, rows)
    check(spark, rows, 24)


def test_nulls_empty_long_repeated_rows_and_null_ids(spark):
    long = " ".join(text(7, 30_000))
    same = " ".join(text(8, 120))
    rows = [(1, None), (2, ""), (3, long), (9, long), (4, same), (4, same), (5, same + " tail"), (None, same), (None, "x " + same), (6, " \t\n"), (4, "other " + same)]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", 7, "k"), (2, "a b", 8, None)], "doc_id bigint, text string, n_words int, kept_text string")
    assert {(x.doc_id, x.n_words, x.kept_text) for x in without_repeats(df).collect()} == {(1, 2, "a b"), (2, 2, "a b")}


def test_texts_whose_polynomial_hashes_collide_are_kept_apart(spark):
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    texts = [" ".join(f"{'ab'[bit ^ flip]} u{i}" for i, bit in enumerate(morse)) for flip in (0, 1)]
    plain = [" ".join("ab"[bit ^ flip] for bit in morse) for flip in (0, 1)]
    check(spark, [(1, texts[0]), (2, texts[1]), (3, plain[0]), (4, plain[1])])
