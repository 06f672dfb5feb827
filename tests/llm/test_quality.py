import math
import random

from pyspark.sql import functions as F

from tests.llm.brute import words
from valograph.llm import quality

DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def counted(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, cover = {}, set()
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    for i, x in enumerate(windows):
        if seen[x] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), failed


def test_counts_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a", "x\n\nx\n x\n\x0b", "é😀 # & | < > * $ %", "one\x1ftwo three", " ".join(["be"] * 400), " ".join(f"w{i}" for i in range(30_000))]
    for _ in range(60):
        part = [r.choice("abcdefgh") for _ in range(r.randrange(1, 12))]
        texts.append("".join(r.choice([" ", "\n", "  "]) + x for _ in range(r.randrange(1, 9)) for x in (part if r.random() < 0.5 else r.sample("qwertyuiop", 5))))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).withColumn("n_words", F.lit("clash"))
    got = {x.doc_id: tuple(x[c] for c in quality.BASE) for x in quality.measured(df).where("n_words >= 0").collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 50, 0.05), (3, 400, 0.02), (12, 2000, 0.01), (150, 20_000, 0.01), (9, 10, 0.95), (7, 100, 0.01)]
    df = spark.createDataFrame(cases, "k bigint, n bigint, p double")
    for (k, n, p), row in zip(cases, df.select(quality.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()):
        log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)  # noqa: B023, E731
        exact = 1.0 if k > n * p else sum(math.exp(log(j)) for j in range(k + 1))
        assert abs(row.t - exact) < 1e-9 * exact + 1e-300


def prose(r, junk):
    w = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(25, 60))]
    return " ".join(x + "***" if junk else x for x in w)


def test_cutoffs_reject_junk_and_keep_good_texts(spark):
    r = random.Random(4)
    rows = [(i, prose(r, i % 5 == 0), "en" if i % 50 else "rare") for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(4000)] + [(None, 1, 0), (5, None, 0)], LABELS)
    got = {x.doc_id: x.kept for x in quality.judged(docs, labels).collect()}
    english = [i for i in range(4000) if i % 50]
    assert sum(got[i] for i in english if i % 5 == 0) <= 0.05 * sum(i % 5 == 0 for i in english)
    assert all(got[i] for i in english if i % 5)
    assert all(got[i] for i in range(0, 4000, 50))  # too few labels certify nothing
    assert len(got) == 4000


def test_nothing_is_rejected_without_evidence_and_empty_tables_pass(spark):
    docs = spark.createDataFrame([(1, "word " * 3, "en"), (2, " ".join(f"w{i}" for i in range(40)), None), (None, None, None), (2, " ".join(f"v{i}" for i in range(40)), "en")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert sorted((x.doc_id or 0, x.kept) for x in quality.judged(docs, none).collect()) == [(0, False), (1, False), (2, True), (2, True)]
    assert quality.judged(spark.createDataFrame([], DOCS), none).count() == 0
    assert "kept" in quality.judged(docs.drop("lang"), none).columns


def test_all_labels_count(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, prose(r, i % 6 == 0), "en") for i in range(1500)], DOCS)
    own = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(1500)], LABELS)
    others = spark.range(10_000, 310_000).selectExpr("id doc_id", "1 quality", "0 toxic")  # of documents that are not there
    got = {x.doc_id: x.kept for x in quality.judged(docs, own.unionByName(others)).collect()}
    assert not any(got[i] for i in range(0, 1500, 6)) and all(got[i] for i in range(1500) if i % 6)
