import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

from valograph.llm import divergence as D

SCHEMA = "text string, lang string, source string"


def brute(rows, least, top):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in docs}:
        own = [(t, s) for t, g, s in docs if g == lang]
        held = Counter(w for t, _ in own for w in set(t))
        kept = {w for w, n in held.items() if n >= least}
        whole = Counter(w for t, _ in own for w in t if w in kept)
        by = {s: Counter(w for t, x in own if x == s for w in t if w in kept) for s in {s for _, s in own}}

        def p(counts, w):
            return 1 + floor(Fraction(10**9 * (counts[w] + 5), sum(counts.values()) + 5 * len(kept)))

        for s, counts in by.items():
            pairs = [(sum(abs(p(counts, w) - p(c, w)) for w in kept), o) for o, c in by.items() if o != s]
            terms = [(p(counts, w) - p(whole, w), w) for w in kept if counts[w] and p(counts, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return out


def rows_of(seed, sources, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.choice(sources)
        words = [f"{r.choice('abcdé')}{r.choice('xyzü')}{r.choice(['', 'Q', str(s)[-1:]])}" for _ in range(r.randrange(60))]
        out.append((r.choice([" ", "-", "1", "\n"]).join(words), r.choice(["en", "de", None]), s))
    return out


def test_divergence_matches_exact_fractions(spark, monkeypatch):
    rows = rows_of(1, ["a", "b", "cc", "B", "ü", None], 300) + [(None, "en", "silent"), ("", "xx", "only"), ("no term is kept here", "yy", "p"), (None, "yy", "q"), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for least, top in ((5, 50), (30, 3)):
        assert {tuple(x) for x in D.divergence(df, least_docs=least, top=top).collect()} == brute(rows, least, top)


def test_sums_over_many_tiles_and_small_memory(spark):
    rows = rows_of(2, [f"s{i}" for i in range(23)], 200) * 2
    assert {tuple(x) for x in D.divergence(spark.createDataFrame(rows, SCHEMA), least_docs=4).collect()} == brute(rows, 4, 50)

    import numpy as np
    import pyarrow as pa

    held = [[{"ix": i, "p": 3 + i * k % 7, "floor": 1 + i % 3} for i in range(40) if (i + k) % 3] for k in range(30)]
    kind = pa.list_(pa.struct([("ix", pa.int64()), ("p", pa.int64()), ("floor", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 30), pa.array(held, kind)], ["lang", "held"])
    wanted = np.zeros((40, 40), np.int64)
    for row in held:
        for x in row:
            for y in row:
                wanted[x["ix"], y["ix"]] += abs(x["p"] - y["p"]) - abs(x["p"] - y["floor"]) - abs(x["floor"] - y["p"]) + abs(x["floor"] - y["floor"])
    tile, tiles = D.TILE, D.TILES
    try:
        D.TILE, D.TILES = 8, 3
        got = np.zeros((40, 40), np.int64)
        for out in D._met(iter([batch.slice(0, 11), batch.slice(11)])):
            np.add.at(got, (out.column("a").to_numpy(), out.column("b").to_numpy()), out.column("part").to_numpy())
    finally:
        D.TILE, D.TILES = tile, tiles
    upper = np.arange(40)[:, None] < np.arange(40)[None, :]
    assert (got[upper] == wanted[upper]).all()


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(7 * 10**11, 10**13, 10**7)], "n bigint, t bigint, v bigint").select(D.share("n", "t", "v").alias("p")).first()
    assert row.p == 1 + (10**9 * (7 * 10**11 + 5)) // (10**13 + 5 * 10**7)


def test_long_text_empty_table_and_clashing_columns(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "Ab cd " * 200_000 + "x" * 100_000
    rows = [(long, "en", "a"), ("cd", "en", "b")] * 3
    wide = spark.createDataFrame([(*x, 1, "t", 2, 3, 4) for x in rows], SCHEMA + ", n bigint, term string, ix bigint, floor bigint, terms bigint")
    assert {tuple(x) for x in D.divergence(wide, least_docs=3).collect()} == brute(rows, 3, 50)
