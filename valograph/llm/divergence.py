"""Source divergence audit: how far the sources of a language differ in the terms they use, and by which terms.

Tokens come from one ``bytes.translate`` per text, which lowers A-Z and blanks every separator, and ``bytes.split``. A
``Counter`` per document gives its terms; a task adds them up per language and source before anything is shuffled.

Shares are smoothed, so a term that a source lacks still has a share, its floor. Differences between two sources are
summed over all kept terms without laying out the absent ones: what the floors alone give is known from the number of
terms, what one source's own terms add is read off that source's running sums, and only terms that both have are met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, text_slices, written

LEAST_DOCS = 30  # documents of the language that hold a kept term
TOP = 50  # terms listed per source
SCALE, SMOOTH = 1_000_000_000, 5
HELD = 400_000  # counts a task holds before it passes them on; bounds memory, has no effect on results
TILE, TILES = 512, 64  # sources by sources in a tile of sums, tiles a task holds

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LETTERS).split() if text else []


def _passed_on(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        for i in range(0, len(terms), 50_000):
            some = terms[i : i + 50_000]
            yield batch_of(
                _COUNTS, lang=[lang] * len(some), source=[source] * len(some), term=[t.decode() for t in some], n=[n[t] for t in some], docs=[docs[t] for t in some]
            )
    held.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = {}, 0
    for whole in batches:
        for batch in text_slices(whole):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own = Counter(terms_of(text))
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from _passed_on(held)
                    size = 0
    yield from _passed_on(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group."""
    return docs.mapInArrow(_count, from_arrow_schema(_COUNTS)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; null without terms."""
    upper = f"cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))"
    return F.expr(f"1 + if({terms} = 0, null, ({upper}) div cast({total} + {SMOOTH} * {terms} as decimal(20, 0)))")


def _tiles(sums: dict) -> Iterator[pa.RecordBatch]:
    for (lang, i, j), tile in sums.items():
        a, b = np.nonzero(tile)
        yield batch_of(_SUMS, lang=[lang] * len(a), a=a + i * TILE, b=b + j * TILE, part=tile[a, b])
    sums.clear()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources have add to their floors' difference, summed per pair; a row is a term's sources."""
    sums: dict = {}
    for batch in batches:
        lists = batch.column("held")
        cuts, flat = lists.offsets.to_numpy(), lists.values
        source, p, floor = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("ix", "p", "floor"))
        for lang, begin, end in zip(batch.column("lang").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            order = begin + np.argsort(source[begin:end])
            ix = source[order]
            blocks = np.split(order, np.flatnonzero(np.diff(ix // TILE)) + 1)
            for k, left in enumerate(blocks):
                for right in blocks[k:]:
                    x, y = p[left][:, None], p[right][None, :]
                    low, other = floor[left][:, None], floor[right][None, :]
                    part = np.abs(x - y) - np.abs(x - other) - np.abs(low - y) + np.abs(low - other)
                    key = lang, int(source[left[0]] // TILE), int(source[right[0]] // TILE)
                    if key not in sums:
                        if len(sums) >= TILES:
                            yield from _tiles(sums)
                        sums[key] = np.zeros((TILE, TILE), np.int64)
                    sums[key][np.ix_(source[left] % TILE, source[right] % TILE)] += part
    yield from _tiles(sums)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``lang`` and ``source``.

    Part ``pair`` has a row for each other source of the language: the sum over the language's kept terms of the absolute
    difference of both sources' shares. Part ``term`` has the ``top`` terms by which the group's share exceeds the
    language's. A kept term is in ``least_docs`` documents of its language or more; a share is 1 + floor(10^9 (count + 5)
    / (N + 5 V)). Equal values go by the item's bytes.

    Null texts, languages and sources count as empty. A repeated row counts as a document of its own. Without a row there
    is no group, and a language with one source has no pairs. Other columns are not read. One row goes to one task per
    term, with an entry per source that has the term; all else is summed before it is shuffled.
    """
    clean = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = written(term_counts(clean), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "kept_terms")
    used = written(counts.drop("docs").join(kept, ["lang", "term"]), "kept_counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = clean.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    index = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("ix", index.cast("bigint")).withColumn("zero", F.lit(0).cast("bigint"))
    groups = written(groups.withColumn("floor", F.coalesce(share("zero", "total", "terms"), F.lit(0))).drop("zero"), "source_groups")
    shares = written(used.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")), "term_shares")

    above = shares.withColumn("value", F.col("p") - share("lang_n", "lang_total", "terms")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    pairs = source_pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return terms.unionByName(pairs.withColumn("rank", F.row_number().over(by_value)))


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the summed differences of each source to each other one of its language."""
    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("ix", "p", "floor")).alias("held")).where(F.size("held") > 1)
    met = held.select("lang", "held").mapInArrow(_met, from_arrow_schema(_SUMS)).where("a != b")
    met = met.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.when(F.col("a") < F.col("b"), F.col("part"))).alias("met"))

    # The other sources' floors are put among a source's own shares in order; running sums then give each of them the
    # sum of |p - floor| over the source's terms.
    other = groups.select("lang", F.col("ix").alias("b"), F.col("source").alias("item"), F.col("floor").alias("at"))
    asked = groups.select("lang", F.col("ix").alias("a"), "source", "floor", "terms").join(other, "lang").where("a != b")
    own = shares.groupBy("lang", F.col("ix").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("m"))
    line = own.unionByName(asked, allowMissingColumns=True).withColumn("mass", F.col("m") * F.col("at"))
    up_to = Window.partitionBy("lang", "a").orderBy("at")
    whole = Window.partitionBy("lang", "a")
    line = line.select(
        "*",
        *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{n}") for c in ("m", "mass") for w, n in ((up_to, "below"), (whole, "all"))),
    )
    gap = F.abs(F.col("floor") - F.col("at"))
    apart = F.expr("(mass_all - mass_below) - at * (m_all - m_below) + at * m_below - mass_below")
    asked = line.where("b is not null").withColumn("own", apart - F.col("m_all") * gap)
    asked = written(asked.select("lang", "a", "b", "source", "item", "own", (F.col("terms") * gap).alias("floors")), "source_pairs")
    back = asked.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("own").alias("own_back"))
    both = asked.join(back, ["lang", "a", "b"]).withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    met = met.withColumnsRenamed({"a": "low", "b": "high"})
    value = F.expr("floors + own + own_back + coalesce(met, 0)")
    return both.join(met, ["lang", "low", "high"], "left").select("lang", "source", "item", value.alias("value"))
