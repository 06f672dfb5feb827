"""Joins of strings by containment and by sequence similarity, without comparing all of one side with all of the other."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from valograph.functions.text import normalise, sequence_ratio
from valograph.session import materialise

GRAM = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
TITLES_PER_BLOCK, NAMES_PER_BLOCK = 64, 128
SEED_GRAMS, SEED_NAMES = 4, 32  # only for a first, lower bound of each title's best score
LEVELS = 5
CLOSE = 1e-9  # bounds are rounded so that no pair at the limit is lost
POPULAR = 200  # from this length on the ratio leaves out frequent letters


def grams(text: Column | str, size: int = GRAM) -> Column:
    """Distinct substrings of ``size`` characters; a shorter text has none."""
    text = F.col(text) if isinstance(text, str) else text
    last = F.length(text) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(text, i, size)))
    )


def contained_pairs(short: DataFrame, long: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs of rows where ``part`` of the one is a substring of ``whole`` of the other.

    A part is looked up by one of its grams only, the one that the fewest wholes have; a part with a gram that no whole has
    is dropped. A whole is listed once per gram, so rows grow with the length of the texts. Parts below the gram's size
    are looked up by themselves, in grams of their size, which are only made if there are such parts.
    """
    parts = short.where(F.length(part) > 0)
    sizes = [r[0] for r in parts.select(F.least(F.length(part), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM rows
    out = None
    for size in sizes:
        listed = long.withColumn("_gram", F.explode(grams(whole, size)))
        seen = listed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
        own = parts.where(F.length(part) == size) if size < GRAM else parts.where(F.length(part) >= size)
        asked = own.select(part, F.explode(grams(part, size)).alias("_gram")).distinct().join(seen, "_gram", "left")
        rarest = asked.groupBy(part).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")).where("_r.n > 0")
        anchors = own.join(rarest.select(part, F.col("_r._gram").alias("_gram")), part)
        pairs = anchors.join(listed, "_gram").where(F.contains(F.col(whole), F.col(part))).drop("_gram")
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else short.join(long, F.lit(False))


def _prefix(share: Column, length: Column) -> Column:
    """How many of a string's ordered letters must be listed so that strings with ``share`` in common meet.

    Two strings with a ratio of at least ``share`` have ``share * (a + b) / 2`` letters in common, and the other is at
    least ``share / (2 - share)`` times as long.
    """
    other = F.ceil(share * length / (2 - share) - CLOSE)
    return (length - F.ceil(share * (length + other) / 2 - CLOSE) + 1).cast("int")


def _rare_letters(frequency: dict[str, float]):
    """A string's letters, each numbered by its occurrence, the rare ones first; as many as asked."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            out = []
            for text, size in zip(texts, sizes, strict=True):
                seen: dict[str, int] = {}
                tokens = []
                for c in text:
                    seen[c] = seen.get(c, 0) + 1
                    tokens.append((frequency.get(c, 0.0) * 0.5 ** seen[c], c, seen[c]))
                out.append([f"{c}{k}" for _, c, k in sorted(tokens)[: max(0, size)]])
            yield pd.Series(out)

    return run


_FOUND = pa.schema([("title", pa.string()), ("score", pa.float64()), ("file_name", pa.string())])


def _letters(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 128), np.int32)
    for row, text in zip(out, texts, strict=True):
        np.add.at(row, np.frombuffer(text.encode("ascii"), np.uint8), 1)
    return out[:, np.frombuffer(ALPHABET.encode(), np.uint8)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best name of each title within one block of titles and one of names; a row holds both blocks."""
    for batch in batches:
        for titles, names in zip(batch.column("titles").to_pylist(), batch.column("names").to_pylist(), strict=True):
            letters, others = _letters([t["title"] for t in titles]), _letters([n["name"] for n in names])
            sizes = others.sum(axis=1)
            found: dict[str, list] = {"title": [], "score": [], "file_name": []}
            for title, own in zip(titles, letters, strict=True):
                bound = 2 * np.minimum(own, others).sum(axis=1) / (own.sum() + sizes)
                best, name = title["least"], None
                for k in np.argsort(-bound, kind="stable").tolist():
                    if bound[k] < best - CLOSE:
                        break
                    score = SequenceMatcher(None, title["title"], names[k]["name"]).ratio()
                    if score > best or (score == best and (name is None or names[k]["file_name"] < name)):
                        best, name = score, names[k]["file_name"]
                if name is not None:
                    for column, value in zip(_FOUND.names, (title["title"], best, name), strict=True):
                        found[column].append(value)
            yield pa.RecordBatch.from_pydict(found, schema=_FOUND)


def _blocks(rows: DataFrame, keys: list[str], text: str, size: int, row: Column, out: str) -> DataFrame:
    """Rows of a key in arrays of about ``size``; a key of many rows has many arrays."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    dealt = rows.join(counts, keys).withColumn("_block", F.pmod(F.xxhash64(text), "_blocks"))
    return dealt.groupBy(*keys, "_block").agg(F.collect_list(row).alias(out)).drop("_block")


def _best(found: DataFrame) -> DataFrame:
    """Per title the highest score, with the smallest file name among equals."""
    top = found.groupBy("title").agg(F.min(F.struct((-F.col("score")).alias("s"), "file_name")).alias("_b"))
    return top.select("title", (-F.col("_b.s")).alias("score"), F.col("_b.file_name").alias("file_name"))


def fuzzy_file_matches(
    files: DataFrame, papers: DataFrame, least: float = 0.55, bonus: float = 0.25, name_by_id: str = "Source_%s.pdf"
) -> DataFrame:
    """``paper_id, file_name, score`` for ``papers(paper_id, title)`` and ``files(file_name)``.

    A file named after the id comes first (score null). Otherwise the file whose name has the highest sequence ratio to
    the title, plus ``bonus`` where it holds the title, if that is ``least`` or more; equal scores go to the smaller name.
    Empty titles and names match nothing. Every pair that could win is compared, but never all pairs: a name that holds
    the title is found by its rarest gram; some names that share a rare gram give a first score; and only names whose
    letters allow as much are compared, met by rare letters at the level of that score, block against block.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    names = files.select("file_name", normalise(stem).alias("name")).where("name <> ''").groupBy("name").agg(F.min("file_name").alias("file_name"))
    names = materialise(names)
    by_id = papers.select("paper_id", F.format_string(name_by_id, F.col("paper_id").cast("string")).alias("_own"))
    by_id = by_id.join(files.select(F.col("file_name").alias("_own")).distinct(), "_own").select("paper_id", F.lit(None).cast("double").alias("score"), F.col("_own").alias("file_name"))
    open_papers = papers.select("paper_id", normalise("title").alias("title")).join(by_id.select("paper_id"), "paper_id", "left_anti")
    titles = materialise(open_papers.select("title").where("title <> ''").distinct())

    pairs = contained_pairs(titles, names, "title", "name")
    whole = 2.0 * F.length("title") / (F.length("title") + F.length("name"))
    short = pairs.where(F.length("name") < POPULAR).select("title", (whole + bonus).alias("score"), "file_name")
    long = pairs.where(F.length("name") >= POPULAR).select("title", (sequence_ratio("title", "name") + bonus).alias("score"), "file_name")
    first = short.unionByName(long).unionByName(_seeds(titles, names))
    first = materialise(titles.join(_best(first), "title", "left"))

    step = (1.0 - least) / LEVELS
    asked = first.withColumn("least", F.greatest(F.lit(least), F.coalesce("score", F.lit(0.0)))).where(F.col("least") <= 1.0)
    asked = materialise(asked.withColumn("level", F.least(F.lit(LEVELS - 1), F.floor((F.col("least") - least) / step)).cast("int")))
    levels = sorted(r[0] for r in asked.select("level").distinct().collect())  # at most LEVELS rows
    counted = names.select(F.explode(F.split("name", "")).alias("c")).groupBy("c").count().collect()  # the alphabet
    total = sum(r["count"] for r in counted) or 1
    rare = _rare_letters({r["c"]: r["count"] / total for r in counted})

    wanted = asked.withColumn("token", F.explode(rare("title", _prefix(F.col("least"), F.length("title")))))
    listed = names.withColumn("level", F.explode(F.lit(levels or [0])))
    share = F.lit(least) + F.col("level") * step
    listed = listed.withColumn("token", F.explode(rare("name", _prefix(share, F.length("name")))))
    title_blocks = _blocks(wanted, ["level", "token"], "title", TITLES_PER_BLOCK, F.struct("title", "least"), "titles")
    name_blocks = _blocks(listed, ["level", "token"], "name", NAMES_PER_BLOCK, F.struct("name", "file_name"), "names")
    met = title_blocks.join(name_blocks, ["level", "token"]).select("titles", "names").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    compared = met.mapInArrow(_compare, "title string, score double, file_name string")

    best = _best(compared.unionByName(first.select("title", "score", "file_name").where("score is not null"))).where(F.col("score") >= least)
    by_title = open_papers.join(best, "title").select("paper_id", "score", "file_name")
    return papers.select("paper_id").join(by_id.unionByName(by_title), "paper_id", "left").select("paper_id", "file_name", "score")


def _seeds(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Scores of a few names per title that share a rare gram with it: a lower bound for the best, no more."""
    listed = names.select("name", "file_name", F.explode(grams("name")).alias("_gram"))
    seen = listed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    few = listed.withColumn("_at", F.row_number().over(W.partitionBy("_gram").orderBy("name"))).where(F.col("_at") <= SEED_NAMES)
    own = titles.select("title", F.explode(grams("title")).alias("_gram")).join(seen, "_gram")
    rare = own.withColumn("_at", F.row_number().over(W.partitionBy("title").orderBy("_n", "_gram"))).where(F.col("_at") <= SEED_GRAMS)
    met = rare.select("title", "_gram").join(few.select("name", "file_name", "_gram"), "_gram").select("title", "name", "file_name").distinct()
    return met.select("title", sequence_ratio("title", "name").alias("score"), "file_name")
