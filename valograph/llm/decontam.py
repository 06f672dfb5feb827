"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment scores them.

Words are compared lower-cased and without punctuation. A seed is an n-gram of a test item that is rare in the corpus:
in at most ``rare`` of its documents, or at most twice as frequent as its item's median n-gram, so that an item that
leaked very often keeps its seeds: a leak adds to all of them alike. Passages around seeds are aligned with the item; equal words score, other words and gaps cost, so
edited and paraphrased copies still score high. The score is the best alignment's share of the item's own.

Test items are the stated query set: they are few, and where they are many they are taken in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, text_slices

GRAM = 3
RARE = 1e-4
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 4_000_000  # characters of test items that are sent to the tasks at a time
_WORD = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """Test items as word numbers, and their n-grams as exact 64-bit codes."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        split = [terms(t) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        self.base = len(self.vocabulary) + 1
        if self.base**GRAM >= 2**63:
            raise ValueError("too many words in a block of test items")
        self.words = [np.array([self.vocabulary[w] for w in s], np.int64) for s in split]
        pairs = sorted({(int(c), k) for k, w in enumerate(self.words) for c in self.grams(w)})
        self.codes = np.array([c for c, _ in pairs], np.int64)
        self.owners = np.array([k for _, k in pairs], np.int64)
        self.unique = np.unique(self.codes)

    def numbers(self, text: str | None) -> np.ndarray:
        find, none = self.vocabulary.get, self.base - 1
        found = terms(text)
        return np.fromiter((find(w, none) for w in found), np.int64, len(found))

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Codes of the n-grams; an item shorter than n has one code of all its words."""
        if not len(words):
            return np.zeros(0, np.int64)
        n = min(GRAM, len(words))
        size = len(words) - n + 1
        code = np.zeros(size, np.int64)
        for k in range(n):
            code = code * self.base + words[k : k + size]
        return code

    def hits(self, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Positions whose n-gram is one of the sorted ``codes``."""
        grams = self.grams(words) if len(words) >= GRAM else np.zeros(0, np.int64)
        if not len(codes) or not len(grams):
            return np.zeros(0, np.int64)
        at = np.searchsorted(codes, grams)
        return np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == grams)


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and the end of it in the passage. A row of the matrix at a time."""
    columns = np.arange(1, len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        step = np.maximum(np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        # A gap inside the item's row: the best cell to the left, less what the gap costs.
        row[1:] = np.maximum.accumulate(step + columns) - columns
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


_SEEN = pa.schema([("code", pa.int64()), ("n", pa.int64())])
_MATCHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())])


def _count(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for whole in batches:
            seen = np.zeros(len(own.unique), np.int64)
            for batch in text_slices(whole):
                for text in batch.column("text").to_pylist():
                    words = own.numbers(text)
                    at = own.hits(words, own.unique)
                    if len(at):
                        seen[np.unique(np.searchsorted(own.unique, own.grams(words)[at]))] += 1
            some = np.flatnonzero(seen)
            yield batch_of(_SEEN, code=own.unique[some], n=seen[some])

    return run


def _align(items, seeds: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        keep = seeds.value
        codes, owners = own.codes[keep], own.owners[keep]
        unique = np.unique(codes)
        for whole in batches:
            for batch in text_slices(whole):
                out = {f.name: [] for f in _MATCHES}
                for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                    words = own.numbers(text)
                    for k, (score, end) in _best(own, words, codes, owners, unique).items():
                        share = score / (MATCH * len(own.words[k]))
                        if share >= least:
                            for name, value in zip(_MATCHES.names, (doc_id, text_hash, own.ids[k], share, end), strict=True):
                                out[name].append(value)
                yield batch_of(_MATCHES, **out)

    return run


def _best(own: Items, words: np.ndarray, codes, owners, unique) -> dict[int, tuple[int, int]]:
    """Best alignment of each item that has a seed in ``words``; near seeds of an item are aligned in one passage."""
    best: dict[int, tuple[int, int]] = {}
    places: dict[int, list[int]] = {}
    at = own.hits(words, unique)
    if len(at):
        grams = own.grams(words)[at]
        low, high = np.searchsorted(codes, grams, "left"), np.searchsorted(codes, grams, "right")
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in owners[a:b].tolist():
                places.setdefault(k, []).append(p)
    for k, found in places.items():
        item = own.words[k]
        reach = 2 * len(item)
        i = 0
        while i < len(found):
            j = i
            while j + 1 < len(found) and found[j + 1] - found[j] <= reach:
                j += 1
            begin = max(0, found[i] - reach)
            score, end = aligned(item, words[begin : found[j] + reach])
            if score > best.get(k, (0, 0))[0]:
                best[k] = (score, begin + end)
            i = j + 1
    if 0 < len(words) < GRAM or any(len(w) < GRAM for w in own.words):
        for k, item in enumerate(own.words):  # items or texts too short for a seed are compared whole
            if 0 < len(item) < GRAM and len(words) >= len(item) and np.isin(item, words).any():
                score, end = aligned(item, words)
                if score > best.get(k, (0, 0))[0]:
                    best[k] = (score, end)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rare: float = RARE, score: float = SCORE) -> DataFrame:
    """Pairs ``doc_id, text_hash, item_id, score, end_word``: documents that hold a copy of a test item, exact or edited.

    ``score`` is the alignment's share of a full match, at least the given one; ``end_word`` is where it ends. Null and
    empty texts and items match nothing. Repeated rows give repeated pairs. The documents are read twice, for the counts
    and for the search, and never shuffled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    total = texts.count()
    found = None
    for block in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]  # bounded by the block
        own = Items(rows)
        shared = spark.sparkContext.broadcast(own)
        counted = texts.mapInArrow(_count(shared), from_arrow_schema(_SEEN)).groupBy("code").agg(F.sum("n").alias("n"))
        frequency = {r["code"]: r["n"] for r in counted.collect()}  # n-grams of this block's items only
        keep = spark.sparkContext.broadcast(seeds_of(own, frequency, max(1.0, rare * total)))
        pairs = texts.mapInArrow(_align(shared, keep, score), from_arrow_schema(_MATCHES))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def seeds_of(items: Items, frequency: dict[int, int], most: float) -> np.ndarray:
    """Which (n-gram, item) pairs are seeds: those in ``most`` documents at most, or in twice the item's median at most."""
    n = np.array([frequency.get(int(c), 0) for c in items.codes], np.int64)
    keep = n <= most
    order = np.argsort(items.owners, kind="stable")
    cuts = np.flatnonzero(np.diff(items.owners[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            keep[own] |= n[own] <= 2 * np.median(n[own])
    return keep


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item; they are told apart by id and text."""
    found = contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    keyed = docs.withColumn("_text_hash", F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(found["_id"]) & (keyed["_text_hash"] == found["_hash"])
    return keyed.join(found, same, "left_anti").drop("_text_hash")
