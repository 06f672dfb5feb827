"""Ranked lexical search of many queries at once, with sums that queries share computed once per document.

The terms of a tile of queries are mined for what they share: terms that the same queries hold are one leaf, and rounds
of pairing name every pair of neighbours that two queries or more have in common. The pairs form a graph in which a query
is a node and every node adds two others. A document's leaves are filled from its terms' weights, each node is computed
once, level by level for many documents at a time, and every query reads its score off its node.

Documents are read once: they become postings of query terms, from which the counts of the corpus and then the scores are
taken. A task keeps the best documents of each query only; the last step ranks what the tasks kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, lists_of, text_slices, written

TOP = 50
BLOCK = 16_000_000  # bytes of query text answered by one pass; more text takes more passes, each over all documents
TILE = 128_000  # bytes of query text that are mined together
CELLS = 4_000_000  # sums a task holds at once, nodes times documents

ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_PLAN = pa.schema(
    [("item_ids", pa.list_(pa.int64())), ("roots", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("leaves", pa.list_(pa.int32()))]
    + [("sizes", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]
)
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_BEST = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(ALNUM).split() if text else []


def sharing_plan(queries: list[list[bytes]]) -> dict:
    """The graph for the term lists of some queries.

    ``leaves`` gives the leaf of each of ``terms``. Levels follow one another in ``sizes``; the nodes of a level are the
    next numbers, and each is the sum of its ``left`` and ``right`` node, both of lower levels. ``roots`` has the node of
    each query, -1 for one without terms.
    """
    holders: dict[bytes, list[int]] = {}
    for k, terms in enumerate(queries):
        for term in set(terms):
            holders.setdefault(term, []).append(k)
    leaf_of: dict[tuple, int] = {}
    leaves = {t: leaf_of.setdefault(tuple(held), len(leaf_of)) for t, held in sorted(holders.items())}
    # Often shared leaves come first in every query, so that common parts stand side by side.
    rows: list[list[int]] = [[] for _ in queries]
    for held, leaf in sorted(leaf_of.items(), key=lambda x: (-len(x[0]), x[1])):
        for k in held:
            rows[k].append(leaf)

    nodes, sizes, left, right = len(leaf_of), [], [], []
    while any(len(row) > 1 for row in rows):
        seen = Counter(pair for row in rows for pair in zip(row, row[1:], strict=False))
        least = 2 if max(seen.values()) > 1 else 1  # when nothing is shared any more, each query is added up by halves
        made: dict[tuple[int, int], int] = {}
        for k, row in enumerate(rows):
            out, i = [], 0
            while i < len(row):
                pair = tuple(row[i : i + 2])
                after = tuple(row[i + 1 : i + 3])
                if len(pair) == 2 and seen[pair] >= least and (len(after) < 2 or seen[pair] >= seen[after]):
                    out.append(made.setdefault(pair, nodes + len(made)))
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            rows[k] = out
        nodes += len(made)
        sizes.append(len(made))
        left += [a for a, _ in made]
        right += [b for _, b in made]
    return {"roots": [row[0] if row else -1 for row in rows], "terms": list(leaves), "leaves": list(leaves.values()), "sizes": sizes, "left": left, "right": right}


def _mine(table: pa.Table) -> pa.Table:
    """The plan of a tile of queries, one row."""
    rows = table.select(["item_id", "text"]).to_pylist()
    rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    plan = sharing_plan([terms_of(r["text"]) for r in rows]) | {"item_ids": [r["item_id"] for r in rows]}
    return pa.table({f.name: pa.array([plan[f.name]], f.type) for f in _PLAN}, schema=_PLAN)


class Tile:
    """A tile's plan with its leaves by the number of a term among all tiles' terms."""

    def __init__(self, row, numbers: dict[bytes, int], first: int):
        self.ids = list(row["item_ids"])
        self.roots = np.array(row["roots"], np.int64)
        self.first = first
        self.leaf_of = [(numbers[bytes(t)], leaf) for t, leaf in zip(row["terms"], row["leaves"], strict=True)]
        self.width = max(row["leaves"], default=-1) + 1
        left, right, self.levels, done = np.array(row["left"], np.int64), np.array(row["right"], np.int64), [], 0
        for size in row["sizes"]:
            self.levels.append((self.width + done, left[done : done + size], right[done : done + size]))
            done += size
        self.nodes = self.width + done

    def leaves(self, terms: int) -> np.ndarray:
        out = np.full(terms, -1, np.int64)
        for number, leaf in self.leaf_of:
            out[number] = leaf
        return out

    def scores(self, leaf: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int) -> np.ndarray:
        """Scores of all the tile's queries for some documents: a row per query, a column per document."""
        sums = np.zeros((self.nodes + 1, columns), np.int64)  # the last row is that of queries without terms
        np.add.at(sums.reshape(-1), leaf * columns + column, value)
        for begin, left, right in self.levels:
            sums[begin : begin + len(left)] = sums[left] + sums[right]
        return sums[self.roots]


def _postings(numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers.value
        for whole in batches:
            for batch in text_slices(whole):
                ids, sizes, lengths, terms, tfs = [], [], [], [], []
                for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    held = [(own[t], n) for t, n in Counter(words).items() if t in own]
                    ids.append(doc_id)
                    lengths.append(len(words))
                    sizes.append(len(held))
                    terms += [t for t, _ in held]
                    tfs += [n for _, n in held]
                sizes = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        lists_of(np.array(terms, np.int32), sizes, pa.int32()),
                        lists_of(np.array(tfs, np.int64), sizes, pa.int64()),
                    ],
                    schema=_POSTINGS,
                )

    return run


class Best:
    """The best documents of some queries so far, by score, then by id with null last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.least = np.ones(queries, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # query, score, whether the id is null, id

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, column = np.nonzero(scores >= self.least[:, None])
        if not len(query):
            return
        new = np.stack([query, scores[query, column], null[column], ids[column]])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        begin = np.searchsorted(rows[0], np.arange(len(self.least)))
        place = np.arange(rows.shape[1]) - begin[rows[0]]
        self.rows = rows[:, place < self.top]
        last = self.rows[:, place[place < self.top] == self.top - 1]
        self.least[last[0]] = last[1]  # an equal score may still have a smaller id


def _rank(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, weights, docs, length = shared.value
        best = [Best(len(t.ids), top) for t in tiles]
        leaves = [t.leaves(len(weights)) for t in tiles]
        step = max(1, CELLS // max((t.nodes + 1 + len(t.ids) for t in tiles), default=1))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                n = batch.column("n").to_numpy()
                null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
                term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
                column = np.repeat(np.arange(batch.num_rows), sizes)
                norm = 100 - 50 + (50 * n * docs) // length
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[column]))
                for tile, leaf_of, kept in zip(tiles, leaves, best, strict=True):
                    leaf = leaf_of[term]
                    held = leaf >= 0
                    kept.add(tile.scores(leaf[held], column[held], value[held], batch.num_rows), ids, null)
        for tile, kept in zip(tiles, best, strict=True):
            query, score, null, doc_id = kept.rows
            yield batch_of(
                _BEST,
                item=query + tile.first,
                item_id=[tile.ids[q] for q in query.tolist()],
                doc_id=pa.array(doc_id, mask=null.astype(bool)),
                score=score,
            )

    return run


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def ranked(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each query with a score above 0.

    A score sums, over the query's terms, the term's weight times its damped frequency, in integers (``weight``,
    ``_rank``). Equal scores go by ascending id, null ids last. Ids are 64-bit integers. Null and empty texts hold no
    term and are not ranked, as queries they find nothing. Repeated documents are ranked each on its own. Repeated
    queries (equal id and text) are one; queries that share an id only are ranked each on its own. Other columns are not
    read. Empty tables give no rows.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = queries.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, tiles = max(1, -(-size // BLOCK)), max(1, -(-min(size, BLOCK) // TILE))
    place = F.xxhash64("item_id", "text")
    items = written(items.select("*", F.pmod(place, F.lit(blocks)).alias("block"), F.pmod(F.shiftrightunsigned(place, 20), F.lit(tiles)).alias("tile")), "queries")
    found = [_block(texts, items.where(F.col("block") == k), top).withColumn("block", F.lit(k)) for k in range(blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """The best documents that each task found for the queries of a block, whose plans are at most ``BLOCK`` in text."""
    context = texts.sparkSession.sparkContext
    plans = items.groupBy("tile").applyInArrow(_mine, from_arrow_schema(_PLAN)).collect()  # bounded by BLOCK
    numbers: dict[bytes, int] = {}
    for row in plans:
        for term in row["terms"]:
            numbers.setdefault(bytes(term), len(numbers))
    postings = written(texts.mapInArrow(_postings(context.broadcast(numbers)), from_arrow_schema(_POSTINGS)), "postings")
    docs, length = postings.agg(F.count("*"), F.sum("n")).first()
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # the queries' terms only
    weights = np.zeros(len(numbers), np.int64)
    for row in holding:
        weights[row["term"]] = weight(docs, row["count"])
    tiles, first = [], 0
    for row in plans:
        tiles.append(Tile(row, numbers, first))
        first += len(tiles[-1].ids)
    shared = context.broadcast((tiles, weights, docs, length))
    return postings.where(F.size("terms") > 0).mapInArrow(_rank(shared, top), from_arrow_schema(_BEST))
