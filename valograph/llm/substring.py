"""Substring dedup by recompression: equal passages get equal interior symbols, which reveal them.

Words are named by content hashes, so a name means the same in every task and no dictionary has to be agreed on. A
document is then recompressed in rounds: runs of a word become one symbol, and in each round every pair of neighbours
whose left symbol falls into the left half of the alphabet and whose right one falls into the right half becomes one
named symbol. Whether a pair forms depends on the pair alone, so two documents that share a passage share its symbols,
except for a few words at either end of the passage.

Symbols that are the least within a span are kept as anchors; every window of ``window`` words has one that depends on
that window alone (or an edge of a long run, or lies inside a run). An anchor is keyed by the words around it. Keys found
in two documents show where windows can repeat, and only windows around such anchors are compared, by 128-bit hashes of their words; whole texts by SHA-256.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, lists_of, mixed, text_slices, words_of, written

ROUNDS = 2
RUN = 4  # a run of as many equal words is one symbol that pairs with nothing
LOST = (RUN - 1) + sum(2**r for r in range(ROUNDS))  # words at a passage's end whose symbols may differ: 6
WIDEST = 2**ROUNDS  # words in a symbol
LAST_ID = 2**63 - 1
_NONE = np.uint64(2**64 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def inverse(a: int) -> int:
    return pow(int(a), -1, 2**64)


class Names:
    """The words of several documents, one after the other, as 64-bit names, with names of all their windows at hand."""

    def __init__(self, documents: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        total = int(self.starts[-1])
        digest = xxhash.xxh3_64_intdigest
        self.words = np.fromiter((digest(w) for d in documents for w in d), np.uint64, total)
        self.document = np.repeat(np.arange(len(documents)), self.sizes)
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    def window(self, start: np.ndarray, length: int) -> np.ndarray:
        """Names of the ``length`` words from each start, equal for equal words wherever they stand.

        Unequal words may have one name too: a name only brings out candidates.
        """
        if self._sums is None:
            n = len(self.words)
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)
            back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse(_BASE), np.uint64))), dtype=np.uint64)
            values = mixed(self.words + np.uint64(1)) * power[:n]
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))), back
        sums, back = self._sums
        return mixed((sums[start + length] - sums[start]) * back[start])


def recompressed(names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, name and length in words of the symbols after all rounds, and whether they are long runs."""
    words, document = names.words, names.document
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    first = np.concatenate(([True], (words[1:] != words[:-1]) | (document[1:] != document[:-1])))
    run_start = np.flatnonzero(first)
    run_length = np.diff(np.append(run_start, n))
    long_run = run_length >= RUN
    keep = np.repeat(~long_run, run_length)
    keep[run_start] = True
    start = np.flatnonzero(keep)
    frozen = np.repeat(long_run, run_length)[start]
    length = np.ones(len(start), np.int64)
    length[frozen] = run_length[long_run]
    name = words[start].copy()
    name[frozen] = mixed(name[frozen] ^ mixed(length[frozen].astype(np.uint64)))
    for r in range(ROUNDS):
        left = (mixed(name + np.uint64(r + 1)) & np.uint64(1)) == 0
        pair = left[:-1] & ~left[1:] & ~frozen[:-1] & ~frozen[1:] & (document[start[:-1]] == document[start[1:]])
        at = np.flatnonzero(pair)
        name[at] = mixed(mixed(name[at]) + name[at + 1])
        length[at] += length[at + 1]
        stay = np.ones(len(start), bool)
        stay[at + 1] = False
        start, name, length, frozen = start[stay], name[stay], length[stay], frozen[stay]
    return start, name, length, frozen


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` consecutive values, at the first of them."""
    pick = np.minimum if least else np.maximum
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


class Anchors:
    """Anchors of all documents in ``names`` for windows of a given length.

    ``key`` and ``place`` name an anchor; it stands for the windows that start in [low, high], counted from the start of
    its document and not yet cut to the document's windows.
    """

    def __init__(self, names: Names, window: int):
        self.names, self.window, n = names, window, len(names.words)
        self.first, self.last = LOST, window - LOST - WIDEST  # where in a window its chosen symbol starts
        start, name, length, long = recompressed(names)
        end_of = names.starts[names.document + 1] if n else np.zeros(0, np.int64)
        begin_of = names.starts[names.document] if n else np.zeros(0, np.int64)
        self.value = np.full(n, _NONE)
        self.value[start[~long]] = mixed(name[~long]) >> np.uint64(1)
        span = self.last - self.first + 1
        found = []
        if n >= span:
            least = _sliding(self.value, span, True)
            inside = names.document[: n - span + 1] == names.document[span - 1 :]
            least = np.where(inside, least, np.uint64(0))
            padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
            p = np.flatnonzero((_sliding(padded, span, False) == self.value) & (self.value != _NONE))
            p = p[(p - self.first >= begin_of[p]) & (p + window - self.last <= end_of[p])]
            found.append((names.window(p - self.first, self.first + window - self.last), p, p - self.last, p - self.first))
        s, e, x = start[long], start[long] + length[long], names.words[start[long]]
        left = s[s > begin_of[s]]
        found.append((mixed(names.window(left - 1, 1 + RUN) + np.uint64(11)), left, left - window + RUN, left - 1))
        right = e[e < end_of[s]]
        found.append((mixed(names.window(right - RUN, RUN + 1) + np.uint64(13)), right, right - window + 1, right - RUN))
        pure = e - s >= window
        found.append((mixed(x[pure] + np.uint64(17)), s[pure], s[pure], e[pure] - window))
        self.key, self.place, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        self.owner = names.document[self.place] if n else np.zeros(0, np.int64)
        self.low, self.high = low - names.starts[self.owner], high - names.starts[self.owner]
        self.in_run = np.zeros(n + 1, np.int64)  # words in long runs before each word
        np.cumsum(np.bincount(np.repeat(s, e - s) + _ranges(e - s), minlength=n)[:n] if n else [], out=self.in_run[1:])

    def suspects(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that may stand elsewhere too, given which anchors do.

        A window that meets no long run has its own least symbol, chosen by that window alone: it must be shared.
        """
        names, n = self.names, len(self.names.words)
        base = names.starts[self.owner]
        last = names.sizes[self.owner] - self.window
        low, high = np.maximum(self.low, 0), np.minimum(self.high, last)
        use = shared & (low <= high)
        marks = np.bincount((base + low)[use], minlength=n + 1) - np.bincount((base + high)[use] + 1, minlength=n + 1)[: n + 1]
        at = np.flatnonzero(np.cumsum(marks)[:n] > 0)
        if not len(at):
            return at
        span = self.last - self.first + 1
        own = np.full(n, _NONE)
        p = self.place[shared]
        p = p[p < n]
        own[p] = self.value[p]
        sure = _sliding(own, span, True)[at + self.first] == _sliding(self.value, span, True)[at + self.first]
        return at[sure | (self.in_run[at + self.window] > self.in_run[at])]


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_SIGHTED = pa.schema([("_id", pa.int64()), ("_order", pa.int64()), ("_hash", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("_whole", pa.int64()), ("_whole2", pa.int64()), ("_keys", pa.list_(pa.int64())), ("_low", pa.list_(pa.int32())), ("_high", pa.list_(pa.int32()))])
_WINDOWS = pa.schema([("_order", pa.int64()), ("_hash", pa.int64()), ("_starts", pa.list_(pa.int32())), ("_name", pa.list_(pa.int64())), ("_name2", pa.list_(pa.int64()))])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Order and identity of a row: its id (a null id comes last) and a hash of its text, for ids that repeat."""
    return docs.withColumns({"_order": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST_ID)), "_hash": F.xxhash64(F.col(text))})


def _sight(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in text_slices(whole_batch):
                documents = [words_of(x) for x in batch.column("text").to_pylist()]
                names = Names(documents)
                found = Anchors(names, window)
                order = np.argsort(found.owner, kind="stable")
                sizes = np.bincount(found.owner, minlength=len(documents))
                digests = [hashlib.sha256(b" ".join(d)).digest() for d in documents]
                whole = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 4).astype(np.int64)
                yield batch_of(
                    _SIGHTED,
                    _id=batch.column("_id"),
                    _order=batch.column("_order"),
                    _hash=batch.column("_hash"),
                    n_words=names.sizes,
                    kept_sha256=[d.hex() for d in digests],
                    _whole=whole[:, 0],
                    _whole2=whole[:, 1],
                    _keys=lists_of(found.key[order].view(np.int64), sizes, pa.int64()),
                    _low=lists_of(found.low[order].astype(np.int32), sizes, pa.int32()),
                    _high=lists_of(found.high[order].astype(np.int32), sizes, pa.int32()),
                )

    return run


def _name_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in text_slices(whole_batch):
                documents = [words_of(x) for x in batch.column("text").to_pylist()]
                names = Names(documents)
                found = Anchors(names, window)
                known = [{(x["low"], x["high"]) for x in spans} for spans in batch.column("_spans").to_pylist()]
                spans = zip(found.owner.tolist(), found.low.tolist(), found.high.tolist(), strict=True)
                at = found.suspects(np.fromiter(((low, high) in known[i] for i, low, high in spans), bool, len(found.key)))
                owner = names.document[at]
                sizes = np.bincount(owner, minlength=batch.num_rows)
                starts = at - names.starts[owner]
                name = np.empty((len(at), 2), np.int64)
                for k, (i, j) in enumerate(zip(owner.tolist(), starts.tolist(), strict=True)):
                    name[k] = struct.unpack(">qq", xxhash.xxh3_128_digest(b" ".join(documents[i][j : j + window])))
                yield batch_of(
                    _WINDOWS,
                    _order=batch.column("_order"),
                    _hash=batch.column("_hash"),
                    _starts=lists_of(starts.astype(np.int32), sizes, pa.int32()),
                    _name=lists_of(name[:, 0], sizes, pa.int64()),
                    _name2=lists_of(name[:, 1], sizes, pa.int64()),
                )

    return run


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of ``window`` words that also start in a row with a smaller id.

    Returns one row per input row (``_id``, ``_order``, ``_hash``, ``n_words``, ``kept_sha256`` of the whole word
    sequence, ``_copied``: the whole text is that of a smaller id), for rows that are no copies the starts of the windows
    (``_order``, ``_hash``, ``_starts``), and the texts that came into question. A null text has no words. A null id comes after all others. Rows that share an
    id are judged each on its own text and never remove from each other.
    """
    if window < 2 * (LOST + WIDEST):
        raise ValueError(f"window must be {2 * (LOST + WIDEST)} words or more")
    source = keyed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), "_id", "text").select("_id", "_order", "_hash", "text")
    sighted = written(source.mapInArrow(_sight(window), from_arrow_schema(_SIGHTED)), "sighted")

    # Texts that are equal as a whole have one top symbol: all but the first are copies, and no evidence for each other.
    whole = ["_whole", "_whole2"]
    several = sighted.groupBy(*whole).agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*whole, "_first")
    rows = written(
        sighted.select("_id", "_order", "_hash", "n_words", "kept_sha256", *whole)
        .join(several, whole, "left")
        .select("_id", "_order", "_hash", "n_words", "kept_sha256", F.coalesce(F.col("_order") > F.col("_first"), F.lit(False)).alias("_copied")),
        "rows",
    )

    found = sighted.select("_order", "_hash", "_whole", F.explode(F.arrays_zip("_keys", "_low", "_high")).alias("_a"))
    # Written before it is joined: only then can adaptive execution split a key that very many rows have.
    shared = written(
        found.select("_whole", F.col("_a._keys").alias("_key"))
        .groupBy("_key")
        .agg(F.min("_whole").alias("_w0"), F.max("_whole").alias("_w1"))
        .where("_w0 <> _w1")
        .select("_key"),
        "shared",
    )
    spans = (
        found.select("_order", "_hash", F.col("_a._keys").alias("_key"), F.col("_a._low").alias("low"), F.col("_a._high").alias("high"))
        .join(shared, "_key")
        .groupBy("_order", "_hash")
        .agg(F.collect_set(F.struct("low", "high")).alias("_spans"))
    )
    suspects = spans.join(rows.where("_copied").select("_order", "_hash"), ["_order", "_hash"], "left_anti")
    texts = written(source.drop("_id").join(suspects, ["_order", "_hash"]), "texts")
    windows = written(texts.mapInArrow(_name_windows(window), from_arrow_schema(_WINDOWS)), "windows")

    named = windows.select("_order", "_hash", F.explode(F.arrays_zip("_starts", "_name", "_name2")).alias("_w")).select(
        "_order", "_hash", F.col("_w._starts").alias("_start"), F.col("_w._name").alias("_name"), F.col("_w._name2").alias("_name2")
    )
    least = named.groupBy("_name", "_name2").agg(F.min("_order").alias("_least"), F.max("_order").alias("_most")).where("_least < _most")
    least = written(least.drop("_most"), "least")
    starts = (
        named.join(least, ["_name", "_name2"])
        .where("_order > _least")
        .groupBy("_order", "_hash")
        .agg(F.collect_set("_start").alias("_starts"))
    )
    return rows, written(starts, "starts"), texts.drop("_spans")


def _cut(window: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, count, digest = [], [], [], []
            for text, starts, copied in zip(*(batch.column(c).to_pylist() for c in (column, "_starts", "_copied")), strict=True):
                words = words_of(text)
                cover = np.zeros(len(words) + 1, np.int32)
                if copied and len(words) >= window:
                    cover[0], cover[-1] = 1, -1
                else:
                    at = np.array(starts or [], np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                stay = np.cumsum(cover)[:-1] == 0
                left = b" ".join(w for w, k in zip(words, stay, strict=True) if k)
                kept.append(left.decode("utf-8", "surrogatepass"))
                count.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
            fields = [(n, batch.column(n)) for n in batch.schema.names if n not in ("_starts", "_copied")]
            fields += [("n_words", pa.array(count, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_sha256", pa.array(digest, pa.string())), ("kept_text", pa.array(kept, pa.string()))]
            yield pa.RecordBatch.from_arrays([c for _, c in fields], names=[n for n, _ in fields])

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Rows with ``kept_text``: the words left after every repeated window is cut out, joined by one space.

    Adds ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``; columns of these names are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    rows, starts, _ = repeated_windows(docs, doc_id, text, window)
    base = keyed(docs.drop(*added), doc_id, text)
    marks = rows.where("_copied").select("_order", "_hash", F.lit(True).alias("_copied")).distinct()
    cuts = starts.join(marks, ["_order", "_hash"], "full")
    joined = base.join(cuts, ["_order", "_hash"], "left").drop("_order", "_hash")
    kept = T.StructType([f for f in joined.schema if f.name not in ("_starts", "_copied")])
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cut(window, text), schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row, without the texts.

    Moves only the texts that came into question; all others are known from the first pass.
    """
    rows, starts, texts = repeated_windows(docs, doc_id, text, window)
    changed = texts.dropDuplicates(["_order", "_hash"]).join(starts, ["_order", "_hash"]).withColumn("_copied", F.lit(False))
    keys = [T.StructField(c, T.LongType()) for c in ("_order", "_hash")]
    added = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    cut = changed.mapInArrow(_cut(window, "text"), T.StructType(keys + added)).select("_order", "_hash", F.col("n_removed").alias("_removed"), F.col("kept_sha256").alias("_digest"))
    gone = F.col("_copied") & (F.col("n_words") >= window)
    return rows.join(cut, ["_order", "_hash"], "left").select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_digest", "kept_sha256")).alias("kept_sha256"),
    )
