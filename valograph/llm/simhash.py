"""SimHash near-duplicate groups, with candidates from pigeonring filtering.

A fingerprint is cut into four segments of 16 bits on a ring. If two fingerprints differ in at most three bits, some
segment starts a chain whose first segment differs in no bit, whose first two differ in at most one, whose first three
in at most two, and all four in at most three: the proportional budget of each prefix, rounded down. Candidates are
joined on what the first three segments of such a chain must share: the first segment whole, and two bytes of the next
two, since at most one of the second segment's bytes and at most two of the four bytes can differ. The chain's prefixes
are then tested one after the other, and the whole distance last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.components import smallest_reachable
from valograph.llm.shared import batch_of, text_slices, words_of, written

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
BLOCK = 1024  # fingerprints of a bucket that are compared at once; a larger bucket is cut into pairs of blocks
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bytes(*which: int) -> int:
    return sum(0xFF << (8 * i) for i in which)


def _chain_masks() -> tuple[list[int], list[tuple[int, int]]]:
    """For each way to join: the bits that must agree, and the bits of the chain's first two and first three segments."""
    joined, prefixes = [], []
    for i in range(SEGMENTS):
        first = (2 * i, 2 * i + 1)
        a0, a1, b0, b1 = (x % 8 for x in range(2 * i + 2, 2 * i + 6))
        for second in ((a0, a1), (a0, b0), (a0, b1), (a1, b0), (a1, b1)):
            joined.append(_bytes(*first, *second))
            prefixes.append((_bytes(*first, a0, a1), _bytes(*first, a0, a1, b0, b1)))
    return joined, prefixes


JOINED, PREFIXES = _chain_masks()
_SECOND = np.array([p[0] for p in PREFIXES], np.uint64)
_THIRD = np.array([p[1] for p in PREFIXES], np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit i is set where more than half of the shingles' hashes have it; 0 for a text without words."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if len(words) >= SHINGLE:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
        count = len(words) - SHINGLE + 1
    elif words:
        shingles, count = iter([b" ".join(words)]), 1
    else:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    # How often each byte value stands at each of the eight places says how often each bit is set.
    places = hashes.view(np.uint8).reshape(count, 8).astype(np.int64) + 256 * np.arange(8)
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > count).ravel(), bitorder="little").view(np.uint64)[0])


_PRINTED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("simhash", pa.int64())])


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield batch_of(_PRINTED, doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), simhash=values.view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``simhash`` (64 bits as a signed long) of every row; a null text has no words."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(_print, from_arrow_schema(_PRINTED))


def near(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which differences ``x`` keep the budgets of the chain of ``table``; each test sees what the one before let pass."""
    ok = np.flatnonzero(np.bitwise_count(x & _SECOND[table]) <= 1)
    ok = ok[np.bitwise_count(x[ok] & _THIRD[table[ok]]) <= 2]
    return ok[np.bitwise_count(x[ok]) <= DISTANCE]


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each unit (rows with one ``unit``, which follow each other): enough to connect all that are near."""
    held = None

    def links(unit, table, value):
        cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        sizes = np.diff(np.append(cuts, len(unit)))
        small = np.repeat(sizes <= 8, sizes)
        from_, to = [], []
        for d in range(1, 8):
            i = np.flatnonzero(small[:-d] & (unit[:-d] == unit[d:])) if len(unit) > d else np.zeros(0, np.int64)
            i = i[near(value[i] ^ value[i + d], table[i])]
            from_.append(value[i])
            to.append(value[i + d])
        for start, size in zip(cuts[sizes > 8], sizes[sizes > 8], strict=True):
            own = value[start : start + size]
            label = np.arange(size)
            rows, columns = [], []
            for i in range(0, size, 256):
                x = own[i : i + 256, None] ^ own[None, :]
                pick = near(x.ravel(), np.broadcast_to(table[start], x.size))
                rows.append(i + pick // size)
                columns.append(pick % size)
            rows, columns = np.concatenate(rows), np.concatenate(columns)
            while True:  # least index within reach: a spanning star instead of all pairs
                lower = label.copy()
                np.minimum.at(lower, rows, label[columns])
                lower = lower[lower]
                if (lower == label).all():
                    break
                label = lower
            from_.append(own)
            to.append(own[label])
        a, b = np.concatenate(from_), np.concatenate(to)
        apart = a != b
        return batch_of(_LINKED, a=a[apart].view(np.int64), b=b[apart].view(np.int64))

    for batch in batches:
        new = [batch.column("unit").to_numpy(), batch.column("table").to_numpy(), batch.column("value").to_numpy().view(np.uint64)]
        if held is not None:
            new = [np.concatenate(p) for p in zip(held, new, strict=True)]
        last = np.searchsorted(new[0], new[0][-1]) if len(new[0]) else 0
        if last:
            yield links(*(p[:last] for p in new))
        held = [p[last:] for p in new]
    if held is not None and len(held[0]):
        yield links(*held)


def links_of(values: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct values of ``simhash`` that differ in at most three bits."""
    value = F.col("value")
    masks = [m - 2**64 if m >= 2**63 else m for m in JOINED]
    keyed = values.select(F.col("simhash").alias("value"), F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("table", "key"))
    counted = keyed.withColumn("n", F.expr("count(*) over (partition by table, key)")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(value), blocks).cast("int")
    # A bucket of one block is one unit; of a larger one, every pair of blocks is.
    units = counted.withColumns({"own": own, "blocks": blocks}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(F.xxhash64("table", "key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "table", "value")
    return units.repartition("unit").sortWithinPartitions("unit", "table").mapInArrow(_link, from_arrow_schema(_LINKED)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, simhash, root, component_id``: the latter is the smallest id that links of three bits or fewer
    reach, ``root`` the least fingerprint.

    One row per input row. Rows without words have fingerprint 0 and are linked like any other. Rows with a null id
    link others; their own component has a null id only if no row in it has one.
    """
    prints = written(fingerprints(docs, doc_id, text), "prints")
    distinct = written(prints.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = smallest_reachable(links_of(distinct.select("simhash")))
    rooted = written(distinct.join(roots, distinct["simhash"] == roots["node"], "left").select("simhash", "least", "n", F.coalesce("root", "simhash").alias("root")), "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select(F.col("simhash").alias("_value"), "root", "component_id", "n")
    # At most 1,000 values can each hold more than a thousandth of the rows: those are broadcast, the rest shuffled.
    rows = prints.count()
    own = prints["simhash"] == named["_value"]
    common = F.broadcast(named.where(F.col("n") * 1000 > rows))
    rest = prints.join(common, own, "left_anti").join(named.where(F.col("n") * 1000 <= rows), own)
    return prints.join(common, own).unionByName(rest).select("doc_id", "text_hash", "simhash", "root", "component_id")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stands for each group: that with the smallest id (null last), then the least hash
    of the text; of equal rows one."""
    groups = near_duplicates(docs, doc_id, text)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("_id"), F.col("c.text_hash").alias("_hash"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(chosen["_id"]) & (keyed["_text_hash"] == chosen["_hash"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates([doc_id, "_text_hash"]).drop("_text_hash")
