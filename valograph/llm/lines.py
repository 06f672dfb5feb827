"""Line dedup by ranges of line hashes: a line that an earlier document holds goes, its first document keeps it.

DataFrame functions only. Every line of some length becomes a row of hash, document and position, without its text. The
rows are dealt by ranges of the hash and sorted within a range by document and position, so that a running first value
tells for each row whether another document came before. What comes back is a keep bitmap per document, in 64-bit words
of which those that keep all their lines are left out; a text is met by its bitmap only, never by other texts.

A hash that fills more than a range is cut over several by a hash of the document. Each of those finds its own first
document, and a second round among these few decides.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valograph.llm.shared import written

LEAST = 10  # code points of a line's key; shorter lines always stay
BLANKS = " \t\n\x0b\x0c\r"
BUCKETS = 2**16  # values of a hash's first two bytes

#: Words of 64 lines each. The one-element array binds the split text to a name, so that it is split once.
_KEPT_TEXT = r"""
transform(array(split(coalesce(text, ''), '\n', -1)), lines -> array_join(transform(array_except(
    sequence(0, size(lines) - 1),
    flatten(transform(keep_bitmap, w -> filter(
        sequence(w.word * 64, w.word * 64 + 63), p -> shiftright(w.keep, p - w.word * 64) & 1 = 0)))
), p -> lines[p]), '\n'))[0]
"""


def line_keys(text: str) -> F.Column:
    """The lines of a text as they are compared: A-Z in lower case, ASCII white space stripped at both ends."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lower, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, hash, bucket`` of each line whose key has ``LEAST`` code points or more."""
    keys = docs.select("doc_id", "text_hash", F.posexplode(line_keys("text")).alias("pos", "key"))
    hexadecimal = keys.where(F.length("key") >= LEAST).withColumn("hex", F.substring(F.sha2("key", 256), 1, 32))
    bucket = F.conv(F.substring("hex", 1, 4), 16, 10).cast("int")
    return hexadecimal.select("doc_id", "text_hash", "pos", F.unhex("hex").alias("hash"), bucket.alias("bucket"))


def later_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``later``: whether a document with a smaller id comes before within the same ``keys``.

    Null ids come last and count as one document.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "pos")
    first = F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.repartitionByRange(*keys).withColumn("later", ~F.col("doc_id").eqNullSafe(first))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_dropped, keep_bitmap`` of the documents that lose lines.

    ``keep_bitmap`` is an array of ``word, keep``: bit ``p`` of ``keep`` tells whether line ``64 * word + p`` stays. Words
    that keep all are left out, and so are documents that keep all. ``text_hash`` (of Spark's ``xxhash64``) tells rows of
    the same id apart; rows with equal id and text share a bitmap.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = written(hashed_lines(texts), "lines")

    # How many lines each of the 65,536 buckets has: small enough to broadcast, and exact.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")), "line_buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    room = max(1.0, total / ranges, 4 * total / BUCKETS)
    cuts = sizes.select("bucket", F.ceil(F.col("n") / F.lit(room)).alias("pieces"))
    dealt = rows.join(F.broadcast(cuts), "bucket").withColumn("piece", F.pmod(F.xxhash64("doc_id"), "pieces"))

    first = later_lines(dealt, "hash", "piece").where(F.col("later") | (F.col("pieces") > 1))
    first = written(first.select("hash", "doc_id", "text_hash", "pos", "later"), "line_firsts")
    second = later_lines(first.where(~F.col("later")), "hash").where("later")
    dropped = first.where("later").unionByName(second).select("doc_id", "text_hash", "pos")

    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("gone")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("keep_bitmap"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` as ``own`` (a struct of its columns) with ``n_lines, n_dropped, kept_text``.

    A text is split at line feeds; null and empty texts are one empty line. Lines whose key (see ``line_keys``) has
    ``LEAST`` code points or more and that two documents or more hold are dropped, except in the document with the
    smallest id, which keeps all of them. Ids are compared as 64-bit integers, null last. Rows with the same id are one
    document: none takes a line from another. Own columns may have any names, since they stay inside ``own``.
    """
    bitmaps = keep_bitmaps(docs, doc_id, text).withColumnsRenamed({"doc_id": "other_id", "text_hash": "other_hash"})
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))
    rows = whole.select("own", F.col(f"own.`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"own.`{text}`").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    met = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), "left")
    n_lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return met.select(
        "own",
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("keep_bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(_KEPT_TEXT)).alias("kept_text"),
    )
