"""What the operators of this package share: written intermediate tables, shared file storage, word rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valograph import session

#: A word is a maximal run of characters other than ASCII white space; bytes.split() has the same rule.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; all of this run's are removed at the driver's exit."""
    return session.shared_folder(spark, name, "corpus")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here, columns can be pruned."""
    return session.write_once(df, shared_folder(df.sparkSession, name))


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def lists_of(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive slices of ``values`` as one list per size."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def same_rows(a: str, b: str):
    """Null-safe equality of two columns by name, for joins on ids that may be null."""
    return F.col(a).eqNullSafe(F.col(b))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000):
    """Row ranges of a batch of at most ``most`` bytes of text, one row at least, to bound a task's memory."""
    begin, held = 0, 0
    for i, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if i > begin and held + (size or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)
