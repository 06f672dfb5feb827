"""Session helpers: a local session factory and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_CLEANED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, app: str = "valograph") -> SparkSession:
    """Session for tests and the local bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = configured or tempfile.mkdtemp(prefix="valograph-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str, kind: str = "tables") -> str:
    """A new folder below the cluster's shared checkpoint folder; all of this run's are removed at the driver's exit."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{_RUN}"
    if root not in _CLEANED:
        _CLEANED.add(root)
        atexit.register(delete, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_once(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet and read back; its shuffle files go."""
    with brief_shuffles(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends here, columns can be pruned."""
    names = {c.lower() for c in df.columns}
    if len(names) < max(1, len(df.columns)) or "void" in df.schema.simpleString():  # Parquet has no such columns
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    folder = shared_folder(df.sparkSession, "table")
    out = write_once(df, folder)
    out._written_to = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``materialise`` that nothing reads any more."""
    for df in tables:
        folder = getattr(df, "_written_to", None)
        if folder:
            delete(df.sparkSession, folder)


def shuffles_of(rdd: RDD) -> list[int]:
    """Number of the shuffle that an RDD from ``partitionBy`` reads."""
    below = rdd._jrdd.rdd().dependencies().head()
    while below.getClass().getSimpleName() != "ShuffleDependency":
        below = below.rdd().dependencies().head()
    return [below.shuffleId()]


def drop_shuffles(spark: SparkSession, numbers: list[int]) -> None:
    """Remove the files of shuffles that nothing reads any more."""
    cleaner = spark.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined():
        for n in numbers:
            cleaner.get().doCleanupShuffle(n, False)
