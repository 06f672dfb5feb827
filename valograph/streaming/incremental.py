"""Scoring newly accepted contexts as files arrive. Only edges without a score are scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from valograph.operators.relational import best_per_key
from valograph.operators.scoring import unscored


def stream_scores(
    spark: SparkSession,
    contexts_path: str,
    contexts_schema: str,
    scores_path: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Score each batch of new context files and append to the score table.

    A batch first drops edges the table already has, and writes under its batch id, so a batch run again after a
    failure replaces its own output.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        one = best_per_key(batch, ["edge_id"], [F.desc("num_mentions")])
        earlier = _earlier(spark, scores_path, batch_id)
        todo = one if earlier is None else unscored(one, earlier)
        score(todo).write.mode("overwrite").parquet(f"{scores_path}/batch={batch_id}")

    source = spark.readStream.schema(contexts_schema).parquet(contexts_path)
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _earlier(spark: SparkSession, scores_path: str, batch_id: int) -> DataFrame | None:
    if batch_id == 0:
        return None
    return spark.read.parquet(scores_path).where(F.col("batch") < batch_id)
