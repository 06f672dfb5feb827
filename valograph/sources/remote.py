"""Batched remote lookups: as a Spark data source with one partition per chunk of ids, or over a table of ids in its tasks.

A lookup that a service turns away for a while is asked again inside the task, after growing pauses; a task that still
fails is retried by Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Answers of a service that a later attempt may better.
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)
GOOD = range(200, 300)


class LookupFailed(RuntimeError):
    """A lookup that was answered by an error, or that failed in all its attempts."""


def with_retries(
    fetch: Callable[[list[str]], list[str] | tuple[int, list[str]]], attempts: int = 5, pause: float = 1.0, longest: float = 60.0
) -> Callable[[list[str]], list[str]]:
    """``fetch`` asked up to ``attempts`` times, with pauses that double up to ``longest`` seconds.

    ``fetch`` returns payloads, or a status with payloads. Broken connections, time-outs and ``TRANSIENT`` statuses are
    asked again; any other status outside 200 to 299 fails at once, so that a wrong request isn't repeated. No ids ask nothing.
    """

    def run(ids: list[str]) -> list[str]:
        if not ids:
            return []
        for attempt in range(attempts):
            if attempt:
                time.sleep(min(longest, pause * 2 ** (attempt - 1)))
            try:
                answer = fetch(ids)
            except (ConnectionError, TimeoutError) as error:
                last = repr(error)
                continue
            status, payloads = answer if isinstance(answer, tuple) else (200, answer)
            if status in GOOD:
                return payloads
            last = f"status {status}"
            if status not in TRANSIENT:
                raise LookupFailed(f"{last} for {len(ids)} ids from {ids[0]!r}")
        raise LookupFailed(f"{last} after {attempts} attempts for {len(ids)} ids from {ids[0]!r}")

    return run


class _Chunk(InputPartition):
    def __init__(self, ids: Sequence[str]):
        self.ids = list(ids)


class _Reader(DataSourceReader):
    def __init__(self, ids: Sequence[str], chunk: int, fetch: Callable[[list[str]], list[str]]):
        self.ids, self.chunk, self.fetch = list(ids), chunk, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Chunk(self.ids[i : i + self.chunk]) for i in range(0, len(self.ids), self.chunk)]

    def read(self, partition: _Chunk) -> Iterator[tuple[str]]:
        for payload in self.fetch(partition.ids):
            yield (payload,)


def payload_source(name: str, ids: Sequence[str], fetch: Callable[[list[str]], list[str]], chunk: int = 50) -> type[DataSource]:
    """A data source that yields the JSON payloads ``fetch`` returns for each chunk of ids."""

    class PayloadSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "payload string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(ids, chunk, fetch)

    return PayloadSource


def fetch_payloads(
    df: DataFrame, id_col: str, fetch: Callable[[list[str]], list[str]], chunk: int = 50, attempts: int = 5, pause: float = 1.0
) -> DataFrame:
    """The same lookup for ids that are a table: each task asks for the distinct ids of its rows in chunks, with retries.

    No id passes the driver. Ids are dealt by their value, so that one asked for in many rows is asked once; null is not.
    """
    import pandas as pd

    ask = with_retries(fetch, attempts, pause)

    def run(batches):
        held: list[str] = []
        for batch in batches:
            held += batch["_id"].tolist()
            while len(held) >= chunk:
                yield pd.DataFrame({"payload": ask(held[:chunk])})
                held = held[chunk:]
        if held:
            yield pd.DataFrame({"payload": ask(held)})

    ids = df.select(df[id_col].cast("string").alias("_id")).where("_id is not null").distinct()
    return ids.mapInPandas(run, "payload string")


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
