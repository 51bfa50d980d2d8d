"""Structured Streaming over finite or live sources: deduplicated, late-tolerant hourly sums, validated micro-batches, sessions and
per-key freshness state. The batch operators define the results; streams reach them within the watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def with_event_time(rows: DataFrame, at: str, delay: str = "30 minutes") -> DataFrame:
    """A watermark needs a timestamp with time zone; the session's is UTC."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def deduplicated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first arrival of each key within the watermark; state is dropped with it."""
    return rows.dropDuplicatesWithinWatermark(key)


def hourly(rows: DataFrame, at: str, entity: str, value: str, slide: str | None = None) -> DataFrame:
    """Sum, count and maximum per entity and hour (tumbling, or sliding by `slide`)."""
    return rows.groupBy(F.window(at, "1 hour", slide or "1 hour").alias("w"), entity).agg(F.sum(value).alias("target"), F.count("*").alias("n"), F.max(value).alias("most")).select(F.col("w.start").alias("ts"), F.col(entity).alias("entity_id"), "target", "n", "most")


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def freshness_state(rows: DataFrame, key: str, at: str, idle_ms: int | None = None) -> DataFrame:
    """(key, latest, n) updates: the newest event time and the number of events of each key so far. With idle_ms, a key's state
    goes once the watermark is that far beyond its newest event. (A timeout by the clock would keep a run that takes what is
    available from ever ending.)"""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            top = pdf[at].max()
            top = None if pd.isna(top) else int(top.timestamp() * 1_000_000)
            latest = top if latest is None else latest if top is None else max(latest, top)
            n += len(pdf)
        state.update((latest, n))
        if idle_ms is not None and latest is not None:
            state.setTimeoutTimestamp(max(latest // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "latest": [pd.Timestamp(latest, unit="us") if latest is not None else pd.NaT], "n": [n]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, latest timestamp, n long", "latest long, n long", "update", "NoTimeout" if idle_ms is None else "EventTimeTimeout")


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Everything available, in micro-batches, into files; exactly once by the checkpoint."""
    q = rows.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def validated(rows: DataFrame, check: Callable[[DataFrame], tuple[DataFrame, DataFrame]], valid_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Splits each micro-batch into valid and rejected rows. Batches write to folders of their own number, so a batch that is run
    again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good, bad = check(batch)
            good.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        finally:
            batch.unpersist()

    q = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
