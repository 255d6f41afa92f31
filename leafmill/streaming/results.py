"""Incremental runs: answering what is still open, later corrections, windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.session import scratch


def still_open(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no finished result (``error`` null or empty) yet."""
    finished = done.where(F.coalesce("error", F.lit("")) == "").select(key).distinct()
    return rows.join(finished, key, "left_anti")


def resume(stream: DataFrame, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Answers a stream of requests batch by batch into a parquet table. What a batch wrote before a failure is told by
    its number: a repeated batch replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        work(df.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LATEST = "query_id string, value double, error string, ord long"


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps for each query the latest success, or the latest failure while there is none; tells when it changes."""
    held = state.get if state.exists else None
    was = held
    for pdf in batches:
        for r in pdf.sort_values("ord").itertuples():
            ok = not r.error
            if held is None or (ok, r.ord) >= (not held[1], held[2]):
                held = (float(r.value) if r.value == r.value else None, r.error or "", int(r.ord))
    if held is not None and held != was:
        state.update(held)
        yield pd.DataFrame({"query_id": [key[0]], "value": [held[0]], "error": [held[1]], "ord": [held[2]]})


def corrected(stream: DataFrame) -> DataFrame:
    """A stream of results (``query_id, value, error, ord``) as a stream of what stands for each query: a later row
    replaces an earlier failure, a failure never a success."""
    return stream.groupBy("query_id").applyInPandasWithState(_latest, LATEST, "value double, error string, ord long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of events (``ts, event_type, value``) in tumbling or sliding windows; with ``late``, behind a
    watermark. The same expression serves tables and streams."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of a user's events with no gap of ``gap`` or more."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table in the shared folder: the last one of
    ``complete`` mode, all changes otherwise. Nothing passes through the driver; a repeated batch replaces its own files."""
    spark: SparkSession = stream.sparkSession
    path = scratch(spark, "stream")
    kept = f"{path}/rows"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(kept if mode == "complete" else f"{kept}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(kept).select(*stream.columns)
