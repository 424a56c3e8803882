"""Delivery of events as a stream: claims, settlement and dead letters per event."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.scratch import scratch_path

MAX_ATTEMPTS, CAP_S = 8, 300
STATE = "event_id long, attempts int, outcome string"


def retry_delay(event_id: uuid.UUID, attempt: int) -> float:
    """Seconds to wait after ``attempt``: doubling from one, a quarter of jitter by hash, at most ``CAP_S``."""
    attempt = max(1, attempt)
    if attempt >= 10:
        return float(CAP_S)
    base = 1000 << (attempt - 1)
    digest = hashlib.sha256(event_id.bytes + attempt.to_bytes(4, "big")).digest()
    return min(base + int.from_bytes(digest, "big") % (base // 4 + 1), CAP_S * 1000) / 1000


def _deliver(key, frames, state):
    """Attempts of one event in order; the first success settles it, a terminal failure or the last attempt buries it."""
    import pandas as pd

    attempts, outcome = state.get if state.exists else (0, "PENDING")
    for row in pd.concat(frames).sort_values("seq").itertuples(index=False):
        if outcome != "PENDING":
            continue  # at least once: repeats of a settled event change nothing
        attempts += 1
        if row.result == "ok":
            outcome = "DELIVERED"
        elif row.result == "terminal" or attempts >= MAX_ATTEMPTS:
            outcome = "DEAD_LETTER"
    state.update((attempts, outcome))
    yield pd.DataFrame([(key[0], attempts, outcome)], columns=["event_id", "attempts", "outcome"])


def run_delivery(attempts: DataFrame) -> DataFrame:
    """Latest event_id, attempts, outcome of a streaming ``attempts`` (event_id, seq, result), run to its end."""
    spark = attempts.sparkSession
    states = attempts.groupBy("event_id").applyInPandasWithState(_deliver, STATE, "attempts int, outcome string", "update", "NoTimeout")
    out, checkpoint = scratch_path(spark, "delivery"), scratch_path(spark, "delivery-checkpoint")

    def store(batch: DataFrame, epoch: int) -> None:
        # A batch that is run again after a loss overwrites its own folder.
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(STATE + ", epoch long").parquet(out)
    return rows.groupBy("event_id").agg(F.max_by(F.struct("attempts", "outcome"), "epoch").alias("s")).select("event_id", "s.attempts", "s.outcome")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(sf_dir)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by event time; a native extra, run to the stream's end."""
    spark = events.sparkSession
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    name = "windows_" + scratch_path(spark, "w").rsplit("-", 1)[1]
    query = counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
