"""Structured Streaming forms of the event operators.

Each takes a streaming DataFrame of events (event_id, ts, user_id, event_type, value, props) with ts as a timestamp, and
returns a streaming DataFrame; `drained` runs one to the end of what is there and returns its rows. State of sessions,
windows and deliveries is bounded by the watermark: they are emitted, or forgotten, once it has passed their end. Running accounts
keep three numbers a class for good, and take a class's rows in the order of their batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.sources import folders

DELAY = "2 hours"


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The log as a stream of files, with the batch reader's schema."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event*.parquet")
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, gap: str = "45 minutes", delay: str = DELAY) -> DataFrame:
    """Acts of a class at most `gap` apart as one session."""
    by = stream.withWatermark("ts", delay).groupBy("user_id", "event_type", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", "event_type", F.col("w.start").alias("start"), "last", "n")


def slot_counts(stream: DataFrame, width: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    by = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def deduplicated(stream: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """One row a delivery id; ids are forgotten once the watermark has passed them."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def running_accounts(stream: DataFrame, half_life: float = 8.0) -> DataFrame:
    """Decayed good and all evidence of each class after each micro-batch: the tally itself is the state (two numbers)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, n, count = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        keep = 0.5 ** (1 / half_life)
        for came, strength in zip(rows["came"], rows["strength"], strict=True):
            k, n, count = k * keep + (strength if came else 0.0), n * keep + strength, count + 1
        state.update((k, n, count))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "k": [k], "n": [n], "opportunities": [count]})

    schema = "user_id long, event_type string, k double, n double, opportunities long"
    return stream.groupBy("user_id", "event_type").applyInPandasWithState(step, schema, "k double, n double, count long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over all there is now and returns what it wrote. Output and checkpoint lie below the session's
    checkpoint folder."""
    spark = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}" if folder else folders.shared(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def tick(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str = "900 seconds"):
    """Calls step(batch, number) every `every`; a step that failed is run again with the same rows."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
