"""Event series from the tables of events: records and observation gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.clock import day_of, micros

#: Every fifth key is an act after a reminder; these keys stand for duplicates and non-events.
REMINDED, DUPLICATE, NOT_EVENT = 5, 17, 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the log: uri, lane, kind, start_us, last_us, day, k, reminded, skip_reason (null for a record)."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("uri"), F.col("user_id").alias("lane"), F.col("event_type").alias("kind"), micros("ts").alias("start_us"),
        (micros("ts") + F.floor("value").cast("long") * 1_000_000).alias("last_us"), F.col("ts").cast("date").alias("day"), k.alias("k"),
    )
    reason = F.when(F.col("k") % DUPLICATE == 3, "duplicate").when(F.col("k") % NOT_EVENT == 7, "not_event")
    return raw.withColumn("reminded", F.col("k") % REMINDED == 0).withColumn("skip_reason", reason)


def records(spark: SparkSession, sf_dir: str, cutoff: str | None = None) -> DataFrame:
    """Records of sealed days before the cutoff, without duplicates and non-events. The cutoff reaches the scan."""
    out = events(spark, sf_dir).where("skip_reason is null and kind <> 'error'")
    return (out if cutoff is None else out.where(F.col("day") < F.lit(cutoff).cast("date"))).drop("skip_reason")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in which a lane wasn't observed: its error rows, value minutes long. Watched gaps (odd k) may be void."""
    e = events(spark, sf_dir).where("kind = 'error'")
    end = F.col("start_us") + (F.col("last_us") - F.col("start_us")) * 60
    return e.select("uri", "lane", F.col("start_us").alias("begin_us"), end.alias("end_us"), day_of(F.col("start_us")).alias("day"), (F.col("k") % 2 == 1).alias("voidable"))


#: The same in SQL: rec (records), gap, and ev (all rows).
SQL = r"""
ev AS (SELECT event_id AS uri, user_id AS lane, event_type AS kind, epoch_us(ts) AS start_us,
  epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS last_us, CAST(ts AS DATE) AS day,
  CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 5 = 0 AS reminded,
  CASE WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 17 = 3 THEN 'duplicate'
       WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 23 = 7 THEN 'not_event' END AS skip_reason FROM events),
rec AS (SELECT uri, lane, kind, start_us, last_us, day, k, reminded FROM ev WHERE skip_reason IS NULL AND kind <> 'error'),
gap AS (SELECT uri, lane, start_us AS begin_us, start_us + (last_us - start_us) * 60 AS end_us, day, k % 2 = 1 AS voidable FROM ev WHERE kind = 'error')
"""
