"""Queries that run a stream to its end, and SQL over what it must have emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.sources import series as S
from cadenza.streaming import jobs as J


def _us(c):
    """Microseconds of the wall clock, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def stream_sessions(spark, d):
    out = J.drained(J.sessions(J.events(spark, d)))
    return out.select("user_id", "event_type", _us(F.col("start")).alias("start_us"), _us(F.col("last")).alias("last_us"), "n")


def stream_slot_counts(spark, d):
    out = J.drained(J.slot_counts(J.events(spark, d)))
    return out.select(_us(F.col("start")).alias("start_us"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_deduplicated(spark, d):
    out = J.drained(J.deduplicated(J.events(spark, d).withColumn("key", F.col("user_id") * 1000 + F.floor(_us(F.col("ts")) / 86_400_000_000)), ["key"]))
    return out.groupBy("key").agg(F.count("*").alias("n"))


def stream_accounts(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    s = J.events(spark, d).select("event_id", "ts", "user_id", "event_type", (k % 3 != 0).alias("came"), (1.0 - (k % 4) / 4).alias("strength"))
    out = J.drained(J.running_accounts(s), "update")
    return out.select("user_id", "event_type", F.round("k", 9).alias("k"), F.round("n", 9).alias("n"), "opportunities")


SESS = """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events), wm AS (SELECT max(us) // 1000 * 1000 - 7200000000 AS wm FROM e),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us) <= 2700000000 THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us) AS g FROM s)"""
SQL = {
    "stream_sessions": SESS + " SELECT user_id, event_type, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM g, wm GROUP BY user_id, event_type, g HAVING max(us) + 2700000000 <= any_value(wm)",
    "stream_slot_counts": SESS + ", v AS (SELECT epoch_us(ts) // 900000000 * 900000000 AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2) SELECT start_us, event_type, n, value FROM v, wm WHERE start_us + 900000000 <= wm",
    "stream_deduplicated": "SELECT user_id * 1000 + epoch_us(ts) // 86400000000 AS key, 1::BIGINT AS n FROM events GROUP BY 1",
    "stream_accounts": f"""WITH {S.SQL.strip()}, w AS (SELECT lane, kind, k % 3 <> 0 AS came, 1.0::DOUBLE - (k % 4) / 4 AS strength, row_number() OVER (PARTITION BY lane, kind ORDER BY start_us DESC, uri DESC) - 1 AS gap FROM ev)
SELECT lane AS user_id, kind AS event_type, round(sum(CASE WHEN came THEN strength * pow(0.5, gap / 8.0) ELSE 0 END), 9) AS k, round(sum(strength * pow(0.5, gap / 8.0)), 9) AS n, count(*) AS opportunities FROM w GROUP BY 1, 2""",
}
QUERIES = {n: globals()[n] for n in SQL}
