"""Queries over expectations: orders expect a shipment; event classes keep accounts. And their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import micros
from cadenza.operators import reliability as R
from cadenza.sources import series as S

HOUR = 3_600_000_000
DAY = 24 * HOUR
P = 9


def _evidence(spark, d):
    r = S.records(spark, d)
    return r.select("lane", "kind", "uri", F.col("start_us").alias("at_us"), (F.col("k") % 3 != 0).alias("came"), (F.lit(1.0) - (F.col("k") % 4) / 4).alias("strength"))


def evidence_weights(spark, d):
    w = R.ranked(_evidence(spark, d))
    return w.select("uri", F.col("rank").cast("long").alias("rank"), F.round(F.col("strength") * R.decay(F.col("last_rank") - F.col("rank"), 8.0), P).alias("weight"))


def account_tallies(spark, d):
    return R.tally(_evidence(spark, d)).withColumns({c: F.round(c, P) for c in ("k", "n")})


def account_tallies_carried(spark, d):
    """The same from two parts, the earlier one compacted: equal to reading everything."""
    e, cut = _evidence(spark, d), 1_705_276_800_000_000
    out = R.carried_on(R.tally(e.where(F.col("at_us") < cut)), R.tally(e.where(F.col("at_us") >= cut)))
    return out.withColumns({c: F.round(c, P) for c in ("k", "n")})


def account_readings(spark, d):
    return R.reading(R.tally(_evidence(spark, d)))


def account_miss_runs(spark, d):
    out = R.miss_run(R.tally(_evidence(spark, d)), 2.0)
    return out.select("lane", "kind", F.round("chance", P).alias("chance"))


def edge_readings(spark, d):
    m = _evidence(spark, d).withColumnRenamed("strength", "weight")
    return R.edge_readings(m, ["lane", "kind"])


def _expectations(spark, d):
    """Every order expects a shipment 20 to 60 days later, looked for from 1 to 90 days; some were spoken of."""
    o = S.table(spark, d, "orders")
    at = micros("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order"), (at + DAY).alias("from_us"), (at + 20 * DAY).alias("start_us"), (at + 60 * DAY).alias("end_us"), (at + 90 * DAY).alias("to_us"),
        F.when(F.col("o_orderkey") % 4 == 1, at + 50 * DAY).alias("spoken_us"),
    )


def _ships(spark, d):
    x = S.table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return x.select(F.col("l_orderkey").alias("order"), micros("l_shipdate").alias("at_us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uri"))


def _summary(settled):
    return settled.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("offset_minutes").alias("minutes"))


def _rulings(expected, ships):
    s = R.settle(expected, ships, ["order"]).where("outcome = 'overdue'")
    o = s.select("id", "order", F.col("to_us").alias("deadline_us"), F.when(F.col("id") % 3 == 0, F.col("to_us") + 1000 * DAY).alias("before_us"))
    return R.rule_overdue(o, ships, ["order"]).select("id", "uri", "delay_minutes")


def settlements(spark, d):
    return R.settle(_expectations(spark, d), _ships(spark, d), ["order"]).select("id", "at_us", "uri", "outcome", "offset_minutes")


def settlement_summary(spark, d):
    return _summary(settlements(spark, d))


def overdue_rulings(spark, d):
    return _rulings(_expectations(spark, d), _ships(spark, d))


def shipment_omissions(spark, d):
    return R.omissions(_ships(spark, d), _expectations(spark, d), ["order"]).select("order", "uri")


def standing_facts(spark, d):
    e = S.events(spark, d)
    f = e.select((F.col("lane") * 100 + F.col("k") % 7).alias("id"), (F.col("k") % 3).alias("precedence"), (F.col("k") % 2 == 0).alias("is_revision"), F.col("uri").alias("seq"))
    return R.current_facts(f)


def _strengths(expected, ships):
    s = R.settle(expected, ships, ["order"]).where("outcome <> 'overdue'").withColumn("bucket", F.col("id") % 70)
    return R.offset_strengths(s, ["bucket"]).withColumn("strength", F.round("strength", P))


def offset_strengths(spark, d):
    return _strengths(_expectations(spark, d), _ships(spark, d))


def first_closing_responses(spark, d):
    """Of each conversation's assistant turns: the first that closes (text without a question mark at its end), else the last."""
    c = S.table(spark, d, "conversations").where("role = 'assistant'").withColumn("closes", F.length("text") % 2 == 0)
    g = c.groupBy("conv_id").agg(F.min(F.when(F.col("closes"), F.col("turn"))).alias("first"), F.max("turn").alias("last"))
    return g.select("conv_id", F.coalesce("first", "last").alias("turn"), F.col("first").isNotNull().alias("closed"))


def calibration_slices(spark, d):
    """Claimed chance by slice against what came, per kind."""
    e = _evidence(spark, d).withColumn("slice", F.floor(F.col("strength") * 4).cast("long"))
    return e.groupBy("kind", "slice").agg(F.count("*").alias("n"), F.round(F.avg("strength"), P).alias("claimed"), F.round(F.avg(F.col("came").cast("double")), P).alias("realized"))


def calibration_bounds(spark, d):
    e = _evidence(spark, d).select("kind", F.floor(F.col("strength") * 4).alias("slice"), F.col("strength").alias("claimed"), F.col("came").alias("hit"))
    return R.calibration(e, ["kind", "slice"])


def connected_spans(spark, d):
    """Components of overlapping records of a lane (starts within 30 minutes of the running end)."""
    r = S.records(spark, d).select("lane", "uri", "start_us", (F.col("last_us") + HOUR // 2).alias("end_us"))
    w = R.Window.partitionBy("lane").orderBy("start_us", "uri")
    new = F.coalesce(F.col("start_us") > F.max("end_us").over(w.rowsBetween(R.Window.unboundedPreceding, -1)), F.lit(True)).cast("long")
    s = r.withColumn("component", F.sum(new).over(w.rowsBetween(R.Window.unboundedPreceding, 0)))
    return s.groupBy("lane", "component").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("component")


EV = f"""WITH {S.SQL.strip()}, e AS (SELECT lane, kind, uri, start_us AS at_us, k % 3 <> 0 AS came, 1.0::DOUBLE - (k % 4) / 4 AS strength FROM rec),
w AS (SELECT *, row_number() OVER (PARTITION BY lane, kind ORDER BY at_us, uri) - 1 AS rank, count(*) OVER (PARTITION BY lane, kind) - 1 AS last_rank FROM e),
t AS (SELECT lane, kind, sum(CASE WHEN came THEN strength * pow(0.5, (last_rank - rank) / 8.0) ELSE 0 END) AS k, sum(strength * pow(0.5, (last_rank - rank) / 8.0)) AS n, count(*) AS opportunities FROM w GROUP BY lane, kind)
"""
ST = f"""WITH x AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) + {DAY} AS from_us, epoch_us(o_orderdate) + {20 * DAY} AS start_us, epoch_us(o_orderdate) + {60 * DAY} AS end_us, epoch_us(o_orderdate) + {90 * DAY} AS to_us,
CASE WHEN o_orderkey % 4 = 1 THEN epoch_us(o_orderdate) + {50 * DAY} END AS spoken_us FROM orders),
sh AS (SELECT l_orderkey AS ord, epoch_us(l_shipdate) AS at_us, l_orderkey * 10 + l_linenumber AS uri FROM lineitem WHERE l_returnflag <> 'R'),
f AS (SELECT id, min((at_us, uri)) AS hit FROM x JOIN sh ON ord = id AND at_us > from_us AND at_us <= to_us GROUP BY id),
s AS (SELECT x.*, hit[1] AS at_us, hit[2] AS uri FROM x LEFT JOIN f ON f.id = x.id),
st AS (SELECT *, CASE WHEN at_us IS NULL THEN 'overdue' WHEN spoken_us < at_us THEN 'after_reminder' WHEN at_us < start_us THEN 'early' WHEN at_us <= end_us THEN 'on_time' ELSE 'late' END AS outcome FROM s),
se AS (SELECT *, CAST(round(CASE outcome WHEN 'after_reminder' THEN at_us - spoken_us WHEN 'early' THEN at_us - start_us WHEN 'late' THEN at_us - end_us END / 60000000.0) AS BIGINT) AS offset_minutes FROM st)
"""
SQL = {
    "evidence_weights": EV + f"SELECT uri, rank, round(strength * pow(0.5, (last_rank - rank) / 8.0), {P}) AS weight FROM w",
    "account_tallies": EV + f"SELECT lane, kind, round(k, {P}) AS k, round(n, {P}) AS n, opportunities FROM t",
    "account_tallies_carried": EV + f"SELECT lane, kind, round(k, {P}) AS k, round(n, {P}) AS n, opportunities FROM t",
    "account_miss_runs": EV + f"SELECT lane, kind, round(exp(lgamma(greatest(n - k, 0) + 0.5 + 2) - lgamma(greatest(n - k, 0) + 0.5) + lgamma(n + 1) - lgamma(n + 3)), {P}) AS chance FROM t",
    "settlements": ST + "SELECT id, at_us, uri, outcome, offset_minutes FROM se",
    "settlement_summary": ST + "SELECT outcome, count(*) AS n, CAST(sum(offset_minutes) AS BIGINT) AS minutes FROM se GROUP BY outcome",
    "overdue_rulings": ST + f""", g AS (SELECT id, to_us, min((sh.at_us, sh.uri)) AS hit FROM se JOIN sh ON ord = id AND sh.at_us > to_us AND (id % 3 <> 0 OR sh.at_us < to_us + {1000 * DAY}) WHERE outcome = 'overdue' GROUP BY id, to_us)
SELECT id, hit[2] AS uri, CAST(greatest(1, round((hit[1] - to_us) / 60000000.0)) AS BIGINT) AS delay_minutes FROM g""",
    "shipment_omissions": ST + 'SELECT ord AS "order", uri FROM sh WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = ord AND at_us > from_us AND at_us <= to_us)',
    "standing_facts": f"WITH {S.SQL.strip()}, f AS (SELECT lane * 100 + k % 7 AS id, k % 3 AS precedence, k % 2 = 0 AS is_revision, uri AS seq FROM ev) SELECT id, precedence, is_revision, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY precedence DESC, is_revision DESC, seq DESC) AS r FROM f) WHERE r = 1",
    "offset_strengths": ST + f""", a AS (SELECT id % 70 AS bucket, id, start_us, coalesce(offset_minutes, 0) AS o FROM se WHERE outcome <> 'overdue')
SELECT bucket, id, CASE WHEN o = 0 OR (SELECT count(*) FROM a p WHERE p.bucket = a.bucket AND p.start_us < a.start_us) < 2 THEN 1.0 ELSE round((SELECT avg((abs(p.o) >= abs(a.o))::INT::DOUBLE) FROM a p WHERE p.bucket = a.bucket AND p.start_us < a.start_us), {P}) END AS strength FROM a""",
    "first_closing_responses": "SELECT conv_id, coalesce(min(CASE WHEN length(text) % 2 = 0 THEN turn END), max(turn)) AS turn, count(CASE WHEN length(text) % 2 = 0 THEN 1 END) > 0 AS closed FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "calibration_slices": EV + f"SELECT kind, CAST(floor(strength * 4) AS BIGINT) AS slice, count(*) AS n, round(avg(strength), {P}) AS claimed, round(avg(came::INT::DOUBLE), {P}) AS realized FROM e GROUP BY 1, 2",
    "connected_spans": f"""WITH {S.SQL.strip()}, r AS (SELECT lane, uri, start_us, last_us + {HOUR // 2} AS end_us FROM rec),
n AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY lane ORDER BY start_us, uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
c AS (SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY start_us, uri) AS component FROM n) SELECT lane, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM c GROUP BY lane, component""",
}
QUERIES = {n: globals()[n] for n in SQL} | {"account_readings": account_readings, "edge_readings": edge_readings, "calibration_bounds": calibration_bounds}
