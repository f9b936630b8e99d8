"""Queries of triggers, diagnoses and relation states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import day_number
from cadenza.operators import temporal as T
from cadenza.operators import triggers as G
from cadenza.plans.temporal import DAYS_SQL, _days, _eps, _intervals
from cadenza.sources import series as S

NOW = 1_705_968_000_000_000 + 15 * 3_600_000_000
TODAY = "2024-01-23"


def day_expectations(spark, d):
    days = _days(spark, d).withColumn("day_no", day_number(F.col("day")))
    iv = _intervals(spark, d).withColumn("following_no", day_number(F.col("following")))
    return G.day_expectations(days, iv, 19745)


def situation_expectations(spark, d):
    return G.situation_expectations(_days(spark, d), F.weekday("day"), F.lit(TODAY).cast("date"))


def event_expectations(spark, d):
    return G.event_expectations(_eps(spark, d), NOW)


def miss_causes(spark, d):
    o = S.table(spark, d, "orders")
    flags = {c: (F.col("o_orderkey") % (i + 5)) == i for i, c in enumerate(G.CAUSES)}
    m = o.select("o_orderkey", *[F.when(F.col("o_orderkey") % 11 != 3, f).alias(c) for c, f in flags.items()])
    return G.causes(m).select("o_orderkey", "cause")


def relation_states(spark, d):
    e = S.events(spark, d).select("lane", day_number(F.col("day")).alias("night"), "k")
    n = e.groupBy("lane", "night").agg(F.sum("k").alias("s"), F.count("*").alias("c"))
    forward, kept = F.when(F.col("s") % 4 > 0, F.col("s") % 4 > 1), F.when(F.col("s") % 5 > 0, F.col("s") % 5 > 2)
    return G.relation_states(n.select("lane", "night", (F.col("c") > 1).alias("tested"), (F.col("s") % 3 == 0).alias("significant"), forward.alias("forward"), kept.alias("kept")), ["lane"])


def retention_cuts(spark, d):
    c = S.table(spark, d, "conversations")
    w = T.Window.partitionBy("conv_id").orderBy("turn")
    m = c.select("conv_id", "turn", F.length("text").cast("long").alias("tokens"), ((F.col("role") == "assistant") & (F.coalesce(F.lead("role").over(w), F.lit("user")) == "user")).alias("safe"), ((F.length("text") % 20) / 10).alias("semantic"))
    return G.retained(m, 1500, 800)


W = f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()}"
SQL = {
    "situation_expectations": W + f""", h AS (SELECT lane, kind, list_sort(list(natural_us % 86400000000)) AS t FROM days WHERE natural_us IS NOT NULL AND day < DATE '{TODAY}' AND isodow(day) = isodow(DATE '{TODAY}') GROUP BY 1, 2)
SELECT lane, kind, CAST(len(t) AS INT) AS hits, t[1 + CAST(floor((len(t) - 1) * 0.1) AS INT)] AS from_clock_us, t[len(t) - CAST(floor((len(t) - 1) * 0.1) AS INT)] AS to_clock_us FROM h WHERE len(t) >= 2""",
    "event_expectations": W + f""", a AS (SELECT lane, kind AS antecedent, start_us AS a_us, last_us FROM eps WHERE start_us <= {NOW}),
f AS (SELECT a.lane, antecedent, e.kind AS consequent, a_us, min(e.start_us - a.last_us) AS off FROM a JOIN eps e ON e.lane = a.lane AND e.kind <> antecedent AND e.start_us <= {NOW} AND e.start_us > a.last_us AND e.start_us <= a.last_us + 21600000000 GROUP BY 1, 2, 3, 4),
p AS (SELECT lane, antecedent, consequent, list_sort(list(off)) AS t FROM f WHERE a_us <= {NOW - 21600000000} GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT a.lane, a.antecedent, p.consequent, a.a_us, CAST(len(t) AS INT) AS hits, last_us + t[1 + CAST(floor((len(t) - 1) * 0.1) AS INT)] AS start_us, last_us + t[len(t) - CAST(floor((len(t) - 1) * 0.1) AS INT)] AS end_us
FROM a JOIN p ON p.lane = a.lane AND p.antecedent = a.antecedent WHERE a.a_us > {NOW - 21600000000} AND NOT EXISTS (SELECT 1 FROM f WHERE f.lane = a.lane AND f.antecedent = a.antecedent AND f.consequent = p.consequent AND f.a_us = a.a_us)""",
    "miss_causes": "SELECT o_orderkey, CASE " + " ".join(f"WHEN o_orderkey % 11 <> 3 AND o_orderkey % {i + 5} = {i} THEN '{c}'" for i, c in enumerate(G.CAUSES)) + " ELSE 'unexplained' END AS cause FROM orders",
    "retention_cuts": """WITH m AS (SELECT conv_id, turn, length(text) AS tokens, role = 'assistant' AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'user') = 'user' AS safe, (length(text) % 20) / 10 AS semantic,
sum(length(text)) OVER (PARTITION BY conv_id) AS total, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM conversations),
s AS (SELECT *, round(2 * semantic + 1 - least(abs(after - 800) / 800.0::DOUBLE, 1.0), 9) AS score FROM m WHERE safe AND total > 1500) SELECT conv_id, arg_max(turn, (score, turn)) AS turn, max(score) AS score FROM s GROUP BY 1""",
}
SQL["relation_states"] = f"""WITH RECURSIVE {S.SQL.strip()}, n0 AS (SELECT lane, day, sum(k) AS s, count(*) AS c FROM ev GROUP BY 1, 2),
n1 AS (SELECT lane, CAST(date_diff('day', DATE '1970-01-01', day) AS INT) AS night, c > 1 AS tested, s % 3 = 0 AS significant, CASE WHEN s % 4 > 0 THEN s % 4 > 1 END AS forward, CASE WHEN s % 5 > 0 THEN s % 5 > 2 END AS kept, row_number() OVER (PARTITION BY lane ORDER BY day) AS i FROM n0),
st AS (SELECT lane, CAST(NULL AS INT) AS night, 0::BIGINT AS i, 'sparse' AS status, 0 AS failed FROM n1 WHERE i = 1
UNION ALL SELECT n.lane, n.night, n.i, CASE WHEN status = 'candidate' THEN CASE WHEN forward IS NULL THEN status WHEN forward THEN 'established' ELSE 'rejected' END
 WHEN status = 'established' THEN CASE WHEN kept IS NOT NULL AND NOT kept AND failed + 1 >= 2 THEN 'expired' ELSE status END
 WHEN tested THEN CASE WHEN significant THEN 'candidate' WHEN status = 'sparse' THEN 'tested' ELSE status END ELSE status END,
 CASE WHEN status = 'candidate' THEN 0 WHEN status = 'established' THEN CASE WHEN kept IS NULL THEN failed WHEN kept THEN 0 ELSE failed + 1 END ELSE failed END FROM st JOIN n1 n ON n.lane = st.lane AND n.i = st.i + 1)
SELECT lane, night, status FROM st WHERE i > 0"""
QUERIES = {n: globals()[n] for n in SQL} | {"day_expectations": day_expectations}
