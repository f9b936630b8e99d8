"""Further queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import relations as R
from cadenza.operators import state as T
from cadenza.operators import text as X
from cadenza.operators import triggers as G
from cadenza.plans.relations import STRATA, _strata
from cadenza.plans.temporal import DAYS_SQL, _days, _eps
from cadenza.plans.triggers import NOW
from cadenza.plans.triggers import SQL as TRIGGERS
from cadenza.sources import series as S

HOUR = 3_600_000_000


def _same_day(spark, d):
    return R.strata_same_day(_eps(spark, d).select("lane", "kind", "start_us", "last_us", "day"))


def relation_strata_same_day(spark, d):
    return _same_day(spark, d).select("lane", "antecedent", "consequent", "a_us", "treated", "controls", F.col("positives").cast("long").alias("positives"))


def relation_paired(spark, d):
    p = R.paired(R.effects(_strata(spark, d)), R.effects(_same_day(spark, d)))
    return p.select("lane", "antecedent", "consequent", F.round(F.col("difference") + 1e-11, 9).alias("difference"), F.round(F.col("minimum_p") + 1e-11, 9).alias("minimum_p"))


def weekday_sets(spark, d):
    """Weekdays on which a class came three times or more, as a set."""
    n = _days(spark, d).groupBy("lane", "kind", (F.weekday("day") + 1).alias("value")).agg(F.count("*").alias("n")).where("n >= 3")
    out = T.value_sets(n.withColumn("dimension", F.lit("weekday")), ["lane", "kind"])
    return out.select("lane", "kind", F.array_join(F.col("values").cast("array<string>"), ",").alias("weekdays"))


def revisable_classes(spark, d):
    c = S.records(spark, d).groupBy((F.col("k") % 60).alias("class_id")).agg(F.max(F.when(F.col("lane") % 9 == 0, F.col("day"))).alias("touched"), F.count("*").alias("n"))
    return T.revisable(c.withColumn("changed", F.col("class_id") % 5 == 0), F.lit("2024-01-31").cast("date"), 3, 12).select("class_id", "n")


def formed_expectations(spark, d):
    """Expectations of what has just happened, clamped to now, one an identity."""
    e = G.event_expectations(_eps(spark, d), NOW).select("lane", F.col("consequent").alias("kind"), F.lit("event").alias("source"), F.col("antecedent").alias("trigger"), F.col("a_us").cast("string").alias("instance"), "start_us", "end_us")
    cut = G.clamped(e.withColumn("boundary_us", F.lit(NOW + 9 * HOUR)), NOW)
    return G.formed(cut, spark.createDataFrame([], "id string"), "1").select("id", "lane", "kind", "trigger", "start_us", "end_us")


def recalled_entries(spark, d):
    """Benchmark items and the two most alike documents that no earlier item took."""
    both = X.bigram_overlaps(S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), S.table(spark, d, "documents").select(F.col("doc_id").alias("old_id"), "text"), alike=True)
    return X.recalled(both.select("id", "old_id", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score")), 2)


W = f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()}, {STRATA.strip()}"
SAME = f"""
sb AS (SELECT lane, kind AS antecedent, start_us AS a_us, last_us AS end_us, day FROM eps),
sk AS (SELECT sb.*, k.consequent FROM sb JOIN k ON k.lane = sb.lane AND k.consequent <> antecedent),
so AS (SELECT DISTINCT ON (lane, antecedent, consequent, a_us, slot) * FROM (SELECT s.lane, antecedent, consequent, a_us, s.day, e.last_us // 900000000 AS slot, e.last_us AS t0 FROM sk s JOIN eps e ON e.lane = s.lane AND e.day = s.day AND e.kind <> antecedent AND e.kind <> consequent AND e.last_us // 900000000 <> end_us // 900000000) ORDER BY lane, antecedent, consequent, a_us, slot, t0),
su AS (SELECT lane, antecedent, consequent, a_us, day, end_us AS t0, true AS own FROM sk UNION ALL SELECT lane, antecedent, consequent, a_us, day, t0, false FROM so),
sh AS (SELECT *, EXISTS (SELECT 1 FROM eps e WHERE e.lane = su.lane AND e.kind = su.consequent AND e.start_us > t0 AND e.start_us <= t0 + {6 * HOUR})::INT AS hit FROM su),
sd AS (SELECT lane, antecedent, consequent, a_us, day, max(CASE WHEN own THEN hit END) AS treated, count(CASE WHEN NOT own THEN 1 END) AS controls, CAST(sum(CASE WHEN own THEN 0 ELSE hit END) AS BIGINT) AS positives FROM sh GROUP BY 1, 2, 3, 4, 5)
"""
EFF = "SELECT lane, antecedent, consequent, avg(treated) - avg(positives / controls) AS d, CASE WHEN count(CASE WHEN {p} > 0 AND {p} < 1 THEN 1 END) = 0 THEN 1 ELSE least(1, 2 * least(product({p}) FILTER (WHERE {p} > 0 AND {p} < 1), product(1 - {p}) FILTER (WHERE {p} > 0 AND {p} < 1))) END AS mp FROM {t} WHERE treated IS NOT NULL AND controls > 0 GROUP BY 1, 2, 3"
P = "((treated + positives) / (controls + 1))"
SQL = {
    "relation_strata_same_day": f"{W}, {SAME.strip()} SELECT lane, antecedent, consequent, a_us, treated, controls, positives FROM sd",
    "relation_paired": f"""{W}, {SAME.strip()}, e1 AS ({EFF.format(p=P, t='sx')}), e2 AS ({EFF.format(p=P, t='sd')}),
j AS (SELECT a.lane, a.antecedent, a.consequent, a.d AS d1, b.d AS d2, greatest(a.mp, b.mp) AS mp FROM e1 a JOIN e2 b ON a.lane = b.lane AND a.antecedent = b.antecedent AND a.consequent = b.consequent)
SELECT lane, antecedent, consequent, round(CASE WHEN d1 * d2 <= 0 THEN 0 WHEN abs(d1) <= abs(d2) THEN d1 ELSE d2 END + 1e-11, 9) AS difference, round(mp + 1e-11, 9) AS minimum_p FROM j""",
    "weekday_sets": f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()}, n AS (SELECT lane, kind, isodow(day) AS v FROM days GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT lane, kind, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS weekdays FROM n GROUP BY 1, 2 HAVING count(*) >= 2",
    "revisable_classes": f"WITH {S.SQL.strip()}, c AS (SELECT k % 60 AS class_id, max(CASE WHEN lane % 9 = 0 THEN day END) AS touched, count(*) AS n FROM rec GROUP BY 1) SELECT class_id, n FROM c WHERE class_id % 5 <> 0 AND date_diff('day', touched, DATE '2024-01-31') >= 3 ORDER BY n DESC, class_id LIMIT 12",
    "formed_expectations": f"""WITH x AS ({TRIGGERS['event_expectations']}), c AS (SELECT lane, consequent AS kind, antecedent AS trigger, CAST(a_us AS VARCHAR) AS instance, greatest(start_us, {NOW}) AS start_us, least(greatest(end_us, greatest(start_us, {NOW}) + 900000000), {NOW + 9 * HOUR}) AS end_us FROM x WHERE end_us >= {NOW})
SELECT substr(sha256(lane || '|' || kind || '|event|' || trigger || '|' || instance || '|1'), 1, 24) AS id, lane, kind, trigger, start_us, end_us FROM c WHERE end_us > start_us""",
}
QUERIES = {n: globals()[n] for n in SQL} | {"recalled_entries": recalled_entries}
