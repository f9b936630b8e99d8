"""Queries of relation mining, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import day_number
from cadenza.operators import relations as R
from cadenza.operators import temporal as T
from cadenza.plans.temporal import DAYS_SQL
from cadenza.sources import series as S

HORIZON = 1_706_616_000_000_000
P = 9


def _strata(spark, d):
    return R.strata(T.episodes(S.records(spark, d)).select("lane", "kind", "start_us", "last_us", "day"), horizon_us=HORIZON)


def relation_strata(spark, d):
    return _strata(spark, d).select("lane", "antecedent", "consequent", "a_us", "treated", F.col("controls").cast("long").alias("controls"), F.col("positives").cast("long").alias("positives"))


def relation_effects(spark, d):
    return R.effects(_strata(spark, d)).withColumns({c: F.round(F.col(c) + 1e-11, P) for c in ("treated_rate", "control_rate", "difference", "relative", "minimum_p")})


def relation_stability(spark, d):
    return R.stable(_strata(spark, d))


def relation_tests(spark, d):
    return R.tests(_strata(spark, d))


def relation_p_values(spark, d):
    """Exact chances of at least and at most as many treated positives, and the two-sided p-value, of each relation."""
    t = R.p_values(_strata(spark, d))
    return t.select("lane", "antecedent", "consequent", "n", *[F.round(F.col(c) + 1e-11, P).alias(c) for c in ("upper", "lower", "p")])


def relation_discoveries(spark, d):
    return R.discoveries(R.p_values(_strata(spark, d)))


def candidate_relations(spark, d):
    """Ordered pairs of kinds that a lane has on three days or more each."""
    days = T.occurrence_days(T.episodes(S.records(spark, d))).groupBy("lane", "kind").agg(F.count("*").alias("n")).where("n >= 3")
    a, b = days.select("lane", F.col("kind").alias("antecedent")), days.select("lane", F.col("kind").alias("consequent"))
    return a.join(b, "lane").where("antecedent <> consequent")


def first_arrivals(spark, d):
    """The first other kind within six hours after each episode."""
    e = T.episodes(S.records(spark, d)).select("lane", "kind", "start_us", "last_us")
    b = e.select("lane", F.col("kind").alias("b"), F.col("start_us").alias("b_us"))
    j = e.join(b, "lane").where((F.col("b") != F.col("kind")) & (F.col("b_us") > F.col("last_us")) & (F.col("b_us") <= F.col("last_us") + 6 * 3_600_000_000))
    return j.groupBy("lane", "kind", "start_us").agg(F.min(F.struct("b_us", "b")).alias("m")).select("lane", "kind", "start_us", F.col("m.b").alias("first_kind"))


def calendar_strata(spark, d):
    """Days with and without an act, by ISO week and day type: two-sided strata only."""
    r = S.records(spark, d)
    lanes = r.groupBy("lane").agg(F.min("day").alias("d0"))
    spine = lanes.select("lane", F.explode(F.sequence("d0", F.lit("2024-01-30").cast("date"))).alias("day"))
    acts = r.where("kind = 'view'").select("lane", "day").distinct().withColumn("hit", F.lit(1))
    by = spine.join(acts, ["lane", "day"], "left").withColumns({"week": F.weekofyear("day"), "weekend": F.weekday("day") >= 5})
    g = by.groupBy("lane", "week").agg(F.count(F.when(F.col("weekend"), 1)).alias("weekend_days"), F.count(F.when(~F.col("weekend"), 1)).alias("work_days"), F.count(F.when(F.col("weekend"), F.col("hit"))).alias("weekend_hits"), F.count(F.when(~F.col("weekend"), F.col("hit"))).alias("work_hits"))
    return g.where("weekend_days > 0 and work_days > 0")


def lane_change_points(spark, d):
    n = S.records(spark, d).groupBy("lane", "day").agg(F.count("*").alias("n"))
    grid = n.groupBy("lane").agg(F.min("day").alias("d0")).select("lane", F.explode(F.sequence("d0", F.lit("2024-01-30").cast("date"))).alias("day"))
    full = grid.join(n, ["lane", "day"], "left").select("lane", day_number(F.col("day")).cast("long").alias("day_no"), F.coalesce("n", F.lit(0)).alias("n"))
    return R.change_points(full, ["lane"])


def moderated_conditions(spark, d):
    """Episodes of a kind by two conditions, unknown kept apart: weekend, and a purchase in the day before (unknown on the
    lane's first day)."""
    e = T.episodes(S.records(spark, d)).where("kind = 'view'").select("lane", "start_us", "day")
    b = S.records(spark, d).where("kind = 'purchase'").select("lane", F.col("start_us").alias("b_us"))
    first = S.records(spark, d).groupBy("lane").agg(F.min("start_us").alias("lane_us"))
    j = e.join(b, (e["lane"] == b["lane"]) & (b["b_us"] < e["start_us"]) & (b["b_us"] >= e["start_us"] - 86_400_000_000), "left").drop(b["lane"])
    g = j.groupBy("lane", "start_us", "day").agg((F.count("b_us") > 0).alias("has")).join(first, "lane")
    recent = F.when(F.col("has"), True).when(F.col("start_us") - F.col("lane_us") < 86_400_000_000, None).otherwise(F.lit(False))
    return g.select("lane", "start_us", (F.weekday("day") >= 5).alias("weekend"), recent.alias("recent"), ((F.weekday("day") >= 5) & recent).alias("both"))


def state_tests(spark, d):
    """Clicks of each lane on days of a run of busy days (four rows or more) and around it."""
    r = S.events(spark, d).groupBy("lane", "day").agg(F.count("*").alias("n"), F.max((F.col("kind") == "click").cast("int")).alias("outcome"))
    full = r.groupBy("lane").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("lane", F.explode(F.sequence("a", "b")).alias("day")).join(r, ["lane", "day"], "left")
    return R.state_tests(full.select("lane", day_number(F.col("day")).alias("day_no"), "outcome", (F.coalesce("n", F.lit(0)) >= 4).alias("inside")), ["lane"])


def more_needed(spark, d):
    return R.more_needed(_strata(spark, d), 0.01)


STRATA = f"""
b AS (SELECT lane, kind AS antecedent, start_us AS a_us, last_us AS end_us, day FROM eps),
k AS (SELECT DISTINCT lane, kind AS consequent FROM eps),
ln AS (SELECT lane, min(day) AS d0, max(day) AS d1 FROM eps GROUP BY lane),
pr AS (SELECT b.lane, antecedent, consequent, a_us, day, w * 7 AS shift, end_us + w * 7 * 86400000000 AS t0, CAST(day + CAST(w * 7 AS INT) AS DATE) AS on_day, end_us + 21600000000 <= {HORIZON} AS seen
  FROM b JOIN k ON k.lane = b.lane AND k.consequent <> antecedent CROSS JOIN (SELECT unnest(range(-4, 5)) AS w)),
pv AS (SELECT p.* FROM pr p JOIN ln ON ln.lane = p.lane WHERE shift = 0 OR (on_day >= d0 AND on_day <= d1 AND NOT EXISTS (SELECT 1 FROM b x WHERE x.lane = p.lane AND x.antecedent = p.antecedent AND x.day = p.on_day))),
hi AS (SELECT *, EXISTS (SELECT 1 FROM eps e WHERE e.lane = pv.lane AND e.kind = pv.consequent AND e.start_us > t0 AND e.start_us <= t0 + 21600000000)::INT AS hit FROM pv),
sx AS (SELECT lane, antecedent, consequent, a_us, day, max(CASE WHEN shift = 0 AND seen THEN hit END) AS treated, count(CASE WHEN shift <> 0 THEN 1 END) AS controls, CAST(sum(CASE WHEN shift <> 0 THEN hit ELSE 0 END) AS BIGINT) AS positives FROM hi GROUP BY 1, 2, 3, 4, 5),
bl AS (SELECT *, positives / controls AS rate, (treated + positives) / (controls + 1) AS p, date_diff('day', min(day) OVER (PARTITION BY lane, antecedent, consequent), day) // 7 AS block FROM sx WHERE treated IS NOT NULL AND controls > 0)
"""
W = f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()}, {STRATA.strip()} "
E = f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()} "
SQL = {
    "relation_strata": W + "SELECT lane, antecedent, consequent, a_us, treated, controls, positives FROM sx",
    "relation_effects": W + f"""SELECT lane, antecedent, consequent, count(*) AS n, round(avg(treated) + 1e-11, {P}) AS treated_rate, round(avg(rate) + 1e-11, {P}) AS control_rate, round(avg(treated) - avg(rate) + 1e-11, {P}) AS difference,
round(CASE WHEN avg(rate) > 0 THEN avg(treated) / avg(rate) - 1 END + 1e-11, {P}) AS relative, round(CASE WHEN count(CASE WHEN p > 0 AND p < 1 THEN 1 END) = 0 THEN 1 ELSE least(1, 2 * least(product(p) FILTER (WHERE p > 0 AND p < 1), product(1 - p) FILTER (WHERE p > 0 AND p < 1))) END + 1e-11, {P}) AS minimum_p FROM bl GROUP BY 1, 2, 3""",
    "relation_stability": W + """, by1 AS (SELECT lane, antecedent, consequent, block, sum(treated) AS t, sum(rate) AS r, count(*) AS c FROM bl GROUP BY 1, 2, 3, 4),
d AS (SELECT *, round((sum(t) OVER w - sum(r) OVER w) / sum(c) OVER w, 12) AS whole, round((sum(t) OVER w - t - sum(r) OVER w + r) / nullif(sum(c) OVER w - c, 0), 12) AS rest FROM by1 WINDOW w AS (PARTITION BY lane, antecedent, consequent))
SELECT lane, antecedent, consequent, bool_and(coalesce(rest * whole > 0, false)) AND count(*) > 1 AS stable FROM d GROUP BY 1, 2, 3""",
    "more_needed": W + """, m AS (SELECT lane, antecedent, consequent, median(least(p, 1 - p)) FILTER (WHERE p > 0 AND p < 1) AS typical, CASE WHEN count(CASE WHEN p > 0 AND p < 1 THEN 1 END) = 0 THEN 1 ELSE least(1, 2 * least(product(p) FILTER (WHERE p > 0 AND p < 1), product(1 - p) FILTER (WHERE p > 0 AND p < 1))) END AS mp FROM bl GROUP BY 1, 2, 3)
SELECT lane, antecedent, consequent, CASE WHEN typical IS NOT NULL THEN CASE WHEN mp <= 0.01 + 1e-12 THEN 0 ELSE CAST(ceil(round(ln(0.01 / mp) / ln(typical), 9)) AS BIGINT) END END AS needed FROM m""",
    "candidate_relations": E + ", n AS (SELECT lane, kind FROM days GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a.lane, a.kind AS antecedent, b.kind AS consequent FROM n a JOIN n b ON a.lane = b.lane AND a.kind <> b.kind",
    "first_arrivals": E + "SELECT a.lane, a.kind, a.start_us, arg_min(b.kind, (b.start_us, b.kind)) AS first_kind FROM eps a JOIN eps b ON a.lane = b.lane AND a.kind <> b.kind AND b.start_us > a.last_us AND b.start_us <= a.last_us + 21600000000 GROUP BY 1, 2, 3",
    "calendar_strata": f"""WITH {S.SQL.strip()}, sp AS (SELECT lane, CAST(unnest(generate_series(min(day), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM rec GROUP BY lane),
g AS (SELECT s.lane, week(s.day) AS week, isodow(s.day) >= 6 AS weekend, EXISTS (SELECT 1 FROM rec r WHERE r.lane = s.lane AND r.day = s.day AND r.kind = 'view') AS hit FROM sp s)
SELECT lane, CAST(week AS INT) AS week, count(CASE WHEN weekend THEN 1 END) AS weekend_days, count(CASE WHEN NOT weekend THEN 1 END) AS work_days, count(CASE WHEN weekend AND hit THEN 1 END) AS weekend_hits, count(CASE WHEN NOT weekend AND hit THEN 1 END) AS work_hits FROM g GROUP BY 1, 2 HAVING count(CASE WHEN weekend THEN 1 END) > 0 AND count(CASE WHEN NOT weekend THEN 1 END) > 0""",
    "moderated_conditions": E + """, fi AS (SELECT lane, min(start_us) AS lane_us FROM rec GROUP BY lane),
g AS (SELECT e.lane, e.start_us, isodow(e.day) >= 6 AS weekend, CASE WHEN EXISTS (SELECT 1 FROM rec r WHERE r.lane = e.lane AND r.kind = 'purchase' AND r.start_us < e.start_us AND r.start_us >= e.start_us - 86400000000) THEN true WHEN e.start_us - lane_us < 86400000000 THEN NULL ELSE false END AS recent FROM eps e JOIN fi ON fi.lane = e.lane WHERE kind = 'view')
SELECT lane, start_us, weekend, recent, weekend AND recent AS both FROM g""",
}
#: The distribution of each relation's positives: the two-point distributions of its undecided strata, convolved.
TAILS = """, pb AS (SELECT lane, antecedent, consequent, count(*) AS n, CAST(sum(treated) - count(CASE WHEN p >= 1 THEN 1 END) AS INT) AS hit,
  list_reduce(list([1 - p, p]) FILTER (WHERE p > 0 AND p < 1), lambda a, b: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * b[1] + coalesce(a[i - 1], 0) * b[2])) AS mass,
  CASE WHEN count(CASE WHEN p > 0 AND p < 1 THEN 1 END) = 0 THEN 1 ELSE least(1, 2 * least(product(p) FILTER (WHERE p > 0 AND p < 1), product(1 - p) FILTER (WHERE p > 0 AND p < 1))) END AS reach FROM bl GROUP BY 1, 2, 3),
pv2 AS (SELECT *, CASE WHEN mass IS NULL THEN 1 ELSE least(1, coalesce(list_sum(mass[greatest(hit, 0) + 1:]), 0)) END AS upper, CASE WHEN mass IS NULL THEN 1 ELSE least(1, coalesce(list_sum(mass[:greatest(hit, 0) + 1]), 0)) END AS lower FROM pb),
ts AS (SELECT *, least(1, 2 * least(upper, lower)) AS p FROM pv2)"""
SQL |= {
    "relation_p_values": W + TAILS + f" SELECT lane, antecedent, consequent, n, round(upper + 1e-11, {P}) AS upper, round(lower + 1e-11, {P}) AS lower, round(p + 1e-11, {P}) AS p FROM ts",
    # the smallest K such that at most K tests reach 0.1 / K; the tests that do; and the step-up rule among them
    "relation_discoveries": W + TAILS + """, ks AS (SELECT lane, min(K) AS K FROM (SELECT t.lane, K, count(CASE WHEN t.reach <= 0.1 / K THEN 1 END) AS m FROM ts t JOIN (SELECT lane, unnest(range(1, count(*) + 1)) AS K FROM ts GROUP BY lane) c ON c.lane = t.lane GROUP BY 1, 2) WHERE m <= K GROUP BY lane),
fam AS (SELECT ts.*, ts.reach <= 0.1 / K AS in_family FROM ts JOIN ks ON ks.lane = ts.lane),
rk AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY p, antecedent, consequent) AS r, count(*) OVER (PARTITION BY lane) AS m FROM fam WHERE in_family),
cut AS (SELECT lane, max(r) AS r FROM rk WHERE p <= 0.1 * r / m GROUP BY lane)
SELECT f.lane, f.antecedent, f.consequent, f.in_family, rk.r IS NOT NULL AND rk.r <= coalesce(cut.r, 0) AS found FROM fam f LEFT JOIN rk ON rk.lane = f.lane AND rk.antecedent = f.antecedent AND rk.consequent = f.consequent LEFT JOIN cut ON cut.lane = f.lane""",
}
QUERIES = {n: globals()[n] for n in SQL} | {f.__name__: f for f in (relation_tests, lane_change_points, state_tests)}
