"""Queries of opportunities, moments, units, gates and nightly states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import opportunities as O
from cadenza.operators import temporal as T
from cadenza.plans.temporal import DAYS_SQL, PIECES_SQL, _days, _eps, _pieces
from cadenza.sources import series as S

HOUR = 3_600_000_000
DAY = 24 * HOUR
WINDOW = 6 * HOUR
NOW = 1_705_968_000_000_000 + 15 * HOUR
P = 9
KINDS = ("click", "purchase", "signup", "view")


def _pairs(spark):
    """Ordered pairs of different kinds, numbered."""
    pairs = [(a, b) for a in KINDS for b in KINDS if a != b]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, antecedent string, consequent string")


def _relations(spark, d):
    """A chain relation for each lane and pair of kinds, and one weekday relation for each lane and kind, in various states."""
    lanes = S.records(spark, d).select("lane").distinct()
    n = F.pmod(F.col("lane") + F.col("i"), F.lit(4))
    chain = lanes.join(F.broadcast(_pairs(spark))).select(
        "lane", F.concat_ws("|", "lane", "antecedent", "consequent").alias("key"), F.lit("chain").alias("segment"), "antecedent", "consequent",
        F.when(n == 0, "established").when(n == 1, "candidate").when(n == 2, "rejected").otherwise("sparse").alias("status"), F.lit(True).alias("upward"), (F.col("i") % 5 == 0).alias("conditioned"),
    )
    kinds = lanes.withColumn("consequent", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    situation = kinds.select(
        "lane", F.concat_ws("|", "lane", F.lit("weekday"), "consequent").alias("key"), F.lit("situation").alias("segment"), F.concat(F.lit("weekday:"), F.col("lane") % 7 + 1).alias("antecedent"), "consequent",
        F.lit("established").alias("status"), (F.col("lane") % 5 != 0).alias("upward"), F.lit(False).alias("conditioned"),
    )
    return chain.unionByName(situation)


def opportunity_table(spark, d):
    """Opportunities of all relations: after each antecedent, and on each day of their weekday on which the lane was there; the type
    of days whose number ends in 0 isn't known."""
    days = _days(spark, d)
    weekday = F.weekday("day") + 1
    kind = F.when(F.dayofmonth("day") % 10 != 0, F.when(weekday >= 6, "weekend").otherwise("workday"))
    there = S.records(spark, d).select("lane", "day").distinct().select("lane", "day", F.concat(F.lit("weekday:"), weekday).alias("antecedent"), kind.alias("day_type"))
    return O.opportunity_table(_relations(spark, d), _eps(spark, d), _pieces(spark, d), WINDOW, there, days).withColumn("day", F.col("day").cast("string"))


def _members(spark):
    """A family for each pair of kinds: the plain relation, one of weekends, one of mornings, one of both; not all are there."""
    names = {"": [], "weekend": ["weekend"], "early": ["early"], "early+weekend": ["early", "weekend"]}
    rows = [(a, b, f"{a}>{b}|{n}", c) for i, (a, b) in enumerate((a, b) for a in KINDS for b in KINDS if a != b) for n, c in names.items() if (i % 3 == 0 or (i % 3 == 1 and n in ("", "weekend")) or (i % 3 == 2 and n == "early"))]
    return spark.createDataFrame(rows, "antecedent string, consequent string, key string, conditions array<string>")


def _facts(spark, d):
    """Episodes with what is known of them: weekend, and morning, which isn't known of every seventh."""
    early = F.when(F.col("first_uri") % 7 != 0, F.col("start_us") % DAY < 12 * HOUR)
    return _eps(spark, d).select("lane", F.col("kind").alias("antecedent"), F.col("first_uri").alias("uri"), "last_us", F.create_map(F.lit("weekend"), F.weekday("day") >= 5, F.lit("early"), early).alias("facts"))


def most_specific_relations(spark, d):
    return O.most_specific(F.broadcast(_members(spark)), _facts(spark, d), ["antecedent", "consequent"], ["lane", "uri"])


def present_antecedents(spark, d):
    m = _facts(spark, d).select("lane").distinct().join(F.broadcast(_members(spark)))
    return O.antecedents_present(m, _facts(spark, d), ["lane", "antecedent", "consequent"], NOW, WINDOW)


def same_goal_arrivals(spark, d):
    """An act's goal is its key modulo five, none for four; a chain's goals are those of its acts."""
    goal = F.when(F.col("k") % 5 < 4, F.col("k") % 5)
    r = T.merge_starts(S.records(spark, d)).withColumn("goal", goal)
    chains = r.groupBy("lane", "kind", "episode").agg(F.min("uri").alias("chain"), F.to_date(F.timestamp_micros(F.min("start_us"))).alias("day"), F.max("last_us").alias("end_us"), F.collect_set("goal").alias("goals"))
    return O.same_goal(chains, r, WINDOW)


def _expected(spark, d):
    """Each record lets expect the next of its class within two days; nothing is known where that one was reminded of."""
    r = S.records(spark, d)
    w = T.Window.partitionBy("lane", "kind").orderBy("start_us", "uri")
    nxt = lambda c: F.lead(c).over(w)
    r = r.withColumns({"next_us": nxt("start_us"), "next_uri": nxt("uri"), "next_reminded": nxt("reminded")})
    near = F.coalesce(F.col("next_us") <= F.col("start_us") + 2 * DAY, F.lit(False))
    came = F.when(near & ~F.col("next_reminded"), True).when(~near, False)
    return r.select("lane", "kind", F.col("uri").alias("id"), F.col("start_us").alias("from_us"), (F.col("start_us") + 3 * HOUR).alias("to_us"), F.col("start_us").alias("formed_us"), came.alias("came"), F.when(came, F.col("next_uri")).alias("occurrence"), (1 - (F.col("k") % 4) / 4).alias("strength"), (F.col("k") % 3).cast("string").alias("input"))


def labelled_moments(spark, d):
    m = O.moments(_expected(spark, d), ["lane", "kind"])
    return m.withColumns({"signature": F.array_join("signature", "+"), "strength": F.round("strength", P)})


def unit_readings(spark, d):
    """Each class's last moment, read from those before it."""
    m = O.moments(_expected(spark, d), ["lane", "kind"])
    last = m.groupBy("lane", "kind").agg(F.max_by("signature", F.struct("at_us", "signature")).alias("signature"), F.max("at_us").alias("at_us"))
    return O.unit_readings(m, last, ["lane", "kind"])


def _inputs(spark, d):
    """An order is a unit, its lines are inputs, with readings made of their numbers."""
    x, n = S.table(spark, d, "lineitem"), F.col("l_linenumber") + F.col("l_orderkey")
    k = lambda m: F.pmod(n, F.lit(m))
    return x.select(
        F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("long").alias("id"), (k(3) > 0).alias("due"), (F.col("l_returnflag") != "N").alias("backed"), F.when(k(4) > 1, "established").otherwise("candidate").alias("status"),
        F.when(k(5) > 0, k(5) > 1).alias("large"), F.round(F.col("l_discount").cast("double") - 0.04, 4).alias("lift"), F.round(F.col("l_tax").cast("double") * 10, 4).alias("lower"), F.round(F.col("l_tax").cast("double") * 10 + 0.3, 4).alias("upper"),
    )


def unit_decisions(spark, d):
    """What each order speaks from, its level, and whether account and effect agree."""
    b = O.basis(_inputs(spark, d), ["unit"], ("large", "lift", "lower", "upper"))
    u, line = F.col("unit"), F.lit(0.5)
    setting = F.when(u % 13 == 0, "never").when(u % 13 == 1, "always")
    level = O.unit_level(F.col("speakable"), F.col("lower"), F.col("upper"), line, F.when(u % 2 == 0, 1), F.when(u % 11 == 0, 0.4), setting)
    return b.select("unit", "id", "speakable", level.alias("level"), O.self_check(F.col("lower"), F.col("upper"), line, F.col("large"), F.col("lift")).alias("check"))


def assessed_relations(spark, d):
    """Later gates over intervals made of the numbers of orders."""
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey")
    v = F.round(F.pmod(F.col("o_custkey") * 7 + k, F.lit(100)) / 100 - 0.5, 4)
    some = lambda c, m: F.when(k % m != 0, c)
    t = o.select(
        k.alias("id"), some(F.struct((v - 0.2).alias("low"), (v + 0.2).alias("high")), 9).alias("spread"), some(F.struct((2 * v - 0.5).alias("low"), (2 * v + 0.5).alias("high")), 7).alias("relative"), (k % 2 == 0).alias("upward"), (k % 5 != 0).alias("leave_one_out"),
        some(F.round((k % 10) / 50, 4), 8).alias("heterogeneity"), some(k % 3 == 0, 11).alias("was_large"), (k % 40).alias("n"), v.alias("difference"), (k % 6).alias("consequents"),
    )
    return O.assessed(t, 0.05, 0.2, 0.05).select("id", "stable", "large", F.round("excess_share", P).alias("excess_share"))


def folded_relations(spark, d):
    """States of relations, one an order, after a night of tests, of which some weren't there before and some aren't tested."""
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey")
    m = lambda n: F.pmod(k, F.lit(n))
    names = F.array(*[F.lit(x) for x in ("sparse", "tested", "candidate", "established", "rejected", "expired")])
    before = o.where(m(5) > 0).select(k.alias("id"), F.element_at(names, (m(6) + 1).cast("int")).alias("status"), F.lit(10).alias("discovered"), (m(9) + 1).cast("int").alias("needed"))
    tonight = o.where(m(7) > 0).select(
        k.alias("id"), F.lit(30).alias("night"), (m(37) == 0).alias("retired"), (m(3) > 0).alias("tested"), (m(4) == 0).alias("significant"), (m(8) + 2).cast("int").alias("planned"), m(11).alias("forward_n"), m(4).alias("forward_blocks"), F.round(m(13) / 100, 4).alias("forward_least"),
        F.when(m(17) > 0, F.round(m(17) / 200, 4)).alias("forward_p"), (m(19) > 3).alias("stable"), (m(23) > 4).alias("large"), m(12).alias("kept_n"), F.lit(6).alias("kept_needed"), F.when(m(29) > 0, m(2) == 0).alias("gone"),
    )
    return O.folded_night(before, tonight, ["id"], 0.05)


def classified_requests(spark, d):
    """Users' messages and the answers of a model, made of their length, that names a class, none, or one that isn't there."""
    c = S.table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("n"))
    vocabulary = spark.createDataFrame([(f"class{i}", i) for i in range(0, 14, 2)], "name string, class_id int")
    answers = c.where("n % 5 <> 0").select("id", F.concat(F.lit("class"), F.col("n") % 14).alias("name"), F.lit(1).alias("seq"))
    answers = answers.unionByName(c.where("n % 7 = 0").select("id", F.concat(F.lit("class"), F.col("n") % 3).alias("name"), F.lit(2).alias("seq")))
    return O.classified(c, F.broadcast(vocabulary), answers)


W = f"WITH {S.SQL.strip()}, {DAYS_SQL.strip()}"
WP = f"{W}, {PIECES_SQL.strip()}"
PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate((a, b) for a in KINDS for b in KINDS if a != b))
MEMBERS = f"""pr AS (SELECT * FROM (VALUES {PAIRS}) t(i, antecedent, consequent)),
mb AS (SELECT antecedent, consequent, antecedent || '>' || consequent || '|' || n AS key, c AS conditions FROM pr, (VALUES ('', []::VARCHAR[]), ('weekend', ['weekend']), ('early', ['early']), ('early+weekend', ['early', 'weekend'])) v(n, c)
  WHERE i % 3 = 0 OR (i % 3 = 1 AND n IN ('', 'weekend')) OR (i % 3 = 2 AND n = 'early')),
fa AS (SELECT lane, kind AS antecedent, first_uri AS uri, last_us, isodow(day) >= 6 AS weekend, CASE WHEN first_uri % 7 <> 0 THEN start_us % {DAY} < {12 * HOUR} END AS early FROM eps)"""
HOLDS = "(NOT list_contains(conditions, 'weekend') OR coalesce(weekend, false)) AND (NOT list_contains(conditions, 'early') OR coalesce(early, false))"
MOMENTS = f"""x0 AS (SELECT *, lead(start_us) OVER c AS next_us, lead(uri) OVER c AS next_uri, lead(reminded) OVER c AS next_reminded FROM rec WINDOW c AS (PARTITION BY lane, kind ORDER BY start_us, uri)),
x1 AS (SELECT *, coalesce(next_us <= start_us + {2 * DAY}, false) AS near FROM x0),
x2 AS (SELECT lane, kind, uri AS id, start_us, start_us + {3 * HOUR} AS to_us, start_us // {DAY} AS d, CASE WHEN near AND NOT next_reminded THEN true WHEN NOT near THEN false END AS came, next_uri, 1 - (k % 4) / 4 AS strength, CAST(k % 3 AS VARCHAR) AS input FROM x1),
x3 AS (SELECT *, CASE WHEN start_us <= max(to_us) OVER (PARTITION BY lane, kind, d ORDER BY start_us, to_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x2),
x4 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY lane, kind, d ORDER BY start_us, to_us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM x3),
x5 AS (SELECT x4.*, CASE WHEN came THEN NOT EXISTS (SELECT 1 FROM x4 y WHERE y.lane = x4.lane AND y.kind = x4.kind AND y.came AND y.next_uri = x4.next_uri AND (y.d, y.part) < (x4.d, x4.part)) END AS counts FROM x4),
mo AS (SELECT lane, kind, min(start_us) AS at_us, array_to_string(list_sort(list(DISTINCT input)), '+') AS signature, max(CASE WHEN counts THEN strength END) AS hit, max(CASE WHEN NOT came THEN strength END) AS miss, count(*) AS n FROM x5 GROUP BY lane, kind, d, part)"""
SQL = {
    "opportunity_table": WP + f""", ln AS (SELECT DISTINCT lane FROM rec), pr AS (SELECT * FROM (VALUES {PAIRS}) t(i, antecedent, consequent)),
ch AS (SELECT lane, lane || '|' || antecedent || '|' || consequent AS key, antecedent, consequent FROM ln, pr WHERE (lane + i) % 4 = 0 OR ((lane + i) % 4 = 1 AND i % 5 <> 0)),
ca AS (SELECT c.*, e.first_uri AS a_uri, e.day, e.last_us AS f, e.last_us + {WINDOW} AS t FROM ch c JOIN eps e ON e.lane = c.lane AND e.kind = c.antecedent),
cb AS (SELECT key, ca.lane, a_uri, ca.day, min((b.start_us, b.first_uri)) FILTER (WHERE b."natural") AS first, bool_or(NOT b."natural") AS reminded FROM ca LEFT JOIN eps b ON b.lane = ca.lane AND b.kind = ca.consequent AND b.start_us > f AND b.start_us <= t GROUP BY 1, 2, 3, 4),
dk AS (SELECT DISTINCT lane, a_uri FROM ca WHERE EXISTS (SELECT 1 FROM sp WHERE sp.lane = ca.lane AND piece_begin < t AND piece_end > f)),
si AS (SELECT lane, lane || '|weekday|' || consequent AS key, lane % 7 + 1 AS wd, consequent FROM ln, (SELECT unnest({list(KINDS)}) AS consequent) WHERE lane % 5 <> 0),
sd AS (SELECT s.key, s.lane, r.day, CASE WHEN day(r.day) % 10 <> 0 THEN CASE WHEN wd >= 6 THEN 'weekend' ELSE 'workday' END END AS type, CASE WHEN m."natural" > 0 THEN true WHEN m."natural" IS NULL THEN false END AS came, m.natural_uri, m.natural_us
  FROM si s JOIN (SELECT DISTINCT lane, day FROM rec) r ON r.lane = s.lane AND isodow(r.day) = wd LEFT JOIN days m ON m.lane = s.lane AND m.kind = s.consequent AND m.day = r.day)
SELECT cb.key, cb.lane, 'chain' AS segment, CAST(day AS VARCHAR) AS day, CAST(cb.a_uri AS VARCHAR) AS antecedent_uri, CASE WHEN first IS NOT NULL THEN true WHEN NOT coalesce(reminded, false) AND dk.lane IS NULL THEN false END AS came, first[2] AS consequent_uri, first[1] AS consequent_us FROM cb LEFT JOIN dk ON dk.lane = cb.lane AND dk.a_uri = cb.a_uri
UNION ALL SELECT key, lane, 'situation', CAST(day AS VARCHAR), 'calendar:' || CAST(day AS VARCHAR), came, natural_uri, natural_us FROM sd
WHERE type IS NULL OR type IN (SELECT type FROM sd z WHERE z.key = sd.key AND z.came AND z.type IS NOT NULL) OR NOT EXISTS (SELECT 1 FROM sd z WHERE z.key = sd.key AND z.came AND z.type IS NOT NULL)""",
    "most_specific_relations": f"{W}, {MEMBERS} SELECT antecedent, consequent, lane, uri, key, CAST(len(conditions) AS INT) AS n_conditions FROM (SELECT mb.*, lane, uri, row_number() OVER (PARTITION BY mb.antecedent, consequent, lane, uri ORDER BY len(conditions) DESC, key) AS r FROM mb JOIN fa ON fa.antecedent = mb.antecedent WHERE {HOLDS}) WHERE r = 1",
    "present_antecedents": f"""{W}, {MEMBERS}, ne AS (SELECT * FROM fa WHERE last_us < {NOW} AND last_us + {WINDOW} >= {NOW} QUALIFY row_number() OVER (PARTITION BY lane, antecedent ORDER BY last_us DESC, uri DESC) = 1),
cs AS (SELECT lane, mb.antecedent, consequent, key, uri FROM mb JOIN ne ON ne.antecedent = mb.antecedent WHERE {HOLDS} QUALIFY row_number() OVER (PARTITION BY lane, mb.antecedent, consequent ORDER BY len(conditions) DESC, key) = 1)
SELECT l.lane, mb.antecedent, mb.consequent, mb.key, uri IS NOT NULL AS present, uri AS source FROM (SELECT DISTINCT lane FROM eps) l CROSS JOIN mb LEFT JOIN cs ON cs.lane = l.lane AND cs.key = mb.key""",
    "same_goal_arrivals": f"""{W}, g AS (SELECT *, CASE WHEN k % 5 < 4 THEN k % 5 END AS goal FROM ms), c AS (SELECT lane, kind, episode, min(uri) AS chain, CAST(make_timestamp(min(start_us)) AS DATE) AS day, max(last_us) AS end_us, list(DISTINCT goal) FILTER (WHERE goal IS NOT NULL) AS goals FROM g GROUP BY 1, 2, 3)
SELECT c.lane, c.kind AS antecedent, c.chain, g.kind AS consequent, bool_or(coalesce(list_contains(goals, goal), false)) AS same FROM c JOIN g ON g.lane = c.lane AND g.day = c.day AND g.kind <> c.kind AND g.start_us > end_us AND g.start_us <= end_us + {WINDOW} WHERE len(goals) > 0 GROUP BY 1, 2, 3, 4""",
    "labelled_moments": f"WITH {S.SQL.strip()}, {MOMENTS} SELECT lane, kind, at_us, signature, hit IS NOT NULL AS came, round(coalesce(hit, miss), {P}) AS strength, n FROM mo WHERE hit IS NOT NULL OR miss IS NOT NULL",
    "unit_decisions": """WITH i AS (SELECT l_orderkey AS unit, l_linenumber::BIGINT AS id, (l_linenumber + l_orderkey) % 3 > 0 AS due, l_returnflag <> 'N' AS backed, (l_linenumber + l_orderkey) % 4 > 1 AS est, CASE WHEN (l_linenumber + l_orderkey) % 5 > 0 THEN (l_linenumber + l_orderkey) % 5 > 1 END AS large,
round(l_discount::DOUBLE - 0.04, 4) AS lift, round(l_tax::DOUBLE * 10, 4) AS lower, round(l_tax::DOUBLE * 10 + 0.3, 4) AS upper FROM lineitem),
p AS (SELECT *, coalesce(est AND large AND lift > 0, false) AS cause, NOT backed OR (est AND coalesce(large, true)) AS may FROM i),
a AS (SELECT * FROM p WHERE due OR NOT EXISTS (SELECT 1 FROM p q WHERE q.unit = p.unit AND q.due)),
b AS (SELECT * FROM a WHERE cause OR NOT EXISTS (SELECT 1 FROM a q WHERE q.unit = a.unit AND q.cause)),
c AS (SELECT * FROM b WHERE cause OR may OR NOT EXISTS (SELECT 1 FROM b q WHERE q.unit = b.unit AND q.may)),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unit ORDER BY CASE WHEN cause THEN lift ELSE lower END DESC, id DESC, large DESC NULLS LAST, lift DESC, lower DESC, upper DESC) = 1)
SELECT unit, id, may AS speakable, CASE WHEN unit % 13 = 0 OR NOT may OR unit % 11 = 0 THEN 0 WHEN unit % 13 = 1 THEN 1 WHEN upper < 0.5 THEN 0 WHEN lower >= 0.5 THEN 1 WHEN unit % 2 = 0 THEN 1 ELSE 0 END AS level,
CASE WHEN large IS NULL THEN 'watching' WHEN lower >= 0.5 THEN CASE WHEN large AND lift > 0 THEN 'basis' ELSE 'coincidence' END WHEN upper < 0.5 THEN CASE WHEN large AND lift > 0 THEN 'miscomputed' ELSE 'not_a_cause' END WHEN large AND lift > 0 THEN 'cannot_rise' ELSE 'watching' END AS "check" FROM d""",
    "assessed_relations": f"""WITH t AS (SELECT o_orderkey AS k, round((o_custkey * 7 + o_orderkey) % 100 / 100 - 0.5, 4) AS v FROM orders),
e AS (SELECT k, v, CASE WHEN k % 2 = 0 THEN v - 0.2 ELSE -(v + 0.2) END AS near, CASE WHEN k % 2 = 0 THEN v + 0.2 ELSE -(v - 0.2) END AS far, CASE WHEN k % 2 = 0 THEN 2 * v - 0.5 ELSE -(2 * v + 0.5) END AS rnear, CASE WHEN k % 2 = 0 THEN 2 * v + 0.5 ELSE -(2 * v - 0.5) END AS rfar FROM t)
SELECT k AS id, k % 5 <> 0 AND (k % 8 = 0 OR round(k % 10 / 50, 4) >= 0.05) AS stable,
(k % 9 <> 0 AND near >= 0.05 AND (k % 7 = 0 OR rnear >= 0.2)) OR (k % 11 <> 0 AND k % 3 = 0 AND NOT (k % 9 <> 0 AND (far < 0.05 OR (k % 7 <> 0 AND rfar < 0.2)))) AS large, CASE WHEN k % 6 <> 0 THEN round(k % 40 * v / (k % 6), {P}) END AS excess_share FROM e""",
    "folded_relations": """WITH b AS (SELECT o_orderkey AS k, (['sparse', 'tested', 'candidate', 'established', 'rejected', 'expired'])[o_orderkey % 6 + 1] AS was, o_orderkey % 9 + 1 AS needed FROM orders WHERE o_orderkey % 5 > 0),
j AS (SELECT o.o_orderkey AS k, was, needed, o.o_orderkey % 7 > 0 AS here FROM orders o LEFT JOIN b ON b.k = o.o_orderkey WHERE b.k IS NOT NULL OR o.o_orderkey % 7 > 0),
s AS (SELECT *, CASE WHEN NOT here THEN was
 WHEN k % 37 = 0 THEN CASE WHEN was IN ('candidate', 'established') THEN 'expired' ELSE coalesce(was, 'sparse') END
 WHEN was = 'candidate' THEN CASE WHEN k % 11 < needed OR k % 4 < 2 OR round(k % 13 / 100, 4) >= 0.05 THEN 'candidate' WHEN k % 17 > 0 AND round(k % 17 / 200, 4) < 0.05 AND k % 19 > 3 AND k % 23 > 4 THEN 'established' ELSE 'rejected' END
 WHEN was = 'established' THEN CASE WHEN k % 12 >= 6 AND k % 29 > 0 AND k % 2 = 0 THEN 'expired' ELSE 'established' END
 WHEN k % 4 = 0 THEN 'candidate' WHEN was IN ('rejected', 'expired') THEN was WHEN k % 3 > 0 THEN 'tested' ELSE 'sparse' END AS status FROM j)
SELECT k AS id, status, CAST(CASE WHEN status = 'candidate' AND coalesce(was, '') <> 'candidate' THEN 30 WHEN was IS NOT NULL THEN 10 END AS INT) AS discovered, CAST(CASE WHEN status = 'candidate' AND coalesce(was, '') <> 'candidate' THEN k % 8 + 2 ELSE needed END AS INT) AS needed, was IS NULL OR status <> was AS moved FROM s""",
    "classified_requests": """WITH c AS (SELECT conv_id * 1000 + turn AS id, length(text) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT id, CASE WHEN n % 7 = 0 THEN n % 3 WHEN n % 5 <> 0 THEN n % 14 END AS x FROM c)
SELECT id, CAST(CASE WHEN x % 2 = 0 THEN x END AS INT) AS class_id, CASE WHEN x IS NULL THEN 'unanswered' WHEN x % 2 = 0 THEN 'classified' ELSE 'outside' END AS state FROM a""",
}
QUERIES = {n: globals()[n] for n in SQL} | {"unit_readings": unit_readings}
