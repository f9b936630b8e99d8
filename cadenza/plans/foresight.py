"""Queries of timelines, levels, deliveries, recall upkeep and conversation journals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import day_number, slot_of
from cadenza.operators import foresight as X
from cadenza.operators import temporal as T
from cadenza.plans.temporal import DAYS_SQL, PIECES_SQL
from cadenza.plans.vectors import HIT, _hits
from cadenza.sources import series as S

DAY = 86_400_000_000
AT = 1_705_500_000_000_000


def _slots(spark, d):
    r = S.records(spark, d)
    missed = T.missed_slots(T.standing_pieces(S.gaps(spark, d), r))
    return r, X.present_slots(r, slot_of(F.col("start_us")), missed)


def thinned_chains(spark, d):
    e = T.episodes(S.records(spark, d)).select("lane", "kind", day_number(F.col("day")).cast("long").alias("day_no"))
    return X.thinned(e)


def first_chains_of_day(spark, d):
    return X.first_of_day(T.episodes(S.records(spark, d))).select("lane", "kind", "start_us")


def present_slots(spark, d):
    return _slots(spark, d)[1].withColumn("day", F.col("day").cast("string"))


def full_windows(spark, d):
    return X.fully_present(_slots(spark, d)[1], 8).withColumn("day", F.col("day").cast("string"))


def prefix_hits(spark, d):
    r, p = _slots(spark, d)
    hits = r.where("kind = 'click'").select("lane", "day", slot_of(F.col("start_us")).alias("slot"))
    return X.prefix_hits(p, hits).withColumn("day", F.col("day").cast("string"))


def situation_streaks(spark, d):
    r = S.records(spark, d)
    return X.streaks(r, r.where("kind = 'purchase'").select("lane", F.col("start_us").alias("at_us")).distinct(), 3)


def class_markers(spark, d):
    return X.markers(T.occurrence_days(T.episodes(S.records(spark, d))), 10).withColumn("day", F.col("day").cast("string"))


def prior_weights(spark, d):
    a = S.events(spark, d).select("lane", "kind", (F.col("k") % 3).alias("rank"))
    return X.prior_levels(a, ["lane", "kind"])


def account_levels(spark, d):
    e = S.records(spark, d).select("lane", "kind", F.col("start_us").alias("seq"), "uri", (F.col("k") / 100).alias("lower"), (F.col("k") / 100 + 0.2).alias("upper"), F.when(F.col("k") % 19 == 0, "always").when(F.col("k") % 19 == 1, "never").alias("setting"))
    return X.levels(e, ["lane", "kind"], 0.6).select("uri", "level")


def delivery_decisions(spark, d):
    e = S.records(spark, d).select("lane", "day", F.col("uri").alias("id"), (F.col("k") % 3 > 0).cast("int").alias("level"), F.col("start_us").alias("due_us"), (F.col("k") % 4 == 0).alias("awaiting"))
    return X.deliveries(e, 1).select("id", "decision")


def open_reminders(spark, d):
    e = S.records(spark, d).select(F.col("uri").alias("id"), (F.col("start_us") + DAY).alias("deadline_us"))
    s = S.records(spark, d).where("k % 2 = 0").select(F.col("uri").alias("id"), F.col("start_us").alias("spoken_us"))
    return X.open_reminders(e, s, S.records(spark, d).where("k % 6 = 0").select(F.col("uri").alias("id")), AT, 25)


def relabel_delta(spark, d):
    e = S.events(spark, d)
    before = e.where("k % 7 <> 0").select("uri", F.when(F.col("k") % 5 > 0, F.col("kind")).alias("label"))
    after = e.where("k % 11 <> 0").select("uri", F.when(F.col("k") % 4 > 0, F.col("kind")).alias("label"))
    return X.snapshot_delta(before, after, ["uri"])


def recall_uses(spark, d):
    s = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("n"), F.lit(AT).alias("last_us"), F.lit(1).alias("version"), (F.col("vec_id") % 13 == 0).alias("retiring"))
    u = S.events(spark, d).select((F.col("uri") % 700).alias("id"), F.col("start_us").alias("used_us"))
    return X.used(s, u, 20)


def retirement_candidates(spark, d):
    """Classes without an act for as long as their kind allows."""
    r = S.records(spark, d).groupBy("lane", "kind").agg(F.max("start_us").alias("last_us"))
    allowed = F.element_at(F.create_map(*[F.lit(x) for x in ("view", 2, "click", 4, "purchase", 6, "signup", 8)]), F.col("kind"))
    return r.where(F.lit(1_706_659_200_000_000) - F.col("last_us") >= allowed.cast("long") * DAY)


def review_levels(spark, d):
    """How long an order has been unconfirmed."""
    o = S.table(spark, d, "orders").where("o_orderstatus = 'P'")
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", F.when(age < 365, "current").when(age < 730, "first").when(age < 1460, "second").otherwise("strong").alias("level"))


def linked_neighbours(spark, d):
    li = S.events(spark, d).select(F.col("lane").alias("a"), F.col("k").cast("long").alias("b"), "kind").distinct()
    both = li.unionByName(li.where("(a + b) % 3 <> 0").select(F.col("b").alias("a"), F.col("a").alias("b"), "kind")).distinct()
    return X.neighbours(spark.range(0, 60, 2), both, 4).select("id", "kind", "b")


def packed_context(spark, d):
    sized = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    return X.packed_context(_hits(spark, d, 20).join(sized, "id"), 6000)


def reranked_hits(spark, d):
    """Outside scores where there are any, above a threshold; else the vector's own."""
    ext = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.5 + F.col("toxic") * 0.3).cast("double").alias("outside"))
    h = _hits(spark, d).join(ext, "id", "left").withColumn("final", F.coalesce("outside", "score")).where("final >= 0.2")
    return h.select("query_id", "id", F.round("final", 6).alias("final"))


def hierarchical_scores(spark, d):
    """Labels as directories, vectors as their documents: each 80% its own score and 20% its directory's."""
    h = _hits(spark, d, None)
    dirs = h.groupBy("query_id", "label").agg(F.max("score").alias("score")).select("query_id", (-F.col("label") - 1).cast("long").alias("id"), "score")
    kids = h.select("query_id", (-F.col("label") - 1).cast("long").alias("parent"), "id", F.col("score").alias("local"))
    return X.expanded(dirs, kids).withColumn("score", F.round("score", 6))


def title_similarities(spark, d):
    n = S.table(spark, d, "nation").select("n_nationkey", "n_name")
    b = n.select(((F.col("n_nationkey") + 1) % 25).alias("n_nationkey"), F.col("n_name").alias("other"))
    return n.join(b, "n_nationkey").select("n_nationkey", F.round(X.title_similarity("n_name", "other"), 6).alias("ratio"))


def reduced_results(spark, d):
    t = S.table(spark, d, "documents")
    return t.select("doc_id", F.md5(X.reduced_result(F.col("text"), 2000)).alias("digest"))


def journal_faults(spark, d):
    c = S.table(spark, d, "conversations").where("not (conv_id % 4 = 0 and turn = 1)")
    again = c.where("conv_id % 5 = 0").select("conv_id", "turn", F.upper("text").alias("text"))
    return X.journal_faults(c.select("conv_id", "turn", "text").unionByName(again))


def aged_chains(spark, d):
    e = S.events(spark, d).select((F.col("uri") % 50).alias("source"), F.floor(F.col("uri") / 50).alias("seq"), "k")
    return X.aged_chains(e, "source", F.col("k") < 60, 4)


def resettled_facts(spark, d):
    """Late rows change what an order's first shipment is: a revision where it differs, or where there was none."""
    x = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber"), F.col("l_shipdate").cast("date").alias("at"))
    old = x.where("l_linenumber % 2 = 1").groupBy("l_orderkey").agg(F.min("at").alias("was"))
    new = x.groupBy("l_orderkey").agg(F.min("at").alias("now"))
    return new.join(old, "l_orderkey", "left").where(~F.col("was").eqNullSafe(F.col("now"))).select("l_orderkey", F.col("was").cast("string").alias("was"), F.col("now").cast("string").alias("now"))


def orphaned_combinations(spark, d):
    """Combined keys a+b of which no part stands alone."""
    e = S.events(spark, d).groupBy("lane").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("combo"), F.count("*").alias("n"))
    alone = S.events(spark, d).where("k < 6").select("lane", F.col("kind").alias("part")).distinct()
    parts = e.select("lane", "combo", F.explode(F.split("combo", r"\+")).alias("part"))
    return e.join(parts.join(alone, ["lane", "part"], "left_semi").select("lane").distinct(), "lane", "left_anti").select("lane", "combo")


EV = f"WITH {S.SQL.strip()}"
EP = f"{EV}, {DAYS_SQL.strip()}"
SLOTS = f"{EV}, {PIECES_SQL.strip()}, ps0 AS (SELECT lane, day, unnest(range(min((start_us % {DAY}) // 900000000), max((start_us % {DAY}) // 900000000) + 1))::INT AS slot FROM rec GROUP BY lane, day), ps AS (SELECT lane, day, slot FROM ps0 WHERE NOT EXISTS (SELECT 1 FROM missed m WHERE m.lane = ps0.lane AND m.day = ps0.day AND m.slot = ps0.slot AND m.missed >= 1))"
SQL = {
    "first_chains_of_day": EP + " SELECT lane, kind, min(start_us) AS start_us FROM eps GROUP BY lane, kind, day",
    "present_slots": SLOTS + " SELECT lane, CAST(day AS VARCHAR) AS day, slot FROM ps",
    "full_windows": SLOTS + " SELECT lane, CAST(day AS VARCHAR) AS day, slot FROM ps WHERE (SELECT count(*) FROM ps q WHERE q.lane = ps.lane AND q.day = ps.day AND q.slot > ps.slot AND q.slot <= ps.slot + 8) = 8",
    "prefix_hits": SLOTS + f", h AS (SELECT DISTINCT lane, day, (start_us % {DAY}) // 900000000 AS slot FROM rec WHERE kind = 'click') SELECT ps.lane, CAST(ps.day AS VARCHAR) AS day, ps.slot, CAST(sum((h.slot IS NOT NULL)::INT) OVER (PARTITION BY ps.lane, ps.day ORDER BY ps.slot) AS BIGINT) AS through FROM ps LEFT JOIN h ON h.lane = ps.lane AND h.day = ps.day AND h.slot = ps.slot",
    "situation_streaks": EV + f", a AS (SELECT DISTINCT lane, start_us AS at_us FROM rec WHERE kind = 'purchase') SELECT lane, at_us, " + " AND ".join(f"EXISTS (SELECT 1 FROM rec r WHERE r.lane = a.lane AND r.start_us < at_us - {i * DAY} AND r.start_us >= at_us - {(i + 1) * DAY})" for i in range(3)) + " AS held FROM a",
    "class_markers": EP + ", g AS (SELECT lane, kind, day, date_diff('day', lag(day) OVER (PARTITION BY lane, kind ORDER BY day), day) AS gap FROM days) SELECT lane, kind, CAST(day AS VARCHAR) AS day, CASE WHEN gap IS NULL THEN 'first_seen' ELSE 'return' END AS marker FROM g WHERE gap IS NULL OR gap >= 10",
    "prior_weights": EV + ", s AS (SELECT lane, kind, max(k % 3) - min(k % 3) AS spread, CAST(round_even(median(k % 3), 0) AS INT) AS mid FROM ev GROUP BY 1, 2), l AS (SELECT lane, kind, CASE WHEN spread >= 2 THEN 1 ELSE mid END AS level FROM s) SELECT lane, kind, level, CASE level WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM l",
    "account_levels": EV + " SELECT uri, coalesce(last_value(CASE WHEN k % 19 = 0 THEN 1 WHEN k % 19 = 1 THEN 0 WHEN k / 100 >= 0.6 THEN 1 WHEN k / 100 + 0.2 < 0.6 THEN 0 END IGNORE NULLS) OVER (PARTITION BY lane, kind ORDER BY start_us ROWS UNBOUNDED PRECEDING), 0) AS level FROM rec",
    "delivery_decisions": EV + ", t AS (SELECT uri AS id, k, k % 3 > 0 AS lv, row_number() OVER (PARTITION BY lane, day, k % 3 > 0 ORDER BY start_us, uri) AS turn FROM rec) SELECT id, CASE WHEN NOT lv THEN 'shadow' WHEN turn > 1 THEN 'full' WHEN k % 4 = 0 THEN 'awaiting_host' ELSE 'spoken' END AS decision FROM t",
    "open_reminders": EV + f" SELECT uri AS id, start_us + {DAY} AS deadline_us, start_us AS spoken_us FROM rec WHERE start_us + {DAY} > {AT} AND k % 2 = 0 AND k % 6 <> 0 ORDER BY 2, 1 LIMIT 25",
    "relabel_delta": EV + ", b AS (SELECT uri, CASE WHEN k % 5 > 0 THEN kind END AS l FROM ev WHERE k % 7 <> 0), a AS (SELECT uri, CASE WHEN k % 4 > 0 THEN kind END AS l FROM ev WHERE k % 11 <> 0) SELECT coalesce(b.uri, a.uri) AS uri, CASE WHEN b.uri IS NULL THEN 'added' WHEN a.uri IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.uri = b.uri WHERE b.uri IS NULL OR a.uri IS NULL OR a.l IS DISTINCT FROM b.l",
    "recall_uses": EV + f", u AS (SELECT uri % 700 AS id, count(*) AS more, max(start_us) AS at_us FROM ev GROUP BY 1) SELECT vec_id AS id, CASE WHEN more IS NOT NULL AND vec_id % 13 <> 0 THEN least(vec_id % 9 + more, 20) ELSE vec_id % 9 END AS n, CASE WHEN more IS NOT NULL AND vec_id % 13 <> 0 THEN greatest({AT}, at_us) ELSE {AT} END AS last_us, 1 + (more IS NOT NULL AND vec_id % 13 <> 0)::INT AS version, more IS NOT NULL AND vec_id % 13 = 0 AS refused FROM embeddings LEFT JOIN u ON u.id = vec_id",
    "retirement_candidates": EV + f" SELECT lane, kind, max(start_us) AS last_us FROM rec GROUP BY 1, 2 HAVING 1706659200000000 - max(start_us) >= CASE kind WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'purchase' THEN 6 ELSE 8 END * {DAY}",
    "review_levels": "SELECT o_orderkey, CASE WHEN a < 365 THEN 'current' WHEN a < 730 THEN 'first' WHEN a < 1460 THEN 'second' ELSE 'strong' END AS level FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS a FROM orders WHERE o_orderstatus = 'P')",
    "linked_neighbours": EV + ", li AS (SELECT DISTINCT lane AS a, k::BIGINT AS b, kind FROM ev), bo AS (SELECT a, b, kind FROM li UNION SELECT b, a, kind FROM li WHERE (a + b) % 3 <> 0), mu AS (SELECT * FROM bo x WHERE EXISTS (SELECT 1 FROM bo y WHERE y.a = x.b AND y.b = x.a)) SELECT a AS id, kind, b FROM mu WHERE a < 60 AND a % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY kind, b) <= 4",
    "reranked_hits": HIT + " SELECT query_id, id, round(coalesce(quality * 0.5 + toxic * 0.3, score), 6) AS final FROM rk LEFT JOIN labels ON doc_id = id WHERE rank <= 10 AND coalesce(quality * 0.5 + toxic * 0.3, score) >= 0.2",
    "hierarchical_scores": HIT + ", di AS (SELECT query_id, label, max(score) AS s FROM sc GROUP BY 1, 2) SELECT query_id, (-label - 1)::BIGINT AS id, round(s, 6) AS score FROM di UNION ALL SELECT sc.query_id, sc.id, round(0.8 * score + (1 - 0.8) * s, 6) FROM sc JOIN di ON di.query_id = sc.query_id AND di.label = sc.label",
    "reduced_results": "SELECT doc_id, md5(CASE WHEN strlen(text) <= 2000 THEN text ELSE '[omitted ' || strlen(text) || ' bytes, sha256 ' || sha256(text) || ']' END) AS digest FROM documents",
    "journal_faults": "WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn = 1)), x AS (SELECT * FROM c UNION ALL SELECT conv_id, turn, upper(text) FROM c WHERE conv_id % 5 = 0), b AS (SELECT conv_id, turn, count(DISTINCT text) AS texts FROM x GROUP BY 1, 2) SELECT conv_id, max(turn) - min(turn) + 1 - count(*) AS holes, count(CASE WHEN texts > 1 THEN 1 END) AS conflicts FROM b GROUP BY 1",
    "aged_chains": EV + ", o AS (SELECT uri % 50 AS source, uri // 50 AS seq, uri // 50 - row_number() OVER (PARTITION BY uri % 50 ORDER BY uri // 50) AS island FROM ev WHERE k < 60) SELECT source, min(seq) AS first, max(seq) AS last, count(*) AS n FROM o GROUP BY source, island HAVING count(*) >= 4",
    "resettled_facts": "WITH n AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS now, CAST(min(CASE WHEN l_linenumber % 2 = 1 THEN l_shipdate END) AS DATE) AS was FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(was AS VARCHAR) AS was, CAST(now AS VARCHAR) AS now FROM n WHERE was IS DISTINCT FROM now",
    "orphaned_combinations": EV + ", e AS (SELECT lane, array_to_string(list_sort(list_distinct(list(kind))), '+') AS combo FROM ev GROUP BY lane) SELECT lane, combo FROM e WHERE lane NOT IN (SELECT lane FROM ev WHERE k < 6)",
}
SQL["thinned_chains"] = f"""WITH RECURSIVE {S.SQL.strip()}, {DAYS_SQL.strip()}, dd AS (SELECT DISTINCT lane, kind, date_diff('day', DATE '1970-01-01', day) AS day_no FROM eps),
kept AS (SELECT lane, kind, min(day_no) AS day_no FROM dd GROUP BY 1, 2 UNION ALL SELECT r.lane, r.kind, min(dd.day_no) FROM kept r JOIN dd ON dd.lane = r.lane AND dd.kind = r.kind AND dd.day_no > r.day_no + 5 GROUP BY r.lane, r.kind, r.day_no)
SELECT lane, kind, day_no FROM kept"""
QUERIES = {n: globals()[n] for n in SQL} | {f.__name__: f for f in (packed_context, title_similarities)}
