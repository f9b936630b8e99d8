"""Queries of state upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import micros
from cadenza.operators import state as T
from cadenza.sources import series as S

HORIZON = 1_706_400_000_000_000


def class_tokens(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("s-k"), F.col("p_partkey"))).otherwise(F.concat(F.lit("s-k"), T.padded(F.col("p_partkey")))).alias("token"))
    return p.select("p_partkey", T.class_id(F.col("token")).alias("number"))


def promoted_groups(spark, d):
    pool = S.events(spark, d).where("skip_reason is not null").select("lane", "kind", "day")
    return T.promoted(pool, ["lane", "kind"])


def class_anchors(spark, d):
    return T.anchors(S.records(spark, d), ["kind"], [F.col("start_us").desc(), F.col("uri").desc()]).select("kind", "uri")


def sealed_records(spark, d):
    return T.sealed(S.records(spark, d), F.lit(HORIZON)).groupBy("kind").agg(F.count("*").alias("n"), F.max("start_us").alias("last_us"))


def closed_days(spark, d):
    r = S.records(spark, d)
    spine = r.select("lane", "day").distinct()
    return T.closed_days(spine, r.where("k % 10 = 9")).withColumn("day", F.col("day").cast("string"))


def claimed_names(spark, d):
    r = S.records(spark, d).select("uri", "lane", "day", F.col("kind").alias("name"), "start_us")
    return T.claimed_names(r, ["lane", "day", "name"], ["start_us", "uri"]).select("uri", "given", "original_name")


def pending_judgements(spark, d):
    e = S.events(spark, d)
    return e.join(e.where("k % 2 = 0").select("uri"), "uri", "left_anti").where("skip_reason is null").select("uri", (F.col("kind") != "error").alias("readable"))


def overview_rollup(spark, d):
    o = S.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_totalprice")
    return o.rollup("y", "m").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def derived_judgements(spark, d):
    """Per order: earliest and latest shipment, and ready when the last line has come."""
    x = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(micros("l_shipdate")).alias("start_us"), F.max(micros("l_shipdate")).alias("ready_us"), F.count("*").alias("n"))
    return x.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "l_orderkey", "start_us", "ready_us"), 256), 1, 24))


def contiguous_watermarks(spark, d):
    m = S.events(spark, d).where("k % 29 <> 4").select((F.col("uri") % 97).alias("source"), F.floor(F.col("uri") / 97).alias("seq"))
    return T.contiguous_through(m, ["source"])


def source_watermarks(spark, d):
    m = S.events(spark, d).select(F.col("lane"), F.col("uri").alias("seq"), (F.col("uri") + F.col("k") * 7).alias("mark"))
    return T.released_through(m, ["lane"])


def ordered_delivery(spark, d):
    i = S.events(spark, d).select("lane", F.col("uri").alias("seq"), (F.col("k") > 3).alias("committed"))
    return T.ready_in_order(i, ["lane"]).select("lane", "seq")


def idempotent_deliveries(spark, d):
    e = S.events(spark, d).select(F.sha2(F.concat_ws("|", "lane", "kind", "k"), 256).alias("source_id"), "uri")
    return e.groupBy("source_id").agg(F.min("uri").alias("uri"))


def retry_delays(spark, d):
    return S.events(spark, d).select("uri", T.backoff(F.col("k") % 12 + 1).alias("delay"))


def identity_plan(spark, d):
    held = S.table(spark, d, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.md5("text")).alias("digest"))
    new = S.table(spark, d, "documents").where("doc_id % 5 <> 1").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return T.identity_plan(held, new)


def _links(spark, d):
    return S.events(spark, d).select((F.col("lane")).alias("a"), (F.col("k")).cast("long").alias("b"), F.col("kind"))


def link_remap(spark, d):
    m = spark.range(0, 100, 7).select("id", (F.col("id") + 1).alias("into"))
    return T.remapped_links(_links(spark, d), m, spark.range(3, 100, 10).select("id"))


def reciprocal_links(spark, d):
    return T.reciprocal(_links(spark, d)).distinct()


def normalised_links(spark, d):
    """Distinct links in order of their identity, and how often each was stated."""
    return _links(spark, d).groupBy("a", "b", "kind").agg(F.count("*").alias("stated"))


def patched_fields(spark, d):
    cur = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    new = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.max("o_orderkey") % 2 == 0, F.max("o_orderkey")).alias("nation"), F.when(F.max("o_orderkey") % 3 == 0, F.max("o_totalprice")).alias("balance"))
    return T.patched(cur, new, ["nation"], ["balance"])


def reminder_leases(spark, d):
    r = S.events(spark, d).select(F.col("uri").alias("id"), (F.col("start_us") + 3_600_000_000).alias("deadline_us"), (F.col("k") % 5).alias("tries"))
    h = S.events(spark, d).where("k % 3 = 0").select(F.col("uri").alias("id"), (F.col("start_us") + 1_800_000_000).alias("until_us"))
    return T.leases(r, h, 1_705_000_000_000_000, 1_800_000_000, 40)


def concept_closure(spark, d):
    n, r = S.table(spark, d, "nation"), S.table(spark, d, "region")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world")))
    return T.closure(up)


def canonical_props(spark, d):
    return S.table(spark, d, "events").select("event_id", T.canonical_json("props").alias("props")).withColumn("digest", F.sha2("props", 256))


def dirty_days(spark, d):
    """Days whose records differ between two states of the log: what has to be written again."""
    e = S.events(spark, d)
    sums = lambda x: x.groupBy("day").agg(F.count("*").alias("n"), F.sum(F.col("start_us").cast("decimal(20,0)")).alias("s"))  # noqa: E731  # a day's sum passes a long at some 5,400 rows
    a, b = sums(e.where("uri % 499 <> 0")), sums(e)
    return b.exceptAll(a).select(F.col("day").cast("string").alias("day"))


EV = f"WITH {S.SQL.strip()} "
LINKS = EV + ", li AS (SELECT lane AS a, k::BIGINT AS b, kind FROM ev)"
SQL = {
    "class_tokens": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 OR length(CAST(p_partkey AS VARCHAR)) >= 4 THEN CAST(p_partkey AS BIGINT) END AS number FROM part",
    "promoted_groups": EV + "SELECT lane, kind, count(*) AS n, count(DISTINCT day) AS days FROM ev WHERE skip_reason IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT day) >= 2",
    "class_anchors": EV + "SELECT kind, uri FROM rec QUALIFY row_number() OVER (PARTITION BY kind ORDER BY start_us DESC, uri DESC) <= 8",
    "sealed_records": EV + f"SELECT kind, count(*) AS n, max(start_us) AS last_us FROM rec WHERE start_us < {HORIZON} GROUP BY 1",
    "closed_days": EV + "SELECT lane, CAST(day AS VARCHAR) AS day FROM rec GROUP BY lane, day HAVING count(CASE WHEN k % 10 = 9 THEN 1 END) = 0",
    "claimed_names": EV + ", c AS (SELECT uri, kind, row_number() OVER (PARTITION BY lane, day, kind ORDER BY start_us, uri) AS n FROM rec) SELECT uri, CASE WHEN n = 1 THEN kind ELSE kind || '-' || n END AS given, CASE WHEN n > 1 THEN kind END AS original_name FROM c",
    "pending_judgements": EV + "SELECT uri, kind <> 'error' AS readable FROM ev WHERE k % 2 = 1 AND skip_reason IS NULL",
    "overview_rollup": "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (1, 2)",
    "derived_judgements": "SELECT *, substr(sha256(l_orderkey || '|' || start_us || '|' || ready_us), 1, 24) AS id FROM (SELECT l_orderkey, min(epoch_us(l_shipdate)) AS start_us, max(epoch_us(l_shipdate)) AS ready_us, count(*) AS n FROM lineitem GROUP BY 1)",
    "contiguous_watermarks": EV + ", m AS (SELECT DISTINCT uri % 97 AS source, uri // 97 AS seq FROM ev WHERE k % 29 <> 4), r AS (SELECT *, seq - min(seq) OVER (PARTITION BY source) = row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS ok FROM m) SELECT source, max(CASE WHEN ok THEN seq END) AS through, count(CASE WHEN NOT ok THEN 1 END) AS beyond FROM r GROUP BY 1",
    "source_watermarks": EV + ", m AS (SELECT lane, uri + k * 7 AS mark, uri + k * 7 < max(uri + k * 7) OVER (PARTITION BY lane ORDER BY uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM ev) SELECT lane, max(mark) AS released, count(CASE WHEN back THEN 1 END) AS rejected FROM m GROUP BY 1",
    "ordered_delivery": EV + "SELECT lane, min(uri) AS seq FROM ev WHERE k <= 3 GROUP BY lane",
    "idempotent_deliveries": EV + "SELECT sha256(lane || '|' || kind || '|' || k) AS source_id, min(uri) AS uri FROM ev GROUP BY 1",
    "retry_delays": EV + "SELECT uri, least(300.0, 2.0 * pow(2.0, k % 12)) AS delay FROM ev",
    "identity_plan": "SELECT coalesce(h.doc_id, e.doc_id) AS id, CASE WHEN e.doc_id IS NULL THEN 'keep' WHEN h.doc_id IS NULL THEN 'create' WHEN h.doc_id % 4 <> 0 THEN 'noop' ELSE 'update' END AS op FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1) h FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 1) e ON h.doc_id = e.doc_id",
    "link_remap": LINKS + ", mp AS (SELECT CASE WHEN a % 7 = 0 AND a < 100 THEN a + 1 ELSE a END AS a, CASE WHEN b % 7 = 0 AND b < 100 THEN b + 1 ELSE b END AS b, kind FROM li) SELECT DISTINCT a, b, kind FROM mp WHERE a <> b AND NOT (a % 10 = 3 AND a < 100) AND NOT (b % 10 = 3 AND b < 100)",
    "reciprocal_links": LINKS + " SELECT DISTINCT a, b, kind FROM li x WHERE EXISTS (SELECT 1 FROM li y WHERE y.a = x.b AND y.b = x.a AND y.kind = x.kind)",
    "normalised_links": LINKS + " SELECT a, b, kind, count(*) AS stated FROM li GROUP BY 1, 2, 3",
    "patched_fields": "WITH n AS (SELECT o_custkey AS id, max(o_orderkey) AS mk, max(o_totalprice) AS mp FROM orders GROUP BY 1) SELECT c_custkey AS id, coalesce(CASE WHEN mk % 2 = 0 THEN mk END, c_nationkey) AS nation, CASE WHEN n.id IS NOT NULL THEN CASE WHEN mk % 3 = 0 THEN mp END ELSE round(c_acctbal, 2) END AS balance FROM customer LEFT JOIN n ON n.id = c_custkey",
    "reminder_leases": EV + "SELECT uri AS id, start_us + 3600000000 AS deadline_us, k % 5 AS tries, least(1705000000000000 + 1800000000, start_us + 3600000000) AS until_us FROM ev WHERE start_us + 3600000000 > 1705000000000000 AND k % 5 < 3 AND NOT (k % 3 = 0 AND start_us + 1800000000 > 1705000000000000) ORDER BY 2, 1 LIMIT 40",
    "concept_closure": "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region), c AS (SELECT child, child AS parent FROM (SELECT child FROM e UNION SELECT parent FROM e) UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent) SELECT child, parent FROM c",
    "canonical_props": "SELECT event_id, replace(props, ' ', '') AS props, sha256(replace(props, ' ', '')) AS digest FROM events",
    "dirty_days": EV + "SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM ev WHERE uri % 499 = 0",
}
QUERIES = {n: globals()[n] for n in SQL}
