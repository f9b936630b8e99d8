"""Queries of documents, vocabularies and the remaining readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import documents as D
from cadenza.operators import relations as R
from cadenza.operators import temporal as T
from cadenza.operators import vectors as V
from cadenza.plans.relations import STRATA, _strata
from cadenza.plans.temporal import DAYS_SQL, _days
from cadenza.plans.vectors import HIT, _hits, _queries, _vectors
from cadenza.sources import series as S


def parsed_addresses(spark, d):
    u = S.table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("memory:/"), "lang", "source", "doc_id").alias("uri"))
    scheme, parts, name = D.address(F.col("uri"))
    return u.select("doc_id", scheme.alias("scheme"), F.array_join(parts, ">").alias("parts"), name.alias("name"), D.below(F.col("uri"), "memory://en/src1").alias("below"))


def document_codec(spark, d):
    """Encoded and decoded again: body and fields as they were."""
    c = S.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    body, fields = D.decoded(D.encoded(F.col("text"), F.struct("lang", "n_chars")), "lang string, n_chars long")
    return c.select("doc_id", F.md5(body).alias("body"), fields.alias("f")).select("doc_id", "body", F.col("f.lang").alias("lang"), F.col("f.n_chars").alias("n_chars"))


def adapted_messages(spark, d):
    c = S.table(spark, d, "conversations")
    line = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("message").alias("type"), F.struct("role", "text").alias("payload")))
    return D.adapted(c.select("conv_id", F.col("turn").alias("seq"), line.alias("line"))).select("conv_id", "seq", "role", F.md5("text").alias("digest"))


def adapted_chat_messages(spark, d):
    """Conversations as calls of chat completions: every third line of an assistant calls a tool, and every user's line that ends
    a multiple of five characters is a tool's answer to the line before it."""
    c, even = S.table(spark, d, "conversations"), F.length("text") % 5 == 0
    role = F.when((F.col("role") == "user") & even, "tool").otherwise(F.col("role"))
    call = F.array(F.struct(F.col("turn").cast("string").alias("id"), F.struct(F.lit("look").alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    answer = F.when(role == "tool", (F.col("turn") - 1).cast("string"))
    line = F.to_json(F.struct(role.alias("role"), F.col("text").alias("content"), answer.alias("tool_call_id"), F.when((role == "assistant") & (F.col("turn") % 3 == 0), call).alias("tool_calls")))
    return D.adapted_chat(c.select("conv_id", F.col("turn").alias("seq"), line.alias("line"))).select("conv_id", "seq", "role", F.md5("text").alias("digest"), "call_id")


def adapted_block_messages(spark, d):
    """Conversations as content blocks: a text, an image that is passed over, and of an assistant a call of a tool."""
    c = S.table(spark, d, "conversations")
    kind = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"
    none = F.lit(None).cast("string")
    block = lambda t, **has: F.struct(F.lit(t).alias("type"), *[has.get(n, none).alias(n) for n in ("text", "id", "name", "input", "tool_use_id", "content")])
    blocks = F.array(block("text", text=F.col("text")), block("image"), block("tool_use", id=F.col("turn").cast("string"), name=F.lit("look"), input=F.lit("{}")), block("tool_result", tool_use_id=(F.col("turn") - 1).cast("string"), content=F.lit("found")))
    line = F.to_json(F.struct("role", blocks.cast(kind).alias("content")))
    return D.adapted_blocks(c.select("conv_id", F.col("turn").alias("seq"), line.alias("line"))).select("conv_id", "seq", "role", F.md5("text").alias("digest"), "call_id")


def appended_fields(spark, d):
    e = S.events(spark, d).groupBy("lane").agg(F.array_sort(F.collect_set(F.when(F.col("k") < 30, F.col("kind")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("k") > 60, F.col("kind")))).alias("b"))
    return e.select("lane", F.array_join(D.appended(F.col("a"), F.col("b")), ",").alias("kinds"))


def replayed_vocabulary(spark, d):
    log = S.events(spark, d).select((F.col("uri") + 1).alias("version"), (F.col("lane") % 40).alias("class_id"), F.when(F.col("k") % 6 == 0, "retire").when(F.col("k") % 2 == 0, "revise").otherwise("add").alias("op"), F.concat("kind", F.col("k").cast("string")).alias("name"))
    return D.replayed(log)


def restamped_records(spark, d):
    r = S.records(spark, d).select("uri", "kind")
    moves = S.records(spark, d).where("k % 3 = 0").select("uri", F.when(F.col("k") % 2 == 0, F.col("kind")).otherwise("old").alias("was"), F.lit("new").alias("becomes"))
    return D.restamped(r, moves)


def compactable_facts(spark, d):
    f = S.records(spark, d).select("kind", F.col("start_us").alias("at_us"), "uri")
    return D.compactable(f, ["kind"], 35).groupBy("kind").agg(F.count("*").alias("n"), F.max("at_us").alias("through_us"))


def condition_codec(spark, d):
    e = S.events(spark, d).select("uri", F.concat(F.lit("timeline:"), "kind", F.lit("+field:place="), F.col("k").cast("string")).alias("text"))
    p = e.select("uri", F.explode(D.condition_parts(F.col("text"))).alias("c"))
    return p.select("uri", "c.template", "c.field", "c.value")


def ready_relations(spark, d):
    """Relations whose strata could give a p of 0.2 or less."""
    return R.effects(_strata(spark, d)).where("minimum_p <= 0.2 - 1e-9").select("lane", "antecedent", "consequent", "n")


def blind_bounds(spark, d):
    """The difference with the unknown outcomes as none and as all."""
    s = _strata(spark, d)
    out = None
    for name, fill in (("low", 0), ("high", 1)):
        e = R.effects(s.na.fill(fill, ["treated"])).select("lane", "antecedent", "consequent", F.round(F.col("difference") + 1e-11, 9).alias(name))
        out = e if out is None else out.join(e, ["lane", "antecedent", "consequent"])
    return out


def last_blocks(spark, d):
    """Effects over each relation's last two blocks with strata."""
    b = R.blocks(_strata(spark, d))
    w = T.Window.partitionBy("lane", "antecedent", "consequent").orderBy(F.col("block").desc())
    last = b.withColumn("r", F.dense_rank().over(w)).where("r <= 2")
    return last.groupBy("lane", "antecedent", "consequent").agg(F.count("*").alias("n"), F.sum("treated").alias("treated"), F.sum("positives").alias("positives"))


def rooted_search(spark, d):
    """The best of some labels for each query, and of their neighbours' labels, as one list."""
    roots = V.search_many(V.matches(_vectors(spark, d), one_of={"label": [0, 1]}), _queries(spark, d), 5)
    kids = V.search_many(V.matches(_vectors(spark, d), equals={"label": 2}), _queries(spark, d), 5)
    both = roots.unionByName(kids).withColumn("rank", F.row_number().over(V.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    return both.where("rank <= 5").select("query_id", "id", "rank")


def summary_search(spark, d):
    """Over-fetched hits over a threshold, the first three."""
    h = _hits(spark, d, 12).where("score >= 0.15").withColumn("rank", F.row_number().over(V.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    return h.where("rank <= 3").select("query_id", "id", "rank")


def merged_gaps(spark, d):
    """Gaps of one lane and start as one, to the latest end."""
    g = S.gaps(spark, d).withColumn("hour", F.floor(F.col("begin_us") / 3_600_000_000))
    return g.groupBy("lane", "hour").agg(F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


def backlog_admission(spark, d):
    """What a retry backlog does with each record: too late, there already, or admitted, up to three a lane."""
    e = S.events(spark, d).withColumn("late", F.col("day") <= F.lit("2024-01-03").cast("date"))
    w = T.Window.partitionBy("lane", "late").orderBy("start_us", "uri")
    seen = F.row_number().over(T.Window.partitionBy("lane", "kind", "day").orderBy("start_us", "uri")) > 1
    return e.withColumn("present", seen).withColumn("n", F.sum((~F.col("present")).cast("int")).over(w.rowsBetween(T.Window.unboundedPreceding, 0))).select("uri", F.when(F.col("late"), "late").when(F.col("present"), "present").when(F.col("n") > 3, "full").otherwise("admitted").alias("admission"))


def silent_days(spark, d):
    """Days of a lane's span without any row."""
    e = S.events(spark, d)
    span = e.groupBy("lane").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("lane", F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(e.select("lane", "day").distinct(), ["lane", "day"], "left_anti").withColumn("day", F.col("day").cast("string"))


def account_fact_kinds(spark, d):
    """What each order's account records: the first rule that holds."""
    o = S.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "settled").when(k % 7 == 0, "voided").when(k % 5 == 0, "said_done").when(k % 3 == 0, "prompted").otherwise("open").alias("fact"), F.when(k % 7 == 0, 0.0).when(k % 5 == 0, 1.0).otherwise(F.round((k % 10) / 10, 1)).alias("strength"))


def edge_signatures(spark, d):
    """Kinds at work on a lane's day, without those that come on most of its days."""
    days = _days(spark, d)
    n = days.groupBy("lane").agg(F.count_distinct("day").alias("all"))
    common = days.groupBy("lane", "kind").agg(F.count_distinct("day").alias("n")).join(n, "lane").where("2 * n > all").select("lane", "kind")
    kept = days.join(common, ["lane", "kind"], "left_anti").groupBy("lane", "day").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("signature"))
    return kept.withColumn("day", F.col("day").cast("string"))


def same_signature_readings(spark, d):
    """For each lane's day: how often its set of kinds came before, and how often one of the same size."""
    days = _days(spark, d).groupBy("lane", "day").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("s"), F.count("*").alias("size"))
    before = lambda by: F.count("*").over(T.Window.partitionBy("lane", by).orderBy("day").rowsBetween(T.Window.unboundedPreceding, -1))
    return days.select("lane", F.col("day").cast("string").alias("day"), before("s").alias("same_set"), before("size").alias("same_size"))


EV = f"WITH {S.SQL.strip()}"
EP = f"{EV}, {DAYS_SQL.strip()}"
W = f"{EP}, {STRATA.strip()}"
SQL = {
    "parsed_addresses": "SELECT doc_id, 'memory' AS scheme, lang || '>' || source AS parts, CAST(doc_id AS VARCHAR) AS name, lang = 'en' AND source = 'src1' AS below FROM documents",
    "document_codec": "SELECT doc_id, md5(text) AS body, lang, n_chars FROM documents",
    "adapted_messages": "SELECT conv_id, turn AS seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'completion' END AS role, md5(text) AS digest FROM conversations WHERE role IN ('user', 'assistant')",
    "adapted_chat_messages": """WITH c AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' AND length(text) % 5 = 0 THEN 'tool' ELSE role END AS role FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT DISTINCT conv_id, turn FROM c WHERE role = 'assistant' AND turn % 3 = 0)
SELECT conv_id, turn * 1000 AS seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'completion' END AS role, md5(text) AS digest, NULL::VARCHAR AS call_id FROM c WHERE role <> 'tool' AND text <> ''
UNION ALL SELECT conv_id, turn * 1000 + 1, 'call', md5('look {}'), CAST(turn AS VARCHAR) FROM k
UNION ALL SELECT c.conv_id, c.turn * 1000, 'result', md5(text), CAST(c.turn - 1 AS VARCHAR) FROM c JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn - 1 WHERE role = 'tool'""",
    "adapted_block_messages": """WITH c AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn * 1000 AS seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'completion' END AS role, md5(text) AS digest, NULL::VARCHAR AS call_id FROM c WHERE text <> ''
UNION ALL SELECT conv_id, turn * 1000 + CASE WHEN role = 'assistant' THEN 1 END, 'call', md5('look {}'), CAST(turn AS VARCHAR) FROM c WHERE role = 'assistant'
UNION ALL SELECT c.conv_id, c.turn * 1000 + 1, 'result', md5('found'), CAST(c.turn - 1 AS VARCHAR) FROM c JOIN c k ON k.conv_id = c.conv_id AND k.turn = c.turn - 1 AND k.role = 'assistant' WHERE c.role = 'user'""",
    "appended_fields": EV + ", x AS (SELECT lane, kind, min(CASE WHEN k < 30 THEN 0 ELSE 1 END) AS o FROM ev WHERE k < 30 OR k > 60 GROUP BY 1, 2) SELECT l.lane, coalesce((SELECT string_agg(kind, ',' ORDER BY o, kind) FROM x WHERE x.lane = l.lane), '') AS kinds FROM (SELECT DISTINCT lane FROM ev) l",
    "replayed_vocabulary": EV + " SELECT class_id, name, version FROM (SELECT lane % 40 AS class_id, kind || k AS name, uri + 1 AS version, k FROM ev QUALIFY row_number() OVER (PARTITION BY lane % 40 ORDER BY uri DESC) = 1) WHERE k % 6 <> 0",
    "restamped_records": EV + " SELECT uri, CASE WHEN k % 6 = 0 THEN 'new' ELSE kind END AS kind, k % 6 = 0 AS moved FROM rec",
    "compactable_facts": EV + ", r AS (SELECT kind, start_us, row_number() OVER (PARTITION BY kind ORDER BY start_us DESC, uri DESC) AS r FROM rec) SELECT kind, count(*) AS n, max(start_us) AS through_us FROM r WHERE r > 35 GROUP BY 1",
    "condition_codec": EV + " SELECT uri, 'timeline' AS template, NULL AS field, kind AS value FROM ev UNION ALL SELECT uri, 'field', 'place', CAST(k AS VARCHAR) FROM ev",
    "ready_relations": W + ", m AS (SELECT lane, antecedent, consequent, count(*) AS n, CASE WHEN count(CASE WHEN p > 0 AND p < 1 THEN 1 END) = 0 THEN 1 ELSE least(1, 2 * least(product(p) FILTER (WHERE p > 0 AND p < 1), product(1 - p) FILTER (WHERE p > 0 AND p < 1))) END AS mp FROM bl GROUP BY 1, 2, 3) SELECT lane, antecedent, consequent, n FROM m WHERE mp <= 0.2 - 1e-9",
    "blind_bounds": W + ", c AS (SELECT * FROM sx WHERE controls > 0) SELECT lane, antecedent, consequent, round(avg(coalesce(treated, 0)) - avg(positives / controls) + 1e-11, 9) AS low, round(avg(coalesce(treated, 1)) - avg(positives / controls) + 1e-11, 9) AS high FROM c GROUP BY 1, 2, 3",
    "last_blocks": W + ", r AS (SELECT *, dense_rank() OVER (PARTITION BY lane, antecedent, consequent ORDER BY block DESC) AS r FROM bl) SELECT lane, antecedent, consequent, count(*) AS n, CAST(sum(treated) AS BIGINT) AS treated, CAST(sum(positives) AS BIGINT) AS positives FROM r WHERE r <= 2 GROUP BY 1, 2, 3",
    "rooted_search": HIT + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE label IN (0, 1, 2) QUALIFY rank <= 5",
    "summary_search": HIT + " SELECT query_id, id, rank FROM rk WHERE score >= 0.15 AND rank <= 3",
    "merged_gaps": EV + " SELECT lane, begin_us // 3600000000 AS hour, min(begin_us) AS begin_us, max(end_us) AS end_us, count(*) AS n FROM gap GROUP BY 1, 2",
    "backlog_admission": EV + ", p AS (SELECT *, day <= DATE '2024-01-03' AS late, row_number() OVER (PARTITION BY lane, kind, day ORDER BY start_us, uri) > 1 AS present FROM ev), n AS (SELECT *, sum((NOT present)::INT) OVER (PARTITION BY lane, late ORDER BY start_us, uri) AS n FROM p) SELECT uri, CASE WHEN late THEN 'late' WHEN present THEN 'present' WHEN n > 3 THEN 'full' ELSE 'admitted' END AS admission FROM n",
    "silent_days": EV + ", s AS (SELECT lane, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ev GROUP BY lane) SELECT lane, CAST(day AS VARCHAR) AS day FROM s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.lane = s.lane AND ev.day = s.day)",
    "account_fact_kinds": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'settled' WHEN o_orderkey % 7 = 0 THEN 'voided' WHEN o_orderkey % 5 = 0 THEN 'said_done' WHEN o_orderkey % 3 = 0 THEN 'prompted' ELSE 'open' END AS fact, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE round((o_orderkey % 10) / 10, 1) END::DOUBLE AS strength FROM orders",
    "edge_signatures": EP + ", n AS (SELECT lane, count(DISTINCT day) AS a FROM days GROUP BY 1), c AS (SELECT d.lane, d.kind FROM days d JOIN n ON n.lane = d.lane GROUP BY 1, 2, a HAVING 2 * count(DISTINCT day) > a) SELECT lane, CAST(day AS VARCHAR) AS day, string_agg(DISTINCT kind, '+' ORDER BY kind) AS signature FROM days WHERE (lane, kind) NOT IN (SELECT (lane, kind) FROM c) GROUP BY lane, day",
    "same_signature_readings": EP + ", s AS (SELECT lane, day, string_agg(DISTINCT kind, '+' ORDER BY kind) AS s, count(*) AS size FROM days GROUP BY 1, 2) SELECT lane, CAST(day AS VARCHAR) AS day, count(*) OVER (PARTITION BY lane, s ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_set, count(*) OVER (PARTITION BY lane, size ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_size FROM s",
}
QUERIES = {n: globals()[n] for n in SQL}
