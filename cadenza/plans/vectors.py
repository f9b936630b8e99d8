"""Queries over vectors, conversations, documents and measurements, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import text as X
from cadenza.operators import vectors as V
from cadenza.sources import series as S

P = 6


def _vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _queries(spark, d):
    return _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def _hits(spark, d, k=10):
    return V.search_many(_vectors(spark, d), _queries(spark, d), k)


def vector_search(spark, d):
    return _hits(spark, d).select("query_id", "id", "rank", F.round("score", P).alias("score"))


def vector_search_filtered(spark, d):
    q = _queries(spark, d).where("query_id = 100")
    return V.search_many(V.matches(_vectors(spark, d), equals={"label": 3}, one_of=None), q, 10).select("id", "rank")


def vector_normalise(spark, d):
    n = _vectors(spark, d).select("id", V.normalised(F.transform("vec", lambda x: x * 3)).alias("n"))
    return n.select("id", F.round(V.dot(F.col("n"), F.col("n")), P).alias("norm"), F.round(F.get("n", F.lit(0)), P).alias("first"))


def vector_scan(spark, d):
    return V.matches(_vectors(spark, d), one_of={"label": [1, 4]}).select("id", "label").orderBy("id").limit(20)


def vector_upsert(spark, d):
    """All events' changes into all vectors: four events change an id, and every other id is changed or new."""
    c = S.table(spark, d, "events").select(F.expr("event_id div 4 * 2").alias("id"), (F.col("user_id") % 10).cast("int").alias("label"), F.col("event_id").alias("seq"))
    return V.upsert(_vectors(spark, d).select("id", "label"), c)


def vector_delete(spark, d):
    return V.delete(_vectors(spark, d), _vectors(spark, d).where("label = 2")).select("id", "label")


def vector_read(spark, d):
    wanted = S.table(spark, d, "labels").select((F.col("doc_id") * 3).alias("id"), F.col("doc_id").alias("position"))
    return V.read(_vectors(spark, d), wanted).select("position", "id", "label")


def index_consistency(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "n_chars")
    held = docs.where("id % 7 <> 0").select("id", F.when(F.col("id") % 11 == 0, F.lit("old")).otherwise(F.col("digest")).alias("digest"))
    extra = S.table(spark, d, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.md5("text").alias("digest"))
    return V.consistency(docs, held.unionByName(extra))


def multi_query_hits(spark, d):
    out = V.aggregate_hits(_hits(spark, d).select("query_id", "id", "score"))
    return out.select("id", F.round("score", P).alias("score"), F.array_join(F.col("queries").cast("array<string>"), ",").alias("queries"))


def _heat(spark, d):
    e = S.events(spark, d).groupBy(F.col("lane").alias("id")).agg(F.count("*").alias("uses"), F.max("start_us").alias("last"))
    age = (F.lit(1_707_000_000_000_000) - F.col("last")) / 86_400_000_000.0
    return e.withColumn("hot", V.hotness(F.col("uses") % 6, age, 3.0))


def hotness_levels(spark, d):
    return _heat(spark, d).select("id", F.round("hot", P).alias("hotness"), V.temperature(F.col("hot")).alias("temperature"), F.round(V.adjusted(F.col("hot") - 0.1, F.col("hot"), 0.3), P).alias("adjusted"))


def ranked_with_probe(spark, d):
    heat = _heat(spark, d).select("id", "hot")
    c = _hits(spark, d, 30).join(heat, "id").select("query_id", "id", "score", V.temperature(F.col("hot")).alias("temperature"), V.adjusted(F.col("score"), F.col("hot"), 0.3).alias("adjusted"), (F.col("id") % 2 == 0).alias("may_probe"))
    return V.ranked_with_probe(c, 5, 10).select("query_id", "id", "probe", F.col("rank").cast("long").alias("rank"))


def search_quality(spark, d):
    rel = _vectors(spark, d).select(F.col("id"), "label").join(_queries(spark, d).join(_vectors(spark, d).select(F.col("id").alias("query_id"), "label"), "query_id").select("query_id", "label"), "label").select("query_id", "id")
    q = V.ndcg(_hits(spark, d), rel, 10)
    return q.select("query_id", *[F.round(c, P).alias(c) for c in ("recall", "precision", "ndcg")])


def conversation_turns(spark, d):
    return X.turn_summary(S.table(spark, d, "conversations"))


def safe_boundaries(spark, d):
    return X.safe_boundaries(S.table(spark, d, "conversations")).select("conv_id", "turn")


def token_estimates(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", X.estimated_tokens(F.col("text")).alias("tokens"))


def semantic_boundaries(spark, d):
    """Distance of neighbouring vectors of a label, in id order."""
    w = V.Window.partitionBy("label").orderBy("id")
    v = _vectors(spark, d).withColumn("before", F.lag("vec").over(w)).where("before is not null")
    return v.select("id", F.round(F.least(F.greatest(1 - V.dot(F.col("vec"), F.col("before")), F.lit(0.0)), F.lit(2.0)), P).alias("distance"))


def redacted_documents(spark, d):
    t = S.table(spark, d, "documents").withColumn("safe", X.redact(F.col("text")))
    return t.select("doc_id", F.md5("safe").alias("digest"), F.regexp_count("safe", F.lit(r"\[REDACTED\]")).cast("long").alias("n"))


def redacted_errors(spark, d):
    """Messages of errors, one a page, with the path, share or address that each kind names."""
    at = F.array(*[F.lit(x) for x in ("/var/log/app one.log: denied", "C:\\Users\\a b\\x.txt: gone", "file:///tmp/x y", "smb://host/share/z: busy", "see http://example.org/a", "and/or")])
    n = F.col("page_id") % 6
    t = S.table(spark, d, "pages").select("page_id", F.concat(F.lit("cannot  open "), F.element_at(at, (n + 1).cast("int")), F.lit("\n"), F.lit("  at line 3")).alias("t"))
    return t.select("page_id", X.redact_paths(F.col("t")).alias("safe"))


def clean_lines(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.length(X.clean_line(F.col("text"))).alias("n"))


def _hits_of_items(spark, d):
    doc = S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("context"))
    return X.evidence_everywhere(doc, S.table(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), F.col("text").alias("evidence")))


def evidence_hits(spark, d):
    """Each benchmark item and each document that holds it, of all documents."""
    return _hits_of_items(spark, d)


def evidence_recall(spark, d):
    """The part of all documents that hold each benchmark item."""
    n = S.table(spark, d, "documents").agg(F.count("*").alias("n"))
    by = _hits_of_items(spark, d).groupBy("evidence_id").agg(F.count("*").alias("c"))
    items = S.table(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id")).join(by, "evidence_id", "left")
    return items.join(F.broadcast(n)).select("evidence_id", F.round(F.coalesce("c", F.lit(0)) / F.col("n"), P).alias("recall"))


def bigram_similarity(spark, d):
    """Each benchmark item against each document, by Jaccard similarity of character pairs."""
    both = X.bigram_overlaps(S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), S.table(spark, d, "documents").select(F.col("doc_id").alias("old_id"), "text"))
    return both.select(F.col("id").alias("item_id"), F.col("old_id").alias("doc_id"), F.round(F.col("c") / F.nullif(F.col("n") + F.col("m") - F.col("c"), F.lit(0)), P).alias("similarity"))


def document_chunks(spark, d):
    return X.chunked(S.table(spark, d, "documents").select("doc_id", "text"), 500).select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("n"))


def latency_distribution(spark, d):
    e = S.table(spark, d, "events").groupBy("event_type")
    q = [F.percentile("value", F.lit(f)).alias(n) for n, f in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    out = e.agg(F.count("*").alias("count"), F.avg("value").alias("average"), *q, F.max("value").alias("maximum"))
    return out.select("event_type", "count", *[F.round(c, P).alias(c) for c in ("average", "p50", "p95", "p99", "maximum")])


def boundary_points(spark, d):
    """Median and median absolute deviation of order values by priority."""
    o = S.table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("v"))
    m = o.groupBy("o_orderpriority").agg(F.median("v").alias("median"))
    dev = o.join(m, "o_orderpriority").groupBy("o_orderpriority", "median").agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    return dev.select("o_orderpriority", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


def quality_report(spark, d):
    """Share of right verdicts by language; unlabelled documents aren't counted."""
    doc = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    verdict = (F.col("n_chars") > 800) == (F.col("quality") == 1)
    return doc.groupBy("lang").agg(F.count("*").alias("n"), F.sum(verdict.cast("long")).alias("correct"), F.round(F.avg(verdict.cast("double")), P).alias("accuracy"))


def coverage_audit(spark, d):
    """Every language against every source that is required of it, with what there is."""
    doc = S.table(spark, d, "documents")
    need = doc.select("lang").distinct().crossJoin(F.broadcast(spark.range(25).select(F.concat(F.lit("src"), F.col("id")).alias("source"))))
    have = doc.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return need.join(have, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def histogram_buckets(spark, d):
    """Cumulative bucket counts of values, as a scrape shows them."""
    e = S.table(spark, d, "events").select("event_type", F.explode(F.filter(F.array(*[F.lit(float(b)) for b in (1, 5, 10, 50, 100, 500)]), lambda b: F.col("value") <= b)).alias("le"))
    return e.groupBy("event_type", "le").agg(F.count("*").alias("n"))


def recent_audit(spark, d):
    return S.events(spark, d).orderBy(F.col("start_us").desc(), F.col("uri").desc()).limit(50).select("uri", "start_us")


def capacity_shares(spark, d):
    p = S.table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("used"))
    return p.select("source", "used", F.round(F.col("used") / 200_000, P).alias("share"))


HIT = "WITH q AS (SELECT vec_id AS query_id, embedding AS qvec, label AS ql FROM embeddings WHERE vec_id % 100 = 0), sc AS (SELECT query_id, vec_id AS id, label, ql, list_sum(list_transform(list_zip(embedding, qvec), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM embeddings, q), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"
HEAT = f"WITH {S.SQL.strip()}, ht AS (SELECT lane AS id, (count(*) % 6 + 1) / (count(*) % 6 + 2) * pow(2.0, -greatest((1707000000000000 - max(start_us)) / 86400000000.0, 0) / 3.0) AS hot FROM ev GROUP BY lane)"
TEMP = "CASE WHEN hot < 0.08 THEN 'cold2' WHEN hot < 0.2 THEN 'cold1' WHEN hot > 0.6 THEN 'hot' ELSE 'warm' END"
SECRETS_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[^\s,;]+', 'Bearer [REDACTED]', 'g'), '(?i)\b(api[_-]?key|authorization|password|secret|token)\b\s*[:=]\s*[^\s,;]+', '\1=[REDACTED]', 'g'),
'(?i)\b(access[\s_-]?key(?:[\s_-]?id)?|secret(?:[\s_-]?key)?|token|password|credential)\s*\[[^\]\s]+\]', '\1[REDACTED]', 'g'), '(?i)\b(?:ghp|github_pat|sk|xox[baprs])[-_][A-Za-z0-9._-]+', '[REDACTED]', 'g')"""
EVID = r"""WITH ev AS (SELECT item_id AS evidence_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS e FROM benchmark),
bo AS (SELECT doc_id AS key, evidence_id, e, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS c FROM ev, documents),
tk AS (SELECT *, list_filter(regexp_split_to_array(e, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS et, list_filter(regexp_split_to_array(c, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ct, contains(c, e) AS inside FROM bo),
a AS (SELECT key, evidence_id, t, count(*) AS a FROM (SELECT key, evidence_id, unnest(et) AS t FROM tk) GROUP BY 1, 2, 3), b AS (SELECT key, evidence_id, t, count(*) AS b FROM (SELECT key, evidence_id, unnest(ct) AS t FROM tk) GROUP BY 1, 2, 3),
o AS (SELECT key, evidence_id, sum(least(a, b)) AS s FROM a JOIN b USING (key, evidence_id, t) GROUP BY 1, 2),
h AS (SELECT tk.key, tk.evidence_id, inside OR (len(et) >= 4 AND coalesce(s, 0) >= 0.8 * len(et)) AS hit FROM tk LEFT JOIN o ON o.key = tk.key AND o.evidence_id = tk.evidence_id)
"""
SQL = {
    "vector_search": HIT + f" SELECT query_id, id, rank, round(score, {P}) AS score FROM rk WHERE rank <= 10",
    "vector_search_filtered": HIT + " SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc WHERE query_id = 100 AND label = 3 QUALIFY rank <= 10",
    "vector_normalise": f"SELECT vec_id AS id, 1.0 AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), {P}) AS first FROM embeddings",
    "vector_scan": "SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 4) ORDER BY vec_id LIMIT 20",
    "vector_upsert": "WITH c AS (SELECT event_id // 4 * 2 AS id, CAST(user_id % 10 AS INT) AS label FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id DESC) = 1) SELECT id, label FROM c UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM c)",
    "vector_delete": "SELECT vec_id AS id, label FROM embeddings WHERE label <> 2",
    "vector_read": "SELECT doc_id AS position, vec_id AS id, label FROM labels JOIN embeddings ON vec_id = doc_id * 3",
    "index_consistency": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'stale' END AS state FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 UNION ALL SELECT item_id + 1000000, 'orphan' FROM benchmark",
    "multi_query_hits": HIT + f" SELECT id, round(max(score), {P}) AS score, array_to_string(list_sort(list(query_id)), ',') AS queries FROM rk WHERE rank <= 10 GROUP BY id",
    "hotness_levels": HEAT + f" SELECT id, round(hot, {P}) AS hotness, {TEMP} AS temperature, round(CASE WHEN hot >= 0.1 THEN (hot - 0.1) * (1 - 0.3 * (1 - hot)) ELSE (hot - 0.1) / (1 - 0.3 * (1 - hot)) END, {P}) AS adjusted FROM ht",
    "ranked_with_probe": HEAT + ", " + HIT[5:] + f""", c AS (SELECT query_id, r.id, score, {TEMP} AS temperature, CASE WHEN score >= 0 THEN score * (1 - 0.3 * (1 - hot)) ELSE score / (1 - 0.3 * (1 - hot)) END AS adjusted, r.id % 2 = 0 AS may_probe FROM rk r JOIN ht ON ht.id = r.id WHERE rank <= 30),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS plain FROM c),
u AS (SELECT *, false AS probe FROM p WHERE temperature <> 'cold2' UNION ALL (SELECT *, true FROM p WHERE temperature = 'cold2' AND may_probe AND plain <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY plain) = 1))
SELECT query_id, id, probe, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, id) AS rank FROM u QUALIFY rank <= 5""",
    "search_quality": HIT + f""", rel AS (SELECT query_id, count(*) AS wanted FROM sc WHERE label = ql GROUP BY query_id),
t AS (SELECT query_id, count(*) AS returned, sum((label = ql)::INT) AS found, sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM rk WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(found / wanted, {P}) AS recall, round(found / returned, {P}) AS precision, round(dcg / list_sum(list_transform(range(1, least(wanted, returned) + 1), lambda r: 1 / log2(r + 1))), {P}) AS ndcg FROM t JOIN rel USING (query_id)""",
    "conversation_turns": """WITH s AS (SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> 'user' THEN 1 ELSE 0 END AS st FROM conversations),
t AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM s) SELECT conv_id, turn_no, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) = 'assistant' AS complete FROM t GROUP BY conv_id, turn_no""",
    "safe_boundaries": "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE role = 'assistant' AND (after IS NULL OR after = 'user')",
    "semantic_boundaries": f"SELECT id, round(least(greatest(1 - list_sum(list_transform(list_zip(vec, before), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 0), 2), {P}) AS distance FROM (SELECT vec_id AS id, embedding AS vec, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) WHERE before IS NOT NULL",
    "redacted_documents": f"WITH r AS (SELECT doc_id, {SECRETS_SQL} AS safe FROM documents) SELECT doc_id, md5(safe) AS digest, CAST((length(safe) - length(replace(safe, '[REDACTED]', ''))) // 10 AS BIGINT) AS n FROM r",
    "clean_lines": r"SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(text, '[\p{C}\p{Z}]', ' ', 'g'), '\s+', ' ', 'g'))) AS INT) AS n FROM documents",
    "evidence_hits": EVID + "SELECT key, evidence_id, hit FROM h WHERE hit",
    "evidence_recall": EVID + f"SELECT evidence_id, round(avg(hit::INT::DOUBLE), {P}) AS recall FROM h GROUP BY 1",
    "latency_distribution": f"SELECT event_type, count(*) AS count, round(avg(value), {P}) AS average, round(quantile_cont(value, 0.5), {P}) AS p50, round(quantile_cont(value, 0.95), {P}) AS p95, round(quantile_cont(value, 0.99), {P}) AS p99, round(max(value), {P}) AS maximum FROM events GROUP BY 1",
    "boundary_points": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(mad(o_totalprice), 4) AS mad FROM orders GROUP BY 1",
    "quality_report": f"SELECT lang, count(*) AS n, CAST(sum(((n_chars > 800) = (quality = 1))::INT) AS BIGINT) AS correct, round(avg(((n_chars > 800) = (quality = 1))::INT::DOUBLE), {P}) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "coverage_audit": "SELECT l.lang, s.source, count(d.doc_id) AS n, count(d.doc_id) = 0 AS missing FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT 'src' || unnest(range(25)) AS source) s LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source GROUP BY 1, 2",
    "histogram_buckets": "SELECT event_type, le, count(*) AS n FROM events JOIN (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0])::DOUBLE AS le) ON value <= le GROUP BY 1, 2",
    "recent_audit": f"WITH {S.SQL.strip()} SELECT uri, start_us FROM ev ORDER BY start_us DESC, uri DESC LIMIT 50",
    "capacity_shares": f"SELECT source, CAST(sum(length(text)) AS BIGINT) AS used, round(sum(length(text)) / 200000, {P}) AS share FROM documents GROUP BY 1",
}
SQL["redacted_errors"] = """SELECT page_id, (['cannot open [PATH]: denied at line 3', 'cannot open [PATH]: gone at line 3', 'cannot open [PATH] at line 3', 'cannot open [PATH]: busy at line 3', 'cannot open see http://example.org/a at line 3', 'cannot open and/or at line 3'])[page_id % 6 + 1] AS safe FROM pages"""
WIDE = f"length(regexp_replace(text, '{X.NOT_WIDE}', '', 'g'))"
SQL["token_estimates"] = f"SELECT conv_id, turn, CAST(ceil({WIDE} * 1.5 + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) * 2 + (length(text) - {WIDE} - length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) * 0.25) AS BIGINT) AS tokens FROM conversations"
PLAIN = r"replace(regexp_replace(lower(text), '[\p{P}\p{Z}\s]', '', 'g'), 'ß', 'ss')"
GRAMS = "CASE WHEN length(t) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END"
SQL["bigram_similarity"] = f"""WITH a AS (SELECT item_id, {GRAMS} AS a FROM (SELECT item_id, {PLAIN} AS t FROM benchmark)), b AS (SELECT doc_id, {GRAMS} AS b FROM (SELECT doc_id, {PLAIN} AS t FROM documents)),
c AS (SELECT item_id, doc_id, len(a) AS n, len(b) AS m, len(list_intersect(a, b)) AS c FROM a, b) SELECT item_id, doc_id, round(c / nullif(n + m - c, 0), {P}) AS similarity FROM c"""


def _cut(rest: str, size: int) -> str:
    """SQL for where to cut a text that is over size: after the last of the first mark there is, but not at the start."""
    tries = []
    for mark, width in (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("' '", 1)):
        at = f"strpos(reverse(left({rest}, {size - width + 1})), reverse({mark}))"
        tries.append(f"WHEN {at} > 0 AND {size - width + 1} - {at} + 1 > {width} THEN {size - width + 1} - {at} + 1")
    return f"CASE WHEN length({rest}) <= {size} THEN length({rest}) {' '.join(tries)} ELSE {size} END"


SQL["document_chunks"] = f"""WITH RECURSIVE c AS (SELECT doc_id, 0::BIGINT AS chunk_no, coalesce(text, '') AS rest, {_cut("coalesce(text, '')", 500)} AS n FROM documents
UNION ALL SELECT doc_id, chunk_no + 1, substr(rest, n + 1), {_cut('substr(rest, n + 1)', 500)} FROM c WHERE length(rest) > 500)
SELECT doc_id, chunk_no, CAST(n AS BIGINT) AS n FROM c"""
QUERIES = {n: globals()[n] for n in SQL}
