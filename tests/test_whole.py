"""Queries do the whole of their tables; results agree with SQL in test_queries.py."""

import unicodedata

from pyspark.sql import functions as F

from cadenza.plans import registry
from cadenza.sources import series as S

QUERIES = registry.queries()


def test_every_order_is_settled(spark, sf):
    orders = S.table(spark, sf, "orders")
    got = QUERIES["settlements"](spark, sf)
    assert got.count() == got.select("id").distinct().count() == orders.count()
    assert QUERIES["settlement_summary"](spark, sf).agg(F.sum("n")).first()[0] == orders.count()
    for name, key in (("overdue_rulings", "id"), ("shipment_omissions", "order"), ("offset_strengths", "id")):
        assert QUERIES[name](spark, sf).where(f"`{key}` % 10 <> 3").count() > 0


def test_every_event_is_upserted(spark, sf):
    events, held = S.table(spark, sf, "events"), S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    written = events.select(F.expr("event_id div 4 * 2").alias("id")).distinct()
    got = QUERIES["vector_upsert"](spark, sf).select("id")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in written.union(held).distinct().collect())


def grams(text):
    t = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if not c.isspace() and unicodedata.category(c)[0] not in "PZ")
    return {t[i : i + 2] for i in range(len(t) - 1)}


def test_every_item_meets_every_document(spark, sf):
    items = {r["item_id"]: grams(r["text"]) for r in S.table(spark, sf, "benchmark").collect()}
    docs = {r["doc_id"]: grams(r["text"]) for r in S.table(spark, sf, "documents").collect()}
    alike = {(i, k): len(a & b) / len(a | b) for i, a in items.items() for k, b in docs.items() if a | b}
    got = {(r["item_id"], r["doc_id"]): r["similarity"] for r in QUERIES["bigram_similarity"](spark, sf).collect()}
    assert len(got) == len(items) * len(docs) and all(abs(got[k] - x) < 1e-6 for k, x in alike.items())
    taken, want = set(), set()
    for i in sorted(items):
        best = sorted((-x, k) for (j, k), x in alike.items() if j == i and x and k not in taken)[:2]
        taken |= {k for _, k in best}
        want |= {(i, k) for _, k in best}
    assert {(r["id"], r["old_id"]) for r in QUERIES["recalled_entries"](spark, sf).collect()} == want


def test_evidence_is_looked_for_in_every_document(spark):
    from cadenza.operators import text

    ctx = spark.createDataFrame([(k, "filler words") for k in range(50)] + [(77, "a bobcat  SAT down here"), (78, "down sat the cat and a dog")], "key int, context string")
    ev = spark.createDataFrame([(1, "cat sat"), (2, "a cat sat down there"), (3, "filler"), (4, "cat cat sat down")], "evidence_id int, evidence string")
    got = {(r["key"], r["evidence_id"]) for r in text.evidence_everywhere(ctx, ev).where("hit").collect()}
    assert got == {(77, 1), (78, 2), *((k, 3) for k in range(50))}


def test_queries_beyond_a_block_are_searched(spark, monkeypatch):
    from cadenza.operators import vectors

    t = spark.range(6).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    q = spark.range(25).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("qvec"))
    rows = lambda limit: sorted(tuple(r[c] for c in ("query_id", "id", "rank", "score")) for r in vectors.search_many(t, q, limit).collect())
    whole = rows(2), rows(None)
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert (rows(2), rows(None)) == whole and [len(x) for x in whole] == [50, 150]


def test_more_than_ten_thousand_queries(spark):
    from cadenza.operators import vectors

    t = spark.createDataFrame([(1, [1.0])], "id int, vec array<float>")
    q = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("qvec"))
    assert vectors.search_many(t, q, 1).count() == 10_001
