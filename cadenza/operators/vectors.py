"""Exact vector search, and the upkeep of a vector table.

A table is (id, vec array<float>, and attributes). Dot products are taken in double over normalised float vectors, JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; null where a vector is empty, has a non-finite element, or no length."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = (norm > 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / norm))


def matches(df: DataFrame, equals: dict | None = None, one_of: dict | None = None) -> DataFrame:
    """Rows whose attributes equal, and are among, the given ones; an array attribute matches if it holds any."""
    kinds = dict(df.dtypes)
    for c, v in (equals or {}).items():
        df = df.where(F.array_contains(c, v) if kinds[c].startswith("array") else F.col(c) == F.lit(v))
    for c, vs in (one_of or {}).items():
        df = df.where(F.arrays_overlap(c, F.array(*[F.lit(v) for v in vs])) if kinds[c].startswith("array") else F.col(c).isin(list(vs)))
    return df


def search(table: DataFrame, query: list[float], limit: int, **filters) -> DataFrame:
    """The top rows by cosine for one query vector: filtered first, ties by id. A partial top-k in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = matches(table, **filters).withColumn("score", F.least(F.greatest(dot(F.col("vec"), normalised(q)), F.lit(-1.0)), F.lit(1.0)))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


#: Queries that are broadcast at once.
BLOCK = 10_000


def search_many(table: DataFrame, queries: DataFrame, limit: int | None, max_queries: int | None = None) -> DataFrame:
    """The top rows for each query (query_id, qvec), or all of them ranked if limit is None. Queries are dealt into blocks of
    half BLOCK on the mean by their query_id; each is broadcast to the whole table, and each task keeps its own top rows of a
    query before the shuffle (window group limit). With max_queries, more are refused."""
    n = queries.count() if max_queries is None else queries.limit(max_queries + 1).count()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries; send them in blocks")
    blocks = 1 if n <= BLOCK else -(-2 * n // BLOCK)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        pairs = table.join(F.broadcast(own), how="cross").withColumn("score", dot(F.col("vec"), F.col("qvec")))
        ranked = pairs.withColumn("rank", F.row_number().over(w))
        top = (ranked if limit is None else ranked.where(F.col("rank") <= limit)).drop("qvec")
        found = top if found is None else found.unionByName(top)
    return found


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (id, ...) with changes (the same and seq): the last write of an id wins."""
    last = changes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))).where("r = 1").drop("r", "seq")
    return table.join(last.select("id"), "id", "left_anti").unionByName(last.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def read(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted ids (position, id) in the order asked; ids that aren't there are passed over."""
    return wanted.join(table, "id").orderBy("position")


def consistency(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Ids (with digest) that are missing, orphaned or stale."""
    both = expected.select("id", F.col("digest").alias("e")).join(indexed.select("id", F.col("digest").alias("i")), "id", "full_outer")
    state = F.when(F.col("i").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(F.col("e") != F.col("i"), "stale")
    return both.select("id", state.alias("state")).where("state is not null")


def aggregate_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, score) of many queries as one row an id: the best score and the queries that found it."""
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("query_id")).alias("queries"))


def hotness(count: Column, age_days: Column, half_life: float) -> Column:
    return (count + 1) / (count + 2) * F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life)


def temperature(hot: Column, cold2: float = 0.08, cold1: float = 0.2, over: float = 0.6) -> Column:
    return F.when(hot < cold2, "cold2").when(hot < cold1, "cold1").when(hot > over, "hot").otherwise("warm")


def adjusted(score: Column, hot: Column, alpha: float) -> Column:
    factor = 1 - alpha * (1 - hot)
    return F.when(score >= 0, score * factor).otherwise(score / factor)


def ranked_with_probe(candidates: DataFrame, limit: int, probe_within: int) -> DataFrame:
    """Candidates (query_id, id, score, temperature, adjusted, may_probe) by adjusted score without the coldest, and of those
    the best one that may be probed, if it is among the first by plain score."""
    plain = candidates.withColumn("plain", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    cold = (F.col("temperature") == "cold2") & F.col("may_probe") & (F.col("plain") <= probe_within)
    probe = plain.where(cold).withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("plain"))).where("p = 1").drop("p").withColumn("probe", F.lit(True))
    warm = plain.where("temperature <> 'cold2'").withColumn("probe", F.lit(False))
    w = Window.partitionBy("query_id").orderBy(F.col("adjusted").desc(), "id")
    return warm.unionByName(probe).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def ndcg(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query, over hits (query_id, id, rank) and relevant (query_id, id): recall, precision and nDCG at k. The ideal list is
    as long as the lesser of what is relevant and what was returned."""
    top = hits.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query_id", "id"], "left")
    by = top.groupBy("query_id").agg(F.count("*").alias("returned"), F.coalesce(F.sum("rel"), F.lit(0)).alias("found"), F.coalesce(F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"))
    need = relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))
    both = need.join(by, "query_id", "left").na.fill(0, ["returned", "found"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("wanted", "returned"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return both.select("query_id", (F.col("found") / F.col("wanted")).alias("recall"), F.when(F.col("returned") > 0, F.col("found") / F.col("returned")).otherwise(0.0).alias("precision"), F.when(F.col("returned") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
