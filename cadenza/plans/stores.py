"""Queries that write stores and read them back, and queries in SQL with the library's functions; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import sql as Q
from cadenza.functions import statistics as N
from cadenza.operators import relations as R
from cadenza.plans.relations import _strata
from cadenza.sources import folders
from cadenza.sources import series as S
from cadenza.sources import tables as T

P = 9


def cached_days(spark, d):
    """A cache of days, of which the days from the 10th on are written again with what came later; read up to the 25th."""
    at, e = folders.shared(spark, "days"), S.events(spark, d).select("uri", "lane", "day")
    T.write_days(e.where("lane % 3 > 0 or day < date'2024-01-10'"), at)
    T.write_days(e.where("day >= date'2024-01-10'"), at)
    held = T.read_days(spark, at, e.schema, "2024-01-25")
    return held.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("uri").alias("uris"))


def listed_day(spark, d):
    """One day's records of one partition, and no other read."""
    at, e = folders.shared(spark, "days"), S.records(spark, d).select("uri", "lane", "kind", "day")
    T.write_days(e, at)
    return T.read_days(spark, at, e.schema).where("day = date'2024-01-12'").select("uri", "lane", "kind")


def vector_generations(spark, d):
    """A table of vectors' labels after three generations: all, changes, and deletions."""
    store = T.Generations(spark, folders.shared(spark, "vectors"))
    v = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    none = v.limit(0)
    store.replace_all(v, 1, 0)
    store.apply(v.where("id % 3 = 0").withColumn("label", F.col("label") + 100), none, 2, 1)
    store.apply(none, v.where("id % 5 = 1"), 3, 2)
    return store.read()


def fact_log(spark, d):
    """The last entry of each lane in a log that was appended to twice."""
    at, e = folders.shared(spark, "log"), S.events(spark, d).select("lane", "start_us", "uri", "kind")
    T.append_log(e.where("lane % 2 = 0"), at)
    T.append_log(e.where("lane % 2 = 1 or start_us < 1704844800000000"), at)
    return T.latest(spark.read.schema(e.schema).parquet(at), ["lane"], ["start_us", "uri"]).select("lane", "uri", "kind")


def calendar_days(spark, d):
    """Types of the days of orders by calendars read from JSON lines, of which one doesn't parse and one holds a day twice."""
    at = folders.shared(spark, "calendars")
    lines = [
        '{"region": "x", "year": 1995, "days": [{"date": "1995-05-01", "kind": "holiday", "name": "May Day"}, {"date": "1995-05-06", "kind": "workday", "name": ""}]}',
        '{"region": "x", "year": 1996, "days": [{"date": "1996-01-01", "kind": "holiday", "name": "New Year"}]}', '{"region": "x", "year": 1997, "days": [', '{"region": "y", "year": 1995, "days": []}',
        '{"region": "x", "year": 1998, "days": [{"date": "1998-01-01", "kind": "holiday", "name": "a"}, {"date": "1998-01-01", "kind": "workday", "name": "b"}]}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at)
    good, _ = T.holidays(spark, at)
    days = S.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return T.day_types(days, good, "x").withColumn("day", F.col("day").cast("string"))


def sql_functions(spark, d):
    """The functions in a SQL text over a view of the records."""
    Q.register(spark)
    S.records(spark, d).createOrReplaceTempView("cadenza_records")
    return spark.sql(f"""SELECT uri, class_key(lane, kind) AS class, slot_of(start_us, 30) AS slot, CAST(day_of(start_us) AS STRING) AS day, round(evidence_decay(k, 8), {P}) AS weight,
    round(shrink_rate(k, 100, 0.5, 4), {P}) AS rate, round(hotness(k, k / 10, 3), {P}) AS hot, round(ring_offset(k * 15, 700, 1440), {P}) AS off FROM cadenza_records""")


def relation_power(spark, d):
    """How many antecedents a forward test of each relation needs, by its control rate and its effect so far."""
    e = R.effects(_strata(spark, d)).select("lane", "antecedent", "consequent", "control_rate", "difference")

    def run(batches):
        for t in batches:
            need = [N.required_antecedents(c, abs(x), x > 0, 0.05, 0.8, 2, 60) for c, x in zip(t["control_rate"], t["difference"], strict=True)]
            yield t.assign(needed=need)[["lane", "antecedent", "consequent", "needed"]]

    return e.mapInPandas(run, "lane long, antecedent string, consequent string, needed int")


W = f"WITH {S.SQL.strip()}"
SQL = {
    "cached_days": W + " SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(uri) AS BIGINT) AS uris FROM ev WHERE day < DATE '2024-01-25' GROUP BY day",
    "listed_day": W + " SELECT uri, lane, kind FROM rec WHERE day = DATE '2024-01-12'",
    "vector_generations": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 1",
    "fact_log": W + " SELECT lane, uri, kind FROM ev QUALIFY row_number() OVER (PARTITION BY lane ORDER BY start_us DESC, uri DESC) = 1",
    "calendar_days": """SELECT DISTINCT CAST(d AS VARCHAR) AS day, CASE WHEN d = DATE '1995-05-01' OR d = DATE '1996-01-01' THEN 'holiday' WHEN d = DATE '1995-05-06' THEN 'workday' WHEN year(d) IN (1995, 1996) THEN CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'workday' END END AS day_type,
CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'workday' END AS nominal FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "sql_functions": W + f""" SELECT uri, lane || '/' || kind AS class, CAST((start_us % 86400000000) // 1800000000 AS INT) AS slot, CAST(day AS VARCHAR) AS day, round(pow(0.5, k / 8.0::DOUBLE), {P}) AS weight, round((k + 2) / 104, {P}) AS rate,
round((k + 1) / (k + 2) * pow(2.0, -k / 10 / 3), {P}) AS hot, round(CASE WHEN ((k * 15 - 700) % 1440 + 1440) % 1440 > 720 THEN ((k * 15 - 700) % 1440 + 1440) % 1440 - 1440 ELSE ((k * 15 - 700) % 1440 + 1440) % 1440 END, {P})::DOUBLE AS off FROM rec""",
}
QUERIES = {n: globals()[n] for n in SQL} | {"relation_power": relation_power}
