"""Queries on tables of more rows, larger keys and longer histories than those of the smallest size."""

import math
import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from cadenza.functions import statistics as S
from cadenza.operators import relations, state
from cadenza.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def folder(tmp_path):
    """A folder with one table, made by SQL."""

    def make(name, sql):
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path / name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def same(spark, d, name):
    assert oracle.differences(spark, oracle.connect(d), d, QUERIES[name], SQL[name]) is None


def test_class_tokens_of_five_digits_and_more(spark, folder):
    same(spark, folder("part", "SELECT unnest([1, 5, 999, 1000, 9999, 10000, 10001, 99999, 123456, 1200000, 1200001]) AS p_partkey"), "class_tokens")
    tokens = ["s-k0007", "s-k12345", "s-k012345", "s-k7", "s-k99999999999999999999", "s-k0000", "x", "", None]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select(state.class_id(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [7, 12345, None, None, None, 0, None, None, None]


EVENTS = """SELECT i AS event_id, CAST(TIMESTAMP '2024-01-01' + to_microseconds(CAST({at} AS BIGINT)) AS TIMESTAMP) AS ts, CAST({lane} AS BIGINT) AS user_id,
['view', 'click', 'purchase', 'signup'][1 + i % 4] AS event_type, CAST(i % 50 AS DOUBLE) AS value, '{{"k": ' || {k} || '}}' AS props FROM range({n}) t(i)"""


def test_dirty_days_of_many_rows(spark, folder):
    same(spark, folder("events", EVENTS.format(at="i * 11000000", lane="i % 20", k="i % 100", n=12000)), "dirty_days")


def test_steps_of_discoveries_are_compared_as_in_sql():
    """0.7 / 7 is less than 0.1 by a bit, while 0.1 * 7 / 7 isn't more than 0.1."""
    assert not duckdb.sql("SELECT 0.1::DOUBLE <= 0.1 * 7 / 7").fetchall()[0][0] and 0.1 * 7 / 7 <= 0.1
    assert S.tarone_bh(dict.fromkeys("abcdefg", 0.1), dict.fromkeys("abcdefg", 1e-6), {}, 0.1) == (set("abcdefg"), set())


def test_p_values_of_long_histories_are_exact(spark):
    """Over 400 undecided strata, where a normal approximation was taken."""
    rows = [(1, "a", "b", i, i % 30, int(i % 11 < 4), 4, i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "lane long, antecedent string, consequent string, a_us long, d int, treated int, controls long, positives long")
    got = relations.p_values(df.selectExpr("*", "date_add(date'2024-01-01', d) AS day").drop("d")).first()
    mass, chances = [1.0], [(r[5] + r[7]) / 5 for r in rows]
    for c in (c for c in chances if 0 < c < 1):
        mass = [(mass[i] if i < len(mass) else 0) * (1 - c) + (mass[i - 1] * c if i else 0) for i in range(len(mass) + 1)]
    hit = sum(r[5] for r in rows) - sum(c >= 1 for c in chances)
    assert len(mass) > 401 and got["upper"] == pytest.approx(sum(mass[hit:]), rel=1e-9) and got["lower"] == pytest.approx(sum(mass[: hit + 1]), rel=1e-9)


def test_draws_are_those_of_the_generator():
    for below in (1, 2, 3, 5, 8, 31):
        own = random.Random(below + 7)
        assert S.draws(below + 7, below, 900).tolist() == [own.randrange(below) for _ in range(900)]


def test_relation_tests_are_spread_over_tasks(spark, sf):
    """A few megabytes of strata were one task's, whatever they cost."""
    out = QUERIES["relation_tests"](spark, sf)
    assert out.select("lane", F.spark_partition_id().alias("i")).groupBy("i").count().count() > 4
