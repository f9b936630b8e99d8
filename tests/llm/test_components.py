"""Connected components: one task and rounds give the same, and few edges take few jobs."""

import random

import pytest

from cadenza.llm import _spark


def reached(edges):
    low = {x: x for e in edges for x in e}
    while True:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def some_edges():
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000 + i, 999) for i in range(1500)]
    return [*chain, *hub, *[(draw.randrange(3000, 3400), draw.randrange(3000, 3400)) for _ in range(150)], (-5, 7), (9, 9)]


@pytest.mark.parametrize("alone", [1 << 22, 900, -1])
@pytest.mark.parametrize("kind", ["long", "struct<sig:bigint,sig2:bigint>"])
def test_components(spark, monkeypatch, alone, kind):
    monkeypatch.setattr(_spark, "ALONE", alone)
    wide = kind != "long"
    edges = [e if not wide else tuple((-(x % 7), x) for x in e) for e in some_edges()]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(5)
    plain = lambda x: tuple(x) if wide else x
    got = [(plain(n), plain(c)) for n, c in _spark.components(df).collect()]
    assert sorted(got) == sorted(reached([(a, b) for a, b in edges if a != b]).items())


def test_components_of_few_edges_take_few_jobs(spark):
    """Rounds of joins took some fifty jobs, whose stages and plans fill the driver's memory in a run of hundreds of partitions."""
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert _spark.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).count() == 41
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _spark.components(spark.createDataFrame([], "a long, b long")).count() == 0
