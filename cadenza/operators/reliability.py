"""Reliability of predictions: decayed evidence, settlement of expectations as as-of joins, and what follows from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.evidence import beta_quantile, beta_quantile_udf, decay, miss_run_udf

ACCOUNT = ["lane", "kind"]


def ranked(evidence: DataFrame, by: list[str] = ACCOUNT) -> DataFrame:
    """evidence (by, at_us, uri, came, strength) with rank (0 first) and its weight under a half-life of 8 opportunities."""
    w = Window.partitionBy(*by)
    return evidence.withColumn("rank", F.row_number().over(w.orderBy("at_us", "uri")) - 1).withColumn("last_rank", F.max("rank").over(w))


def tally(evidence: DataFrame, half_life: float = 8.0, by: list[str] = ACCOUNT) -> DataFrame:
    """Decayed good (k) and all (n) evidence. Sums of weights, so parts kept as (k, n, count) can be carried on by decay."""
    w = ranked(evidence, by).withColumn("weight", F.col("strength") * decay(F.col("last_rank") - F.col("rank"), half_life))
    return w.groupBy(*by).agg(F.sum(F.when(F.col("came"), F.col("weight")).otherwise(0.0)).alias("k"), F.sum("weight").alias("n"), F.count("*").alias("opportunities"))


def carried_on(earlier: DataFrame, later: DataFrame, half_life: float = 8.0, by: list[str] = ACCOUNT) -> DataFrame:
    """The tally of both parts from theirs: the earlier one decays by the later one's opportunities."""
    a, b = earlier.select(*by, *[F.col(c).alias(f"a_{c}") for c in ("k", "n", "opportunities")]), later
    both = a.join(b, by, "full_outer").na.fill(0, ["a_k", "a_n", "a_opportunities", "k", "n", "opportunities"])
    left = decay(F.col("opportunities"), half_life)
    return both.select(*by, (F.col("a_k") * left + F.col("k")).alias("k"), (F.col("a_n") * left + F.col("n")).alias("n"), (F.col("a_opportunities") + F.col("opportunities")).alias("opportunities"))


def reading(tallies: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean and one-sided bounds of the Jeffreys posterior of each tally."""
    a, b = F.least("k", "n") + 0.5, F.greatest(F.col("n") - F.col("k"), F.lit(0.0)) + 0.5
    return tallies.withColumns({"mean": a / (a + b), "lower": beta_quantile_udf(F.lit(alpha), a, b), "upper": beta_quantile_udf(F.lit(1 - alpha), a, b)})


def miss_run(tallies: DataFrame, run: float = 3.0) -> DataFrame:
    return tallies.withColumn("chance", miss_run_udf("k", "n", F.lit(run)))


def folded(moments: pd.DataFrame, alpha: float, half_life: float, window: int, bounds: bool = True) -> dict:
    """Reading of one sequence of moments (came, weight; in order): the last `window`, decayed by rank. Misses at the end
    whose chance under what was before is below alpha over the effective sample break it: what was before is discounted. Bounds
    may be left to `reading`, which takes many at once."""
    came, weight = moments["came"].to_numpy(bool)[-window:], moments["weight"].to_numpy(float)[-window:]
    size = len(came)
    w = weight * 0.5 ** ((size - 1 - np.arange(size)) / half_life)
    hits = np.flatnonzero(came)
    tail = np.arange(hits[-1] + 1 if len(hits) else 0, size)
    tail = tail[weight[tail] > 0]
    start, run = (int(tail[0]), float(weight[tail].sum())) if len(tail) else (size, 0.0)
    k0, n0, k1, n1 = (w[:start] * came[:start]).sum(), w[:start].sum(), (w[start:] * came[start:]).sum(), w[start:].sum()
    factor = 1.0
    if run > 0 and start > 0:
        a, b = min(k0, n0) + 0.5, n0 - min(k0, n0) + 0.5
        chance = math.exp(math.lgamma(b + run) + math.lgamma(a + b) - math.lgamma(b) - math.lgamma(a + b + run))
        line = alpha / max(n0, 1.0)
        factor = chance / line if chance < line else 1.0
    k, n = min(k0 * factor + k1, n0 * factor + n1), n0 * factor + n1
    told = {"k": k, "n": n, "mean": (k + 0.5) / (n + 1), "discount": factor, "count": size}
    return told | (dict(zip(("lower", "upper"), beta_quantile([alpha, 1 - alpha], k + 0.5, n - k + 0.5), strict=True)) if bounds else {})


def edge_readings(moments: DataFrame, by: list[str], alpha: float = 0.05, half_life: float = 8.0, window: int = 35) -> DataFrame:
    """Folded reading of each edge's moments (by, at_us, came, weight). Only the last `window` rows of an edge reach Python."""
    recent = moments.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("at_us").desc(), "uri"))).where(F.col("r") <= window)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema if f.name in by)

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["at_us", "uri"])
        got = folded(t, alpha, half_life, window, bounds=False)
        return pd.DataFrame([dict(zip(by, key, strict=True)) | {c: got[c] for c in ("k", "n", "discount", "count")}])

    out = recent.groupBy(*by).applyInPandas(run, f"{kinds}, k double, n double, discount double, count long")
    return reading(out, alpha).select(*by, "k", "n", "mean", "lower", "upper", "discount", "count")


def first_in_range(items: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Each item (key, id, from_us, to_us) with its first row (key, at_us, uri) in (from_us, to_us]: an equi join that carries
    the range as a condition, reduced to one row an item by a partial minimum."""
    hit = items.join(rows.select(*key, "at_us", "uri"), key).where((F.col("at_us") > F.col("from_us")) & (F.col("at_us") <= F.col("to_us")))
    first = hit.groupBy("id").agg(F.min(F.struct("at_us", "uri")).alias("hit"))
    return items.join(first, "id", "left").select(*items.columns, F.col("hit.at_us").alias("at_us"), F.col("hit.uri").alias("uri"))


def settle(expectations: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Outcome of each expectation (id, key, from_us, start_us, end_us, to_us, spoken_us) by its first act (abandoned acts left
    out by the caller): overdue, after_reminder, early, on_time or late, with the offset in whole minutes, rounded."""
    s = first_in_range(expectations, rows, key)
    outcome = (
        F.when(F.col("at_us").isNull(), "overdue").when(F.col("spoken_us") < F.col("at_us"), "after_reminder").when(F.col("at_us") < F.col("start_us"), "early").when(F.col("at_us") <= F.col("end_us"), "on_time").otherwise("late")
    )
    span = F.when(outcome == "after_reminder", F.col("at_us") - F.col("spoken_us")).when(outcome == "early", F.col("at_us") - F.col("start_us")).when(outcome == "late", F.col("at_us") - F.col("end_us"))
    return s.withColumns({"outcome": outcome, "offset_minutes": F.round(span / 60_000_000).cast("long")})


def rule_overdue(overdue: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Overdue expectations (id, key, deadline_us, before_us) that were caught up: the first act after the deadline, if before
    the next opportunity."""
    limits = overdue.select("id", *key, F.col("deadline_us").alias("from_us"), F.coalesce(F.col("before_us") - 1, F.lit(1 << 60)).alias("to_us"))
    got = first_in_range(limits, rows, key).where("at_us is not null")
    return got.withColumn("delay_minutes", F.greatest(F.lit(1), F.round((F.col("at_us") - F.col("from_us")) / 60_000_000)).cast("long"))


def omissions(rows: DataFrame, expectations: DataFrame, key: list[str]) -> DataFrame:
    """Acts that no expectation's span covered: a range anti join."""
    e = expectations.select(*[F.col(k).alias(f"e_{k}") for k in key], "from_us", "to_us")
    cond = (F.col("at_us") > F.col("from_us")) & (F.col("at_us") <= F.col("to_us"))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"e_{k}"))
    return rows.join(e, cond, "left_anti")


def current_facts(facts: DataFrame) -> DataFrame:
    """The fact that stands for each id: highest precedence, revisions before originals, then the latest."""
    w = Window.partitionBy("id").orderBy(F.col("precedence").desc(), F.col("is_revision").desc(), F.col("seq").desc())
    return facts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def offset_strengths(settled: DataFrame, key: list[str]) -> DataFrame:
    """For each settled offset the part of earlier ones at least as large (in time counts as 0); 1 with fewer than two."""
    a = settled.select(*key, "id", "start_us", F.coalesce("offset_minutes", F.lit(0)).alias("offset"))
    past = a.select(*key, F.col("start_us").alias("p_us"), F.abs("offset").alias("p"))
    by = a.join(past, key).where("p_us < start_us").groupBy(*key, "id", "offset").agg(F.count("*").alias("n"), F.avg((F.col("p") >= F.abs("offset")).cast("double")).alias("share"))
    return a.join(by.select("id", "n", "share"), "id", "left").select(*key, "id", F.when((F.col("offset") == 0) | (F.coalesce("n", F.lit(0)) < 2), 1.0).otherwise(F.col("share")).alias("strength"))


def calibration(settled: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Claimed against realized chances (by, claimed, hit) of each slice, and whether the claim lies outside the bounds."""
    s = settled.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.avg("claimed").alias("claimed"), F.sum(F.col("hit").cast("double")).alias("k"))
    return reading(s, alpha).withColumn("off", (F.col("claimed") < F.col("lower")) | (F.col("claimed") > F.col("upper")))
