"""From opportunities to what is said: timelines, situations, levels, deliveries, recall upkeep and context budgets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

CLASS = ["lane", "kind"]


def thinned(chains: DataFrame, days: int = 5) -> DataFrame:
    """Of each class's chains (lane, kind, day_no) those kept greedily: each more than `days` days after the last one kept. What
    is kept depends on what was kept before, so each class is one group, of its distinct days only."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for d in sorted(t["day_no"].tolist()):
            if last is None or d - last > days:
                kept.append(d)
                last = d
        return pd.DataFrame({"lane": key[0], "kind": key[1], "day_no": kept})

    return chains.select(*CLASS, "day_no").distinct().groupBy(*CLASS).applyInPandas(run, "lane long, kind string, day_no long")


def first_of_day(chains: DataFrame) -> DataFrame:
    w = Window.partitionBy(*CLASS, "day").orderBy("start_us", "first_uri")
    return chains.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def present_slots(records: DataFrame, slot: Column, missed: DataFrame) -> DataFrame:
    """Slots of a lane's day from its first to its last act, without slots that were missed in full."""
    span = records.groupBy("lane", "day").agg(F.min(slot).alias("a"), F.max(slot).alias("b"))
    return span.select("lane", "day", F.explode(F.sequence("a", "b")).alias("slot")).join(missed.where("missed >= 1").select("lane", "day", "slot"), ["lane", "day", "slot"], "left_anti")


def fully_present(present: DataFrame, width: int) -> DataFrame:
    """Slots from which `width` more follow without a hole."""
    w = Window.partitionBy("lane", "day").orderBy("slot")
    return present.withColumn("ahead", F.lead("slot", width).over(w)).where(F.col("ahead") == F.col("slot") + width).drop("ahead")


def prefix_hits(present: DataFrame, hits: DataFrame) -> DataFrame:
    """Running number of hits over a lane's present slots of a day: any window's hits are a difference of two."""
    w = Window.partitionBy("lane", "day").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    at = present.join(hits.select("lane", "day", "slot").distinct().withColumn("h", F.lit(1)), ["lane", "day", "slot"], "left")
    return at.select("lane", "day", "slot", F.sum(F.coalesce("h", F.lit(0))).over(w).alias("through"))


def streaks(hits: DataFrame, at: DataFrame, days: int) -> DataFrame:
    """For each moment (lane, at_us): was there a hit (lane, start_us) in each of the `days` 24-hour windows before it?"""
    day = 86_400_000_000
    j = at.join(hits.select("lane", F.col("start_us").alias("h_us")), "lane").where((F.col("h_us") < F.col("at_us")) & (F.col("h_us") >= F.col("at_us") - days * day))
    n = j.groupBy("lane", "at_us").agg(F.count_distinct(F.floor((F.col("at_us") - 1 - F.col("h_us")) / day)).alias("n"))
    return at.join(n, ["lane", "at_us"], "left").select("lane", "at_us", (F.coalesce("n", F.lit(0)) == days).alias("held"))


def markers(days: DataFrame, away: int = 14) -> DataFrame:
    """A class's first day, and days on which it returns after `away` days or more."""
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(*CLASS).orderBy("day")))
    return days.withColumn("gap", gap).select(*CLASS, "day", F.when(F.col("gap").isNull(), "first_seen").when(F.col("gap") >= away, "return").alias("marker")).where("marker is not null")


def prior_levels(answers: DataFrame, by: list[str]) -> DataFrame:
    """Ratings (rank 0 unlikely, 1 unsure, 2 likely) of each relation settled: the median, unsure where they span both ends;
    and its weight."""
    s = answers.groupBy(*by).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.median("rank").alias("mid"))
    level = F.when(F.col("hi") - F.col("lo") >= 2, 1).otherwise(F.bround("mid").cast("int"))
    return s.select(*by, level.alias("level"), F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), level + 1).alias("weight"))


def levels(readings: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Level of each account over time (by, seq, lower, upper, setting): 1 where the user set always, 0 where never; else 1 from a
    lower bound at the threshold on, 0 from an upper bound below it on, else as it was before (0 at first): the last decided
    value, without a loop."""
    clear = F.when(F.col("setting") == "always", 1).when((F.col("setting") == "never") | (F.col("upper") < threshold), 0).when(F.col("lower") >= threshold, 1)
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("level", F.coalesce(F.last(clear, ignorenulls=True).over(w), F.lit(0)))


def deliveries(items: DataFrame, cap: int) -> DataFrame:
    """What happens to each expectation (lane, day, id, level, due_us, awaiting): shadow at level 0; over the day's cap, full;
    else waiting for the host, or spoken."""
    w = Window.partitionBy("lane", "day", F.col("level") > 0).orderBy("due_us", "id")
    turn = F.row_number().over(w)
    return items.withColumn("turn", turn).withColumn("decision", F.when(F.col("level") == 0, "shadow").when(F.col("turn") > cap, "full").when(F.col("awaiting"), "awaiting_host").otherwise("spoken")).drop("turn")


def open_reminders(expectations: DataFrame, spoken: DataFrame, closed: DataFrame, at_us: int, limit: int) -> DataFrame:
    """Spoken of, not closed, before the deadline: the first by deadline, with when they were first spoken of."""
    first = spoken.groupBy("id").agg(F.min("spoken_us").alias("spoken_us"))
    return expectations.where(F.col("deadline_us") > at_us).join(first, "id").join(closed.select("id"), "id", "left_anti").orderBy("deadline_us", "id").limit(limit)


def snapshot_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two snapshots (key, label) that came, went, or changed their label; null labels are labels too."""
    b, a = before.select(*key, F.struct("label").alias("b")), after.select(*key, F.struct("label").alias("a"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(*key, change.alias("change")).where("change is not null")


def used(state: DataFrame, uses: DataFrame, most: int) -> DataFrame:
    """Recall state (id, n, last_us, version) after uses (id, used_us, known): counts capped, the last use kept, one version
    on; retired rows (retiring) refuse."""
    u = uses.groupBy("id").agg(F.count("*").alias("more"), F.max("used_us").alias("at"))
    j = state.join(u, "id", "left")
    hit = F.col("more").isNotNull() & ~F.col("retiring")
    return j.select("id", F.when(hit, F.least(F.col("n") + F.col("more"), F.lit(most))).otherwise(F.col("n")).alias("n"), F.when(hit, F.greatest("last_us", "at")).otherwise(F.col("last_us")).alias("last_us"), (F.col("version") + hit.cast("int")).alias("version"), (F.col("more").isNotNull() & F.col("retiring")).alias("refused"))


def neighbours(matches: DataFrame, links: DataFrame, each: int) -> DataFrame:
    """The first `each` linked ids (a, b, kind) of every match, by kind and id, both ways being there."""
    mutual = links.alias("x").join(links.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")), "left_semi")
    w = Window.partitionBy("id").orderBy("kind", "b")
    return matches.join(mutual.withColumnRenamed("a", "id"), "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")


def packed_context(blocks: DataFrame, budget: int) -> DataFrame:
    """Of each query's blocks in order those that fit: one that doesn't is passed over and the next is tried; a blank line's
    character lies between two. Only lengths reach Python, a query's at a time; `blocks` holds a query's top matches."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        room, kept = budget, []
        for i, n in t.sort_values("rank")[["id", "n"]].itertuples(index=False):
            need = n + bool(kept)
            if need <= room:
                kept.append(i)
                room -= need
        return pd.DataFrame({"query_id": key[0], "id": kept, "place": range(len(kept))})

    return blocks.select("query_id", "id", "rank", "n").groupBy("query_id").applyInPandas(run, "query_id long, id long, place long")


def expanded(roots: DataFrame, children: DataFrame, own: float = 0.8, depth: int = 8) -> DataFrame:
    """Scores of a tree of directories from the top: own * local + (1 - own) * the parent's; level by level, a join each.
    roots (query_id, id, score), children (query_id, parent, id, local)."""
    out, level = roots, roots
    for _ in range(depth):
        level = level.select("query_id", F.col("id").alias("parent"), F.col("score").alias("p")).join(children, ["query_id", "parent"]).select("query_id", "id", (own * F.col("local") + (1 - own) * F.col("p")).alias("score"))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


@pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def reduced_result(text: Column, limit: int = 65_536) -> Column:
    """A tool's result as it is, or above the limit a note of its size and digest."""
    size = F.octet_length(text)
    return F.when(size <= limit, text).otherwise(F.concat(F.lit("[omitted "), size.cast("string"), F.lit(" bytes, sha256 "), F.sha2(text, 256), F.lit("]")))


def journal_faults(messages: DataFrame) -> DataFrame:
    """Conversations whose sequence numbers have holes or repeat with another text."""
    by = messages.groupBy("conv_id", "turn").agg(F.count_distinct("text").alias("texts"), F.count("*").alias("n"))
    return by.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("holes"), F.count(F.when(F.col("texts") > 1, 1)).alias("conflicts"))


def aged_chains(frontier: DataFrame, by: str, before: Column, least: int) -> DataFrame:
    """Runs of neighbouring summaries (by, seq) that are all older than the limit and at least `least` long."""
    w = Window.partitionBy(by).orderBy("seq")
    old = frontier.where(before).withColumn("island", F.col("seq") - F.row_number().over(w))
    return old.groupBy(by, "island").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")
