"""Expectations from opportunities: by days since the last time, by the day's situation, by what has just happened; and why some
were missed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.clock import DAY_US
from cadenza.operators.temporal import CLASS, History

DAYS = "lane long, kind string, elapsed int, opened int, last int, hits int, opportunities int, start_us long, end_us long"


def day_expectations(days: DataFrame, intervals: DataFrame, today: int, recent: int = 35, line: float = 0.67) -> DataFrame:
    """For each class what its last day lets expect today (a day number): the reading at that distance, and a window from the
    earliest clock time of its last `recent` hits on the day it opened to the latest on its last day.

    days: (lane, kind, day_no, natural_us); intervals: (lane, kind, following_no, days, seen, censored). Days of a class are
    one group: its distinct days, not its acts."""
    rows = days.where(F.col("day_no") < today).select(*CLASS, "day_no", "natural_us").join(
        intervals.select(*CLASS, F.col("following_no").alias("day_no"), "days", "seen", "censored"), [*CLASS, "day_no"], "left"
    )

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in DAYS.split(", ")]
        t, empty = t.sort_values("day_no"), pd.DataFrame([], columns=names)
        iv = t[t["days"].notna()]
        if len(t) < 2 or iv.empty:
            return empty
        h, elapsed = History([int(x) for x in iv["days"]], iv["seen"].tolist(), [bool(x) for x in iv["censored"]], line), int(today - t["day_no"].iloc[-1])
        got = h.at(elapsed) or h.overdue(elapsed)
        if got is None:
            return empty
        # an overdue reading takes its hits from the usual distance
        span = (h.median(), h.read(h.median())["last"]) if got["overdue"] else (got["first"], got["last"])
        hits = iv[iv["days"].between(*span) & ~iv["censored"].astype(bool)]["natural_us"].dropna().tail(recent)
        if hits.empty:
            return empty
        clock, last = hits.astype("int64") % DAY_US, int(t["day_no"].iloc[-1])
        row = [*key, elapsed, got["opened"], got["last"], got["hits"], got["opportunities"], (last + got["opened"]) * DAY_US + int(clock.min()), (last + got["last"]) * DAY_US + int(clock.max())]
        return pd.DataFrame([row], columns=names)

    return rows.groupBy(*CLASS).applyInPandas(run, DAYS)


def spread(times: Column) -> tuple[Column, Column]:
    """The tenth and the ninetieth of a hundred of a sorted array by place, not between two: first and last up to ten."""
    off = F.floor((F.size(times) - 1) * F.lit(0.1)).cast("int")
    return F.get(times, off), F.get(times, F.size(times) - 1 - off)


def situation_expectations(days: DataFrame, situation: Column, today: Column, least: int = 2) -> DataFrame:
    """Classes that came on `least` earlier days of today's situation, and the spread of their clock times on those days.
    days: (lane, kind, day, natural_us). `situation` gives a day's situation of the column named day."""
    past = days.withColumn("s", situation).where(F.col("natural_us").isNotNull() & (F.col("day") < today))
    now = days.sparkSession.range(1).select(today.alias("day")).select(situation.alias("s"))
    hit = past.join(F.broadcast(now), "s").groupBy(*CLASS).agg(F.sort_array(F.collect_list(F.col("natural_us") % DAY_US)).alias("t"))
    a, b = spread(F.col("t"))
    return hit.where(F.size("t") >= least).select(*CLASS, F.size("t").alias("hits"), a.alias("from_clock_us"), b.alias("to_clock_us"))


def event_expectations(episodes: DataFrame, now_us: int, hours: int = 6, least: int = 2) -> DataFrame:
    """Kinds that followed an act of another kind within `hours` before, `least` times, for acts of the last hours: when they are
    due, by the spread of how long they took. An antecedent that has been followed already is left out."""
    span = hours * 3_600_000_000
    a = episodes.select("lane", F.col("kind").alias("antecedent"), F.col("start_us").alias("a_us"), "last_us").where(F.col("a_us") <= now_us)
    b = episodes.select("lane", F.col("kind").alias("consequent"), F.col("start_us").alias("b_us")).where(F.col("b_us") <= now_us)
    # an act meets those of the days that its window can reach
    a_day, reach = F.floor(F.col("last_us") / DAY_US), F.explode(F.sequence(F.floor((F.col("b_us") - span) / DAY_US), F.floor(F.col("b_us") / DAY_US)))
    j = a.withColumn("d", a_day).join(b.withColumn("d", reach), ["lane", "d"]).where((F.col("antecedent") != F.col("consequent")) & (F.col("b_us") > F.col("last_us")) & (F.col("b_us") <= F.col("last_us") + span))
    key = ["lane", "antecedent", "consequent"]
    first = j.groupBy(*key, "a_us").agg(F.min(F.col("b_us") - F.col("last_us")).alias("off"))
    done = first.where(F.col("a_us") > now_us - span).select(*key, "a_us")
    past = first.where(F.col("a_us") <= now_us - span).groupBy(*key).agg(F.sort_array(F.collect_list("off")).alias("t")).where(F.size("t") >= least)
    lo, hi = spread(F.col("t"))
    open_ = a.where(F.col("a_us") > now_us - span)
    due = open_.join(past.select(*key, F.size("t").alias("hits"), lo.alias("lo"), hi.alias("hi")), ["lane", "antecedent"]).join(done, [*key, "a_us"], "left_anti")
    return due.select(*key, "a_us", "hits", (F.col("last_us") + F.col("lo")).alias("start_us"), (F.col("last_us") + F.col("hi")).alias("end_us"))


# Causes of a miss in the order in which they are asked.
CAUSES = ("voided", "unseen", "abandoned", "postponed", "broken", "relation_gone", "reclassified", "antecedent_absent", "day_type_differs", "notice_driven")


def causes(misses: DataFrame) -> DataFrame:
    """The first cause that holds of each miss (a boolean column a cause, null as not), or unexplained."""
    out = F.coalesce(*[F.when(F.col(c), c) for c in CAUSES], F.lit("unexplained"))
    return misses.withColumn("cause", out)


def relation_states(nights: DataFrame, key: list[str], misses: int = 2) -> DataFrame:
    """Status of each relation after each night (key, night, tested, significant, forward: the test on data since discovery, null
    while there is too little; kept: the test on later data, null while there is too little).

    sparse until tested; tested; candidate from significance on; established when forward passes, rejected when it fails;
    expired after `misses` tests of kept that failed in a row. A rejected or expired one is a candidate again when it is
    significant on a later night. Each step needs the one before, so a relation's nights are one group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nights.schema if f.name in [*key, "night"])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, status, failed, out = t.sort_values("night"), "sparse", 0, []
        for tested, significant, forward, kept in t[["tested", "significant", "forward", "kept"]].itertuples(index=False):
            if status == "candidate":
                status = status if pd.isna(forward) else "established" if forward else "rejected"
                failed = 0
            elif status == "established":
                failed = failed if pd.isna(kept) else 0 if kept else failed + 1
                status = "expired" if failed >= misses else status
            elif tested:
                status = "candidate" if significant else "tested" if status == "sparse" else status
            out.append(status)
        return t[[*key, "night"]].assign(status=out)

    return nights.groupBy(*key).applyInPandas(run, f"{kinds}, status string")


def retained(messages: DataFrame, budget: int, ideal: int) -> DataFrame:
    """Where to cut each conversation that holds more than `budget` tokens: of the safe places (conv_id, turn, tokens, safe,
    semantic 0..2) the one with the best sum of two times its semantic distance and its closeness to `ideal` tokens kept
    after it; ties to the later one."""
    w = Window.partitionBy("conv_id")
    after = F.sum("tokens").over(w.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, -1))
    m = messages.withColumns({"total": F.sum("tokens").over(w), "after": F.coalesce(after, F.lit(0))}).where(F.col("safe") & (F.col("total") > budget))
    closeness = 1 - F.least(F.abs(F.col("after") - ideal) / F.lit(float(ideal)), F.lit(1.0))
    scored = m.withColumn("score", F.round(2 * F.coalesce("semantic", F.lit(0.0)) + closeness, 9))
    return scored.groupBy("conv_id").agg(F.max_by("turn", F.struct("score", "turn")).alias("turn"), F.max("score").alias("score"))


def clamped(drafts: DataFrame, now_us: int, slot_us: int = 900_000_000) -> DataFrame:
    """Windows (start_us, end_us, boundary_us) that can still be kept: they start no earlier than now, last a slot at least, and
    end by the boundary; those that are over go."""
    start = F.greatest("start_us", F.lit(now_us))
    end = F.least(F.greatest(F.col("end_us"), start + slot_us), F.col("boundary_us"))
    return drafts.where(F.col("end_us") >= now_us).withColumns({"start_us": start, "end_us": end}).where(F.col("end_us") > F.col("start_us"))


def formed(drafts: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """Expectations of drafts (lane, kind, source, trigger, instance, ...): one an identity, which names lane, kind, source,
    trigger, instance and the rules' version; those that are known already go."""
    identity = F.substring(F.sha2(F.concat_ws("|", "lane", "kind", "source", "trigger", "instance", F.lit(version)), 256), 1, 24)
    named = drafts.withColumn("id", identity)
    w = Window.partitionBy("id").orderBy("start_us", "end_us")
    return named.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").join(known.select("id"), "id", "left_anti")
