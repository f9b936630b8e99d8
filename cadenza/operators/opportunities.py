"""Opportunities of relations, which relation of a family speaks, moments and units of expectations, and gates and states of
relations night by night."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.clock import DAY_US
from cadenza.functions.evidence import beta_quantile_udf
from cadenza.operators.reliability import folded

ADMITTED = ("candidate", "established")
TABLE = ["key", "lane", "segment", "day", "antecedent_uri", "came", "consequent_uri", "consequent_us"]


def admitted(relations: DataFrame) -> DataFrame:
    """Relations (lane, key, segment chain or situation, antecedent, consequent, status, upward, conditioned) that have
    opportunities: candidates and established ones; of those with conditions only established chains, of situations only those
    that make an act more frequent."""
    chain = (F.col("segment") == "chain") & (~F.col("conditioned") | (F.col("status") == "established"))
    return relations.where(F.col("status").isin(*ADMITTED) & (chain | ((F.col("segment") == "situation") & F.col("upward") & ~F.col("conditioned"))))


def event_opportunities(relations: DataFrame, eps: DataFrame, pieces: DataFrame, window_us: int) -> DataFrame:
    """Each admitted chain relation and each episode of its antecedent: did the consequent start within window_us of its end? True
    with the first natural one; unknown if only reminded ones came, or none while part of the window (pieces: lane, day,
    piece_begin, piece_end) wasn't observed; else false. Episodes meet acts and pieces of their window's days only."""
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / DAY_US), F.floor(b / DAY_US)))
    chains = eps.select("lane", F.col("kind").alias("antecedent"), F.col("first_uri").alias("a_uri"), "day", F.col("last_us").alias("from_us"), (F.col("last_us") + window_us).alias("to_us"))
    acts = eps.select("lane", F.col("kind").alias("consequent"), F.col("start_us").alias("b_us"), F.col("first_uri").alias("b_uri"), "natural", reach(F.col("start_us") - window_us, F.col("start_us")).alias("d"))
    own = admitted(relations).where("segment = 'chain'").join(chains, ["lane", "antecedent"]).withColumn("d", F.floor(F.col("from_us") / DAY_US))
    inside = (F.col("b_us") > F.col("from_us")) & (F.col("b_us") <= F.col("to_us"))
    met = own.join(acts, ["lane", "consequent", "d"], "left")
    met = met.groupBy("key", "lane", "a_uri").agg(
        F.min("day").alias("day"), F.min(F.when(inside & F.col("natural"), F.struct("b_us", "b_uri"))).alias("first"), F.max((inside & ~F.col("natural")).cast("int")).alias("reminded"),
    )
    spans = chains.select("lane", "a_uri", "from_us", "to_us", reach(F.col("from_us"), F.col("to_us")).alias("d"))
    gone = pieces.select("lane", "piece_begin", "piece_end", F.floor(F.col("piece_begin") / DAY_US).alias("d"))
    dark = spans.join(gone, ["lane", "d"]).where("piece_begin < to_us and piece_end > from_us").select("lane", "a_uri").distinct().withColumn("dark", F.lit(True))
    out = met.join(dark, ["lane", "a_uri"], "left")
    came = F.when(F.col("first").isNotNull(), True).when((F.coalesce("reminded", F.lit(0)) == 0) & F.col("dark").isNull(), False)
    return out.select("key", "lane", F.lit("chain").alias("segment"), "day", F.col("a_uri").cast("string").alias("antecedent_uri"), came.alias("came"), F.col("first.b_uri").alias("consequent_uri"), F.col("first.b_us").alias("consequent_us"))


def situation_opportunities(relations: DataFrame, conditions: DataFrame, days: DataFrame) -> DataFrame:
    """Each admitted situation relation and each day on which its condition holds (conditions: lane, day, antecedent, day_type or
    null): did the consequent come naturally that day (days: class, day, natural, natural_us, natural_uri)? Unknown if it was only
    reminded of. Only days of the types in which it ever came on such a day count, and days whose type isn't known."""
    held = admitted(relations).where("segment = 'situation'").join(conditions, ["lane", "antecedent"])
    marks = days.select("lane", F.col("kind").alias("consequent"), "day", "natural", "natural_us", "natural_uri")
    rows = held.join(marks, ["lane", "consequent", "day"], "left")
    came = F.when(F.col("natural") > 0, True).when(F.col("natural").isNull(), False)
    types = F.collect_set(F.when(came & F.col("day_type").isNotNull(), F.col("day_type"))).over(Window.partitionBy("key", "lane"))
    rows = rows.withColumns({"came": came, "types": types}).where((F.size("types") == 0) | F.col("day_type").isNull() | F.array_contains("types", F.col("day_type")))
    return rows.select("key", "lane", F.lit("situation").alias("segment"), "day", F.concat(F.lit("calendar:"), F.col("day").cast("string")).alias("antecedent_uri"), "came", F.col("natural_uri").alias("consequent_uri"), F.col("natural_us").alias("consequent_us"))


def opportunity_table(relations: DataFrame, eps: DataFrame, pieces: DataFrame, window_us: int, conditions: DataFrame, days: DataFrame) -> DataFrame:
    """All opportunities of a lane's admitted relations (TABLE), which the triggers and accounts read."""
    return event_opportunities(relations, eps, pieces, window_us).unionByName(situation_opportunities(relations, conditions, days)).select(*TABLE)


def most_specific(members: DataFrame, chains: DataFrame, family: list[str], chain: list[str]) -> DataFrame:
    """For each chain the member of each family whose conditions all hold and are the most, ties by key. members: family, key,
    conditions (names); chains: of the family's first columns, the chain's own, and facts (map of name to true, false or null). A
    condition that isn't known doesn't hold; a family none of whose members holds has no row."""
    on = [c for c in family if c in chains.columns]
    holds = F.forall("conditions", lambda c: F.coalesce(F.try_element_at(F.col("facts"), c), F.lit(False)))
    w = Window.partitionBy(*family, *chain).orderBy(F.size("conditions").desc(), "key")
    return members.join(chains, on).where(holds).withColumn("r", F.row_number().over(w)).where("r = 1").select(*family, *chain, "key", F.size("conditions").alias("n_conditions"))


def antecedents_present(members: DataFrame, chains: DataFrame, family: list[str], now_us: int, window_us: int) -> DataFrame:
    """Every member (family, key, conditions) and whether it speaks now: the latest chain (uri, last_us, facts) of its family that
    ended within the window before now is the one it would follow, and only the most specific member that holds speaks."""
    on = [c for c in family if c in chains.columns]
    latest = Window.partitionBy(*on).orderBy(F.col("last_us").desc(), F.col("uri").desc())
    near = chains.where((F.col("last_us") < now_us) & (F.col("last_us") + window_us >= now_us)).withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")
    chosen = most_specific(members, near, family, ["uri"]).select(*family, "key", "uri")
    return members.join(chosen, [*family, "key"], "left").select(*family, "key", F.col("uri").isNotNull().alias("present"), F.col("uri").alias("source"))


def same_goal(chains: DataFrame, acts: DataFrame, window_us: int) -> DataFrame:
    """For each chain (lane, kind, chain, day, end_us, goals) and other kind: does an act of that kind (lane, kind, day, start_us,
    goal) of the same day, within the window, share one of its goals? Chains without goals are left out."""
    a = chains.where(F.size("goals") > 0).select("lane", F.col("kind").alias("antecedent"), "chain", "day", "end_us", "goals")
    b = acts.select("lane", F.col("kind").alias("consequent"), "day", "start_us", "goal")
    j = a.join(b, ["lane", "day"]).where((F.col("antecedent") != F.col("consequent")) & (F.col("start_us") > F.col("end_us")) & (F.col("start_us") <= F.col("end_us") + window_us))
    return j.groupBy("lane", "antecedent", "chain", "consequent").agg(F.bool_or(F.coalesce(F.array_contains("goals", F.col("goal")), F.lit(False))).alias("same"))


def moments(records: DataFrame, by: list[str]) -> DataFrame:
    """Records of expectations (by, id, from_us, to_us, formed_us, came or null, occurrence, strength, input) as moments: those of
    one day whose spans touch, in a chain. A moment came if one of its records did, with the largest strength of such; else it was
    missed if one was; else it isn't told of. An act that several moments claim counts for the first alone."""
    day = F.floor(F.col("from_us") / DAY_US)
    w = Window.partitionBy(*by, "d").orderBy("from_us", "to_us", "id")
    new = F.coalesce(F.col("from_us") > F.max("to_us").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long")
    part = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = records.withColumn("d", day).withColumn("new", new).withColumn("part", part).withColumn("moment", F.struct("d", "part")).drop("new")
    first = F.min(F.when(F.col("came"), F.col("moment"))).over(Window.partitionBy(*by, "occurrence"))
    hit = F.col("came") & (F.col("occurrence").isNull() | (F.col("moment") == F.col("first")))
    rows = rows.withColumn("first", first).withColumns({"hit": F.when(hit, F.col("strength")), "miss": F.when(~F.col("came"), F.col("strength"))})
    out = rows.groupBy(*by, "moment").agg(
        F.min("formed_us").alias("at_us"), F.max("hit").alias("hit"), F.max("miss").alias("miss"), F.array_sort(F.collect_set("input")).alias("signature"), F.count("*").alias("n"),
    )
    out = out.where("hit is not null or miss is not null")
    return out.select(*by, "at_us", "signature", F.col("hit").isNotNull().alias("came"), F.coalesce("hit", "miss").alias("strength"), "n")


LAYER = "level string, n_same_set long, n_same_count long, a double, b double"


def unit_readings(past: DataFrame, now: DataFrame, by: list[str], alpha: float = 0.05, half_life: float = 8.0, window: int = 35, prior_share: float = 0.5) -> DataFrame:
    """What past moments (by, at_us, signature, came, strength) say of a unit (by, at_us, signature): the folded reading of earlier
    moments of the same inputs, drawn to that of other sets of as many inputs; of as many inputs alone where the set is new; or
    no reading (strongest) where neither was seen.

    The prior weighs at most prior_share of the effective sample that decay leaves. Per layer only the last `window` moments are
    read, so that many at most of each reach Python."""
    u = now.select(*by, F.col("at_us").alias("now_us"), F.col("signature").alias("set"))
    j = u.join(past, by).where((F.col("at_us") < F.col("now_us")) & (F.size("signature") == F.size("set"))).withColumn("same", F.col("signature") == F.col("set"))
    key = [*by, "now_us"]
    late = F.row_number().over(Window.partitionBy(*key, "same").orderBy(F.col("at_us").desc(), F.array_join("signature", "+").desc()))
    j = j.withColumns({"r": late, "total": F.count("*").over(Window.partitionBy(*key, "same"))}).where(F.col("r") <= window)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema if f.name in by)

    def run(k: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("r", ascending=False).rename(columns={"strength": "weight"})
        parts = {s: t[t["same"] == s] for s in (True, False)}
        n = {s: int(p["total"].iloc[0]) if len(p) else 0 for s, p in parts.items()}
        read = {s: folded(p, alpha, half_life, window, bounds=False) for s, p in parts.items() if len(p)}
        own = read.get(True, read.get(False))
        hit, miss = own["k"], own["n"] - own["k"]
        if len(read) > 1:
            strength = min(prior_share / (1 - 0.5 ** (1 / half_life)), read[False]["n"])
            hit, miss = hit + strength * read[False]["mean"], miss + strength * (1 - read[False]["mean"])
        row = ["same_set" if True in read else "same_count", n[True], n[True] + n[False], hit + 0.5, max(miss, 0.0) + 0.5]
        return pd.DataFrame([[*k, *row]], columns=[*key, *(x.split()[0] for x in LAYER.split(", "))])

    told = j.select(*key, "same", "r", "total", "came", "strength").groupBy(*key).applyInPandas(run, f"{kinds}, now_us long, {LAYER}")
    told = told.withColumns({"mean": F.col("a") / (F.col("a") + F.col("b")), "lower": beta_quantile_udf(F.lit(alpha), "a", "b"), "upper": beta_quantile_udf(F.lit(1 - alpha), "a", "b")})
    out = u.join(told, key, "left")
    return out.select(*key, F.coalesce("level", F.lit("strongest")).alias("level"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_same_set", "n_same_count")], "mean", "lower", "upper")


def speakable(backed: Column, status: Column, large: Column) -> Column:
    """May an input be spoken from? What no relation backs may; what one backs if it is established and not known to be small."""
    return ~backed | ((status == "established") & F.coalesce(large, F.lit(True)))


def basis(inputs: DataFrame, unit: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """The input each unit speaks from, of (unit, id, due, backed, status, large or null, lift, lower): of those that are due (or
    all, if none is) the cause with the largest lift, that is established, large enough and lifts; else the speakable one with
    the largest lower bound; else any one with the largest. Ties to the larger id, then to the larger of the columns to carry along."""
    cause = F.coalesce((F.col("status") == "established") & F.col("large") & (F.col("lift") > 0), F.lit(False))
    may = F.coalesce(speakable(F.col("backed"), F.col("status"), F.col("large")), F.lit(False))
    rank = F.struct(F.col("due").alias("1"), cause.alias("2"), F.when(cause, F.col("lift")).otherwise(0.0).alias("3"), (may & ~cause).alias("4"), F.when(~cause, F.col("lower")).otherwise(0.0).alias("5"), F.col("id").alias("id"), *carry, may.alias("speakable"))
    return inputs.groupBy(*unit).agg(F.max(rank).alias("best")).select(*unit, "best.id", "best.speakable", *[F.col("best")[c].alias(c) for c in carry])


def unit_level(speaks: Column, lower: Column, upper: Column, threshold: Column, previous: Column, feedback_upper: Column, setting: Column) -> Column:
    """1 to speak, 0 to keep silent: never if so set, or from an input that may not speak, or if reminders proved useless; always if
    so set; else by the reading's bounds, as before in between."""
    silent = F.coalesce(setting == "never", F.lit(False)) | ~speaks | F.coalesce(feedback_upper < threshold, F.lit(False))
    return F.when(silent, 0).when(setting == "always", 1).when(upper < threshold, 0).when(lower >= threshold, 1).otherwise(F.coalesce((previous == 1).cast("int"), F.lit(0)))


def self_check(lower: Column, upper: Column, threshold: Column, large: Column, lift: Column) -> Column:
    """Do an account's bounds and a relation's effect agree? What to call their pair."""
    cause = large & (lift > 0)
    high, low = lower >= threshold, upper < threshold
    return F.when(large.isNull(), "watching").when(high, F.when(cause, "basis").otherwise("coincidence")).when(low, F.when(cause, "miscomputed").otherwise("not_a_cause")).otherwise(F.when(cause, "cannot_rise").otherwise("watching"))


def large_enough(spread: Column, relative: Column, upward: Column, least: float, least_relative: float) -> Column:
    """Is the near end of both intervals (low, high; null where there is none) far enough from nothing? A relative one that can't be
    told is."""
    near = lambda i: F.when(upward, i["low"]).otherwise(-i["high"])
    return F.coalesce(near(spread) >= least, F.lit(False)) & (relative.isNull() | F.coalesce(near(relative) >= least_relative, F.lit(False)))


def gone(spread: Column, relative: Column, upward: Column, least: float, least_relative: float) -> Column:
    """Is even the far end of either interval too near to nothing? One that can't be told isn't."""
    far = lambda i: F.when(upward, i["high"]).otherwise(-i["low"])
    return F.coalesce(far(spread) < least, F.lit(False)) | (spread.isNotNull() & F.coalesce(far(relative) < least_relative, F.lit(False)))


def assessed(tests: DataFrame, least: float, least_relative: float, alpha: float) -> DataFrame:
    """tests (spread, relative, upward, leave_one_out, heterogeneity or null, was_large or null, n, difference, consequents) with the
    verdicts of the later gates: stable over time; large enough, or large before and not gone; and the part of the consequent's
    acts that is in excess."""
    i = (F.col("spread"), F.col("relative"), F.col("upward"))
    large = large_enough(*i, least, least_relative) | (F.coalesce("was_large", F.lit(False)) & ~gone(*i, least, least_relative))
    stable = F.col("leave_one_out") & (F.col("heterogeneity").isNull() | (F.col("heterogeneity") >= alpha))
    return tests.withColumns({"stable": stable, "large": large, "excess_share": F.try_divide(F.col("n") * F.col("difference"), F.col("consequents"))})


DORMANT = ("rejected", "expired")


def folded_night(before: DataFrame, tonight: DataFrame, key: list[str], alpha: float) -> DataFrame:
    """Relations' states after a night, from those before (key, status, discovered, needed) and the night's tests (key, night,
    retired, tested, significant, planned: antecedents a forward test needs; forward_n, forward_blocks, forward_least: its least
    p, forward_p; stable, large; kept_n, kept_needed, gone).

    New or dormant ones become candidates when significant, else they are tested or sparse (a dormant one stays as it is). A
    candidate is judged once: when its data since discovery have the antecedents it needs, two blocks, and could reach alpha; it
    is established if they do, and it is stable and large, else rejected. An established one expires when enough later data say
    that its effect is gone. One whose concepts are retired expires; one without a test tonight stays as it is."""
    j = before.withColumnRenamed("status", "was").join(tonight, key, "full_outer")
    was, active = F.col("was"), F.col("was").isin("candidate", "established")
    ready = (F.col("forward_n") >= F.col("needed")) & (F.col("forward_blocks") >= 2) & (F.col("forward_least") < alpha)
    passed = (F.col("forward_p") < alpha) & F.col("stable") & F.col("large")
    fresh = was.isNull() | ~active
    status = (
        F.when(F.coalesce("retired", F.lit(False)), F.when(active, "expired").otherwise(F.coalesce(was, F.lit("sparse"))))
        .when(F.col("night").isNull(), was)
        .when(fresh & F.col("significant"), "candidate")
        .when(fresh, F.when(was.isin(*DORMANT), was).when(F.col("tested"), "tested").otherwise("sparse"))
        .when(was == "candidate", F.when(F.coalesce(ready, F.lit(False)), F.when(F.coalesce(passed, F.lit(False)), "established").otherwise("rejected")).otherwise("candidate"))
        .otherwise(F.when(F.coalesce((F.col("kept_n") >= F.col("kept_needed")) & F.col("gone"), F.lit(False)), "expired").otherwise("established"))
    )
    j = j.withColumn("status", status)
    found = (F.col("status") == "candidate") & fresh
    return j.select(*key, "status", F.when(found, F.col("night")).otherwise(F.col("discovered")).alias("discovered"), F.when(found, F.col("planned")).otherwise(F.col("needed")).alias("needed"), (~F.col("status").eqNullSafe(was)).alias("moved"))


def classified(requests: DataFrame, vocabulary: DataFrame, answers: DataFrame) -> DataFrame:
    """requests (id) with the class that a model's answer (id, name; the last by seq) names, if the vocabulary (name, class_id) holds
    it as it is now; null, and why, for those without an answer or with one that is no class."""
    last = answers.groupBy("id").agg(F.max_by("name", "seq").alias("name"))
    j = requests.join(last, "id", "left").join(vocabulary.select("name", "class_id"), "name", "left")
    state = F.when(F.col("name").isNull(), "unanswered").when(F.col("class_id").isNull(), "outside").otherwise("classified")
    return j.select("id", "class_id", state.alias("state"))
