"""Case-crossover relation mining: does a kind of act follow another more often than in matched controls?

Strata are built by joins on (lane, day or weekday); every pair of kinds of a lane is one relation. Only strata, a few numbers
each, reach Python, one relation at a time.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import statistics as S
from cadenza.functions.clock import DAY_US

KEY = ["lane", "antecedent", "consequent"]


def strata(eps: DataFrame, window_hours: int = 6, weeks: int = 4, horizon_us: int | None = None) -> DataFrame:
    """A row for each antecedent episode and other kind of its lane: treated (a consequent starts in the hours after it; null
    beyond the horizon), and over the same weekday and clock time of other weeks without that antecedent: controls, and
    positives among them. Episodes are (lane, kind, start_us, last_us, day)."""
    span = window_hours * 3_600_000_000
    acts = eps.select("lane", F.col("kind").alias("consequent"), F.col("start_us").alias("b_us"), F.col("day").alias("b_day"))
    kinds = acts.select("lane", "consequent").distinct()
    chain = eps.select("lane", F.col("kind").alias("antecedent"), F.col("start_us").alias("a_us"), F.col("last_us").alias("end_us"), "day")
    base = chain.join(kinds, "lane").where("antecedent <> consequent")
    if horizon_us is not None:
        base = base.withColumn("seen", F.col("end_us") + span <= horizon_us)
    else:
        base = base.withColumn("seen", F.lit(True))
    lanes = eps.groupBy("lane").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    # the window itself, and its image in each other week, are probes; one range join answers them all
    shifts = F.explode(F.array(*[F.lit(7 * w) for w in range(-weeks, weeks + 1)]))
    probe = base.select(*KEY, "a_us", "end_us", "day", "seen", shifts.alias("shift")).withColumns({"at": F.col("end_us") + F.col("shift") * DAY_US, "on": F.date_add("day", F.col("shift"))})
    probe = probe.join(lanes, "lane").where((F.col("shift") == 0) | ((F.col("on") >= F.col("d0")) & (F.col("on") <= F.col("d1"))))
    busy = chain.select("lane", "antecedent", F.col("day").alias("on")).distinct().withColumn("busy", F.lit(True))
    probe = probe.join(busy, ["lane", "antecedent", "on"], "left").where((F.col("shift") == 0) | F.col("busy").isNull())
    b = acts.withColumn("probe_day", F.explode(F.array("b_day", F.date_sub("b_day", 1)))).drop("b_day")
    p = probe.withColumn("probe_day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / DAY_US).cast("int")))
    hit = p.join(b, ["lane", "consequent", "probe_day"], "left").groupBy(*KEY, "a_us", "day", "seen", "shift").agg(F.coalesce(F.max(((F.col("b_us") > F.col("at")) & (F.col("b_us") <= F.col("at") + span)).cast("int")), F.lit(0)).alias("hit"))
    return hit.groupBy(*KEY, "a_us", "day").agg(
        F.max(F.when((F.col("shift") == 0) & F.col("seen"), F.col("hit"))).alias("treated"), F.count(F.when(F.col("shift") != 0, 1)).alias("controls"), F.sum(F.when(F.col("shift") != 0, F.col("hit")).otherwise(0)).alias("positives"),
    )


def blocks(strat: DataFrame, days: int = 7) -> DataFrame:
    """strata with controls, their control rate and block number, counted from the relation's first day."""
    first = F.min("day").over(Window.partitionBy(*KEY))
    return strat.where("treated is not null and controls > 0").withColumns({"rate": F.col("positives") / F.col("controls"), "block": F.floor(F.datediff("day", first) / days).cast("long"), "p": (F.col("treated") + F.col("positives")) / (F.col("controls") + 1)})


def effects(strat: DataFrame) -> DataFrame:
    """Rates, their difference, the relative difference, and the least p that the strata could give."""
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    out = blocks(strat).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg(F.col("treated").cast("double")).alias("treated_rate"), F.avg("rate").alias("control_rate"),
        F.sum(F.when(open_, F.log("p"))).alias("up"), F.sum(F.when(open_, F.log(1 - F.col("p")))).alias("down"),
    )
    least = F.when(F.col("up").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least(F.exp("up"), F.exp("down"))))
    relative = F.when(F.col("control_rate") > 0, F.try_divide("treated_rate", "control_rate") - 1)
    return out.select(*KEY, "n", "treated_rate", "control_rate", (F.col("treated_rate") - F.col("control_rate")).alias("difference"), relative.alias("relative"), least.alias("minimum_p"))


def stable(strat: DataFrame) -> DataFrame:
    """Does the difference keep its sign without any one block? Totals less each block's own sums."""
    by = blocks(strat).groupBy(*KEY, "block").agg(F.sum("treated").alias("t"), F.sum("rate").alias("r"), F.count("*").alias("c"))
    w = Window.partitionBy(*KEY)
    d = lambda t, r, c: F.round((t - r) / F.nullif(c, F.lit(0)), 12)
    one = by.withColumns({"whole": d(F.sum("t").over(w), F.sum("r").over(w), F.sum("c").over(w)), "rest": d(F.sum("t").over(w) - F.col("t"), F.sum("r").over(w) - F.col("r"), F.sum("c").over(w) - F.col("c"))})
    return one.groupBy(*KEY).agg((F.bool_and(F.coalesce(F.col("rest") * F.col("whole") > 0, F.lit(False))) & (F.count("*") > 1)).alias("stable"))


def p_values(strat: DataFrame, exact_limit: int = 1 << 62) -> DataFrame:
    """Exact one-sided and two-sided p-values of each relation, and the least that its strata could give. A relation's chances are
    one array; many relations are taken at once."""
    undecided = F.collect_list(F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p")))
    by = blocks(strat).groupBy(*KEY).agg(F.count("*").alias("n"), (F.sum("treated") - F.sum(F.when(F.col("p") >= 1, 1).otherwise(0))).alias("hit"), F.array_sort(undecided).alias("chances"))

    @F.pandas_udf("upper double, lower double, p double, minimum_p double")
    def tested(hit: pd.Series, chances: pd.Series) -> pd.DataFrame:
        rows = []
        for h, c in zip(hit, chances, strict=True):
            up, low = S.tails([int(h)] + [0] * (len(c) - 1), c, exact_limit) if len(c) else (1.0, 1.0)
            rows.append((up, low, S.two_sided(up, low), S.minimum_p(c)))
        return pd.DataFrame(rows, columns=["upper", "lower", "p", "minimum_p"])

    return by.select(*KEY, "n", tested("hit", "chances").alias("t")).select(*KEY, "n", "t.*")


TEST = "lane long, antecedent string, consequent string, n long, upper double, lower double, p double, minimum_p double, difference double, low double, high double, heterogeneity double, stable boolean"


def tests(strat: DataFrame, exact_limit: int = 400) -> DataFrame:
    """Exact p-values, a block bootstrap (seeded by the relation's name) and homogeneity of each relation."""

    def run(batches):
        names = [x.split()[0] for x in TEST.split(", ")]
        for t in batches:
            keys, strata = zip(*(t.column(c).to_pylist() for c in KEY), strict=True), t.column("strata")
            treated, p, rate, block = (strata.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("treated", "p", "rate", "block"))
            at, rows = strata.offsets.to_numpy() - strata.offsets[0].as_py(), []
            for key, lo, hi in zip(keys, at[:-1], at[1:], strict=True):
                x, c, r, b = treated[lo:hi], p[lo:hi], rate[lo:hi], block[lo:hi]
                up, low = S.tails(x, c, exact_limit)
                seed = int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:16], 16)
                least, most = S.bootstrap(x, r, b, rounds=400, seed=seed)[0]
                rows.append((*key, len(x), up, low, S.two_sided(up, low), S.minimum_p(c), S.difference(x, r), least, most, S.heterogeneity(x, c, b), S.stable_without_any_block(x, r, b)))
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split()[1]]) for v, x in zip(zip(*rows, strict=True), TEST.split(", "), strict=True)], names=names)

    # a relation's strata are one array. So many parts are asked for by number: by size a few megabytes would be one task's
    by = blocks(strat).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a_us", F.col("treated").cast("long").alias("treated"), "p", "rate", "block"))).alias("strata"))
    spark = strat.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return by.repartition(parts, *KEY).mapInArrow(run, TEST)


def discoveries(tested: DataFrame, q: float = 0.1) -> DataFrame:
    """Family and false-discovery control within each lane: its relations, as many as pairs of kinds, in one task."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        name = t["antecedent"] + ">" + t["consequent"]
        family, found = S.tarone_bh(dict(zip(name, t["p"], strict=True)), dict(zip(name, t["minimum_p"], strict=True)), {}, q)
        return t[KEY].assign(in_family=name.isin(family), found=name.isin(found))

    return tested.groupBy("lane").applyInPandas(run, "lane long, antecedent string, consequent string, in_family boolean, found boolean")


def change_points(counts: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Days (by, day_no, n) on which a series' rate changes."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in by)

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("day_no")
        days = t["day_no"].tolist()
        return pd.DataFrame([[*key, days[i]] for i in S.change_points(t["n"], least=least)], columns=[*by, "day_no"])

    return counts.groupBy(*by).applyInPandas(run, f"{kinds}, day_no long")


STATE = "n_states long, treated_units long, control_units long, treated_rate double, control_rate double, upper double, lower double, p double, minimum_p double, unit_days long"


def state_tests(daily: DataFrame, by: list[str]) -> DataFrame:
    """Does an act come more often on days in a state (a run of days) than on as many ordinary days just before and after it?

    daily: (by, day_no, outcome 1/0/null, inside). Days are joined to units as long as the outcome clusters; a unit is 1 if the
    act came on one of its days, 0 if on none, and doesn't count if that isn't known. Each run is a table of its own, and the
    runs' hypergeometric distributions are convolved. A series' days are one group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in daily.schema if f.name in by)

    def units(values: list, at: list[int], size: int) -> list[int]:
        parts = [[values[i] for i in at[j : j + size]] for j in range(0, len(at), size)]
        return [int(1 in p) for p in parts if 1 in p or None not in p]

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("day_no")
        values, inside = [None if pd.isna(x) else int(x) for x in t["outcome"]], t["inside"].tolist()
        size, tables, i = S.unit_length(values, inside), [], 0
        while i < len(inside):
            j = i
            while j < len(inside) and inside[j]:
                j += 1
            if j > i:
                around = [[k for k in range(max(0, i - (j - i)), i) if not inside[k]], [k for k in range(j, min(len(inside), j + (j - i))) if not inside[k]]]
                tables.append((units(values, list(range(i, j)), size), [x for a in around for x in units(values, a, size)]))
            i = max(j, i + 1)
        tables = [x for x in tables if x[0] and x[1]]
        hit, base = [x for a, _ in tables for x in a], [x for _, c in tables for x in c]
        up, low, least = S.table_tails(tables)
        rate = lambda x: sum(x) / len(x) if x else 0.0
        row = [*key, len(tables), len(hit), len(base), rate(hit), rate(base), up, low, S.two_sided(up, low), least, size]
        return pd.DataFrame([row], columns=[*by, *(x.split()[0] for x in STATE.split(", "))])

    return daily.groupBy(*by).applyInPandas(run, f"{kinds}, {STATE}")


def more_needed(strat: DataFrame, threshold: float) -> DataFrame:
    """How many more informative strata, as telling as the median one, could bring the least p to the threshold; null without
    an informative one."""
    b = blocks(strat).where((F.col("p") > 0) & (F.col("p") < 1))
    typical = b.groupBy(*KEY).agg(F.median(F.least("p", 1 - F.col("p"))).alias("typical"))
    e = effects(strat).select(*KEY, "minimum_p").join(typical, KEY, "left")
    need = F.ceil(F.round(F.log(F.lit(threshold) / F.col("minimum_p")) / F.log("typical"), 9)).cast("long")
    return e.select(*KEY, F.when(F.col("typical").isNotNull(), F.when(F.col("minimum_p") <= threshold + 1e-12, F.lit(0).cast("long")).otherwise(need)).alias("needed"))


def strata_same_day(eps: DataFrame, window_hours: int = 6) -> DataFrame:
    """Like strata, with the ends of the lane's other episodes of that day as controls: of neither kind, and in another quarter
    of an hour than the antecedent's end."""
    span, slot = window_hours * 3_600_000_000, 900_000_000
    acts = eps.select("lane", F.col("kind").alias("consequent"), F.col("start_us").alias("b_us"))
    chain = eps.select("lane", F.col("kind").alias("antecedent"), F.col("start_us").alias("a_us"), F.col("last_us").alias("end_us"), "day")
    base = chain.join(acts.select("lane", "consequent").distinct(), "lane").where("antecedent <> consequent")
    ends = eps.select("lane", "day", F.col("kind").alias("other"), F.col("last_us").alias("o_us"))
    other = base.join(ends, ["lane", "day"]).where((F.col("other") != F.col("antecedent")) & (F.col("other") != F.col("consequent")) & (F.floor(F.col("o_us") / slot) != F.floor(F.col("end_us") / slot)))
    # one control a slot
    other = other.groupBy(*KEY, "a_us", "day", F.floor(F.col("o_us") / slot).alias("slot")).agg(F.min("o_us").alias("at")).withColumn("own", F.lit(False)).drop("slot")
    probe = base.select(*KEY, "a_us", "day", F.col("end_us").alias("at"), F.lit(True).alias("own")).unionByName(other)
    # a probe meets the acts of its window's two days at most, not the lane's whole history
    near = acts.withColumn("probe_day", F.explode(F.sequence(F.floor((F.col("b_us") - span) / DAY_US), F.floor(F.col("b_us") / DAY_US))))
    probe = probe.withColumn("probe_day", F.floor(F.col("at") / DAY_US))
    hit = probe.join(near, ["lane", "consequent", "probe_day"], "left").groupBy(*KEY, "a_us", "day", "own", "at").agg(F.coalesce(F.max(((F.col("b_us") > F.col("at")) & (F.col("b_us") <= F.col("at") + span)).cast("int")), F.lit(0)).alias("hit"))
    return hit.groupBy(*KEY, "a_us", "day").agg(F.max(F.when(F.col("own"), F.col("hit"))).alias("treated"), F.count(F.when(~F.col("own"), 1)).alias("controls"), F.sum(F.when(~F.col("own"), F.col("hit")).otherwise(0)).alias("positives"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Effects (as of effects) by two kinds of controls, both of which must hold: the larger least p, the weaker difference, 0
    where they point apart."""
    b = second.select(*KEY, F.col("difference").alias("d2"), F.col("minimum_p").alias("p2"))
    j = first.select(*KEY, F.col("difference").alias("d1"), F.col("minimum_p").alias("p1")).join(b, KEY)
    weak = F.when(F.col("d1") * F.col("d2") <= 0, 0.0).when(F.abs("d1") <= F.abs("d2"), F.col("d1")).otherwise(F.col("d2"))
    return j.select(*KEY, F.greatest("p1", "p2").alias("minimum_p"), weak.alias("difference"))
