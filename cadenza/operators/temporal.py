"""Event-series operators: episodes, observation coverage, densities, day profiles, intervals, absences.

Records are (uri, lane, kind, start_us, last_us, day, reminded); a class of acts is a (lane, kind). All per-class steps
partition by (lane, kind), so they share one shuffle; coverage is kept sparse (only slots that were missed).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.clock import DAY_US, day_number, day_of, slot_of
from cadenza.functions.evidence import shrink

CLASS = ["lane", "kind"]
SLOTS = 96
SLOT_US = DAY_US // SLOTS


def merge_starts(records: DataFrame, window_seconds: int = 2700) -> DataFrame:
    """records with `episode`: neighbours by start at most window_seconds apart join, in a chain."""
    w = Window.partitionBy(*CLASS).orderBy("start_us", "uri")
    new = F.coalesce(F.col("start_us") - F.lag("start_us").over(w) > window_seconds * 1_000_000, F.lit(True))
    return records.withColumn("episode", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def episodes(records: DataFrame, window_seconds: int = 2700) -> DataFrame:
    """One row an episode: start, last seen, its records' number, the first record, natural if that wasn't reminded."""
    first = F.struct("start_us", "uri")
    return (
        merge_starts(records, window_seconds)
        .groupBy(*CLASS, "episode")
        .agg(F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"), F.count("*").alias("n_records"), F.min_by("uri", first).alias("first_uri"), (~F.min_by("reminded", first)).alias("natural"))
        .withColumn("day", day_of(F.col("start_us")))
    )


def occurrence_days(eps: DataFrame) -> DataFrame:
    """Per class and local day: first episode, their number, natural ones, the first natural one."""
    at = F.struct("start_us", "first_uri")
    return eps.groupBy(*CLASS, "day").agg(
        F.min_by("first_uri", at).alias("first_uri"), F.min("start_us").alias("first_us"), F.count("*").alias("count"), F.sum(F.col("natural").cast("long")).alias("natural"),
        F.min_by("first_uri", F.when(F.col("natural"), at)).alias("natural_uri"), F.min(F.when(F.col("natural"), F.col("start_us"))).alias("natural_us"),
    )


def blind_days(days: DataFrame) -> DataFrame:
    """Days on which a class only came after reminders."""
    return days.where("natural = 0").select(*CLASS, "day")


def day_pieces(spans: DataFrame) -> DataFrame:
    """Spans (begin_us, end_us) cut at midnights, a row a day; one of no width stays on its day."""
    first, last = F.floor(F.col("begin_us") / DAY_US), F.floor((F.greatest("end_us", F.col("begin_us") + 1) - 1) / DAY_US)
    cut = spans.withColumn("d", F.explode(F.sequence(first, last)))
    return cut.withColumns({"piece_begin": F.greatest("begin_us", F.col("d") * DAY_US), "piece_end": F.greatest(F.col("begin_us"), F.least("end_us", (F.col("d") + 1) * DAY_US))}).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int"))).drop("d")


def standing_pieces(gaps: DataFrame, records: DataFrame) -> DataFrame:
    """Gap pieces that hold: a voidable piece in which a record of the lane starts is void. A range anti join on (lane, day)."""
    p = day_pieces(gaps).alias("p")
    r = records.select("lane", "day", "start_us").alias("r")
    inside = (F.col("p.lane") == F.col("r.lane")) & (F.col("p.day") == F.col("r.day")) & F.col("p.voidable") & (F.col("r.start_us") >= F.col("p.piece_begin")) & (F.col("r.start_us") < F.col("p.piece_end"))
    return p.join(r, inside, "left_anti")


def gap_union(pieces: DataFrame) -> DataFrame:
    """Overlapping or touching pieces of a lane's day as one span."""
    w = Window.partitionBy("lane", "day").orderBy("piece_begin", "piece_end")
    seen = F.max("piece_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("piece_begin") > seen, F.lit(True)).cast("int")
    parts = pieces.where("piece_end > piece_begin").withColumn("span", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("lane", "day", "span").agg(F.min("piece_begin").alias("begin_us"), F.max("piece_end").alias("end_us")).drop("span")


def missed_slots(pieces: DataFrame) -> DataFrame:
    """Per lane, day and slot: the part of the slot that wasn't observed. Slots without a row were observed in full."""
    base = day_number(F.col("day")).cast("long") * DAY_US
    u = gap_union(pieces).withColumn("base", base)
    first, last = F.floor((F.col("begin_us") - F.col("base")) / SLOT_US), F.least(F.floor((F.col("end_us") - 1 - F.col("base")) / SLOT_US), F.lit(SLOTS - 1))
    s = u.withColumn("slot", F.explode(F.sequence(first, last))).withColumn("slot", F.col("slot").cast("int")).withColumn("lo", F.col("base") + F.col("slot").cast("long") * SLOT_US)
    over = F.least("end_us", F.col("lo") + SLOT_US) - F.greatest("begin_us", "lo")
    return s.groupBy("lane", "day", "slot").agg(F.least(F.sum(over) / SLOT_US, F.lit(1.0)).alias("missed"))


def lane_days(records: DataFrame, last_day: Column) -> DataFrame:
    """Each lane's days from its first record to the last sealed day."""
    span = records.groupBy("lane").agg(F.min("day").alias("d0")).where(F.col("d0") <= last_day)
    return span.select("lane", F.explode(F.sequence("d0", last_day)).alias("day"))


def day_shares(spine: DataFrame, missed: DataFrame) -> DataFrame:
    """Part of each of a lane's days that was observed."""
    by = missed.groupBy("lane", "day").agg(F.sum("missed").alias("m"))
    return spine.join(by, ["lane", "day"], "left").select("lane", "day", (1 - F.coalesce("m", F.lit(0.0)) / SLOTS).alias("share"))


def last_natural(days: DataFrame, recent: int) -> DataFrame:
    w = Window.partitionBy(*CLASS).orderBy(F.col("day").desc())
    return days.where("natural > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).drop("r")


def density(days: DataFrame, shares: DataFrame, recent: int = 20) -> DataFrame:
    """How often a class comes while watched, from its last `recent` natural days; no row without a reading."""
    nat = last_natural(days, recent).groupBy(*CLASS).agg(F.min("day").alias("since"), F.sum("natural").alias("occurrences"), F.count("*").alias("occurrence_days"))
    blind = blind_days(days)
    seen = nat.join(shares.withColumnRenamed("lane", "l"), (F.col("lane") == F.col("l")) & (F.col("day") >= F.col("since"))).drop("l")
    watched = seen.join(blind, [*CLASS, "day"], "left_anti").groupBy(*CLASS).agg(F.sum("share").alias("watched"))
    both = nat.join(watched, CLASS).where("watched > 0")
    return both.select(*CLASS, "occurrences", "occurrence_days", "watched", (F.col("watched") / F.col("occurrences")).alias("days_per_occurrence"), F.least(F.col("occurrence_days") / F.col("watched"), F.lit(1.0)).alias("occurrence_day_share"))


def profile_days(eps: DataFrame, recent: int = 30) -> DataFrame:
    """The slots in which a class's natural episodes started, on its last `recent` natural days: (class, day, slot), distinct."""
    days = eps.where("natural").groupBy(*CLASS, "day").agg(F.collect_set(slot_of(F.col("start_us"))).alias("slots"))
    w = Window.partitionBy(*CLASS).orderBy(F.col("day").desc())
    return days.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).select(*CLASS, "day", F.explode("slots").alias("slot"))


def day_profile(eps: DataFrame, missed: DataFrame, last_day: Column | None = None, pool: int = 3, slot_strength: float = 4.0, pool_strength: float = 4.0, recent: int = 30) -> DataFrame:
    """Per class and slot: its part of the day's rate. A slot's rate is drawn to its neighbourhood's, that to the all-day
    rate, both as Beta pseudo-counts; neighbourhoods wrap at midnight. `top` days started there, `bottom` were watched. Days
    after last_day aren't sealed and don't count, though they are among the recent ones.

    A class's days are counted once into its 96 slots; a neighbourhood is a window over them, with the ends repeated."""
    if not 0 < 2 * pool < SLOTS:
        raise ValueError("the neighbourhood must be shorter than a day")
    days = eps.where("natural").groupBy(*CLASS, "day").agg(F.collect_set(slot_of(F.col("start_us"))).alias("slots"))
    w = Window.partitionBy(*CLASS).orderBy(F.col("day").desc())
    days = days.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent)
    if last_day is not None:
        days = days.where(F.col("day") <= last_day)
    lost = missed.groupBy("lane", "day").agg(F.collect_list(F.struct("slot", "missed")).alias("lost"))
    entry = lambda slot, t, d, m: F.struct(slot.cast("int").alias("slot"), t.alias("top"), d.alias("days"), m.alias("lost"))
    one, none = F.lit(1.0), F.lit(0.0)
    days = days.withColumns({"n_days": F.count("*").over(Window.partitionBy(*CLASS)), "latest": F.row_number().over(w) == 1})
    grid = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: entry(i, none, F.col("n_days").cast("double"), none))
    each = F.concat(  # all slots once a class, then what each day adds
        F.when(F.col("latest"), grid).otherwise(F.slice(grid, 1, 0)), F.transform("slots", lambda i: entry(i, one, none, none)),
        F.transform(F.coalesce("lost", F.array().cast("array<struct<slot:int,missed:double>>")), lambda x: entry(x["slot"], none, none, x["missed"].cast("double"))),
    )
    rates = days.join(lost, ["lane", "day"], "left").select(*CLASS, F.inline(each)).groupBy(*CLASS, "slot").agg(F.sum("top").alias("top"), (F.sum("days") - F.sum("lost")).alias("bottom"))
    i = F.col("slot")
    around = rates.withColumn("at", F.explode(F.when(i < pool, F.array(i, i + SLOTS)).when(i >= SLOTS - pool, F.array(i, i - SLOTS)).otherwise(F.array(i))))
    ring, whole, own = Window.partitionBy(*CLASS).orderBy("at").rowsBetween(-pool, pool), Window.partitionBy(*CLASS), F.col("at") == F.col("slot")
    total = lambda c: F.sum(F.when(own, F.col(c))).over(whole)
    around = around.withColumns({"pt": F.sum("top").over(ring), "pb": F.sum("bottom").over(ring), "tt": total("top"), "bb": total("bottom")}).where(own & (F.col("tt") > 0) & (F.col("bb") > 0))
    pooled = shrink(F.col("pt"), F.col("pb"), F.col("tt") / F.col("bb"), pool_strength)
    rate = F.least(F.greatest(shrink(F.col("top"), F.col("bottom"), pooled, slot_strength), none), one)
    return around.withColumn("rate", rate).select(*CLASS, "slot", (F.col("rate") / F.sum("rate").over(whole)).alias("share"))


def peaks(profile: DataFrame, floor: float = 0.1, days: DataFrame | None = None, min_days: int = 2) -> DataFrame:
    """Runs of slots above the mean whose parts sum to `floor` or more; a run over midnight belongs to the side on which it
    starts. With days (class, day, slot), runs that fewer than min_days distinct days started in go."""
    mean = F.lit(1.0 / SLOTS)
    ring = profile.withColumn("above", F.col("share") > mean)
    two = ring.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("slot") + F.col("turn") * SLOTS)
    w = Window.partitionBy(*CLASS).orderBy("at")
    begins = F.col("above") & ~F.coalesce(F.lag("above").over(w), F.lit(False))
    runs = two.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("above")
    first_above = ring.groupBy(*CLASS).agg(F.bool_and(F.when(F.col("slot") == SLOTS - 1, F.col("above"))).alias("wraps"), F.bool_and("above").alias("all"))
    got = runs.groupBy(*CLASS, "run").agg(F.min("at").alias("first_slot"), F.max("at").alias("last_slot"), F.sum("share").alias("share"), F.max_by("at", F.struct("share", -F.col("at"))).alias("centre_slot"))
    got = got.join(first_above, CLASS).where((F.col("first_slot") < SLOTS) & ~((F.col("first_slot") == 0) & F.col("wraps")) & ~F.col("all"))
    got = got.where(F.col("share") >= floor).drop("wraps", "all", "run")
    if days is None:
        return got
    hit = got.join(days, CLASS).where(F.pmod(F.col("slot") - F.col("first_slot"), F.lit(SLOTS)) <= F.col("last_slot") - F.col("first_slot"))
    return got.join(hit.groupBy(*CLASS, "first_slot").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= min_days), [*CLASS, "first_slot"])


def day_intervals(days: DataFrame, shares: DataFrame, density_of: DataFrame | None = None, profile: DataFrame | None = None, missed: DataFrame | None = None) -> DataFrame:
    """Between consecutive days of a class: days apart, the chance that none was missed between (seen), and censored if the
    later day was only reminded.

    A day between is missed by the class's occurrence-day share (or 1) times the part of its profile (or of the day, for a
    class without one) that lies in slots that weren't watched. Days that shares doesn't hold aren't sealed, and don't count. A
    lane's days with something unwatched go into each of its classes' timelines, where the last day before says which
    interval they fall in: no interval meets days beyond itself."""
    w = Window.partitionBy(*CLASS).orderBy("day")
    iv = days.select(*CLASS, F.lag("day").over(w).alias("previous"), F.col("day").alias("following"), (F.col("natural") == 0).alias("censored")).where("previous is not null")
    classes = days.select(*CLASS).distinct()
    if density_of is None:
        classes = classes.withColumn("p", F.lit(1.0))
    else:
        classes = classes.join(density_of.select(*CLASS, F.col("occurrence_day_share").alias("p")), CLASS, "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    part = 1 - F.col("share")
    lost = shares.where("share < 1")
    if profile is not None:
        curve = profile.groupBy(*CLASS).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "share"))), lambda x: x["share"]).alias("curve"))
        classes = classes.join(curve, CLASS, "left")
        slots = missed.groupBy("lane", "day").agg(F.collect_list(F.struct("slot", F.col("missed").cast("double").alias("missed"))).alias("slots"))
        lost = lost.join(slots, ["lane", "day"])
        by = F.aggregate("slots", F.lit(0.0), lambda s, x: s + F.get(F.col("curve"), x["slot"]) * x["missed"])
        part = F.when(F.col("curve").isNull(), part).otherwise(by)
    factor = 1 - F.least(F.col("p") * part, F.lit(1.0))
    away = classes.join(lost, "lane").select(*CLASS, "day", factor.alias("factor"))
    line = away.withColumn("own", F.lit(None).cast("date")).unionByName(days.select(*CLASS, "day", F.lit(None).cast("double").alias("factor"), F.col("day").alias("own")))
    line = line.withColumn("previous", F.max("own").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("own is null and previous < day")
    seen = line.groupBy(*CLASS, "previous").agg(F.exp(F.sum(F.when(F.col("factor") > 0, F.log("factor")))).alias("e"), F.min("factor").alias("least"))
    out = iv.join(seen, [*CLASS, "previous"], "left")
    return out.select(*CLASS, "previous", "following", F.datediff("following", "previous").alias("days"), F.when(F.col("least") <= 0, 0.0).otherwise(F.coalesce("e", F.lit(1.0))).alias("seen"), "censored")


def median_days(intervals: DataFrame) -> DataFrame:
    """Lower median of uncensored gaps, weighted by seen."""
    ok = intervals.where("not censored and seen > 0")
    w = Window.partitionBy(*CLASS)
    run = ok.withColumn("run", F.sum("seen").over(w.orderBy("days", "seen", "following").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("seen").over(w))
    return run.where(F.col("run") >= F.col("total") / 2 - 1e-12).groupBy(*CLASS).agg(F.min("days").cast("double").alias("median_days"))


def common_interval_days(days: DataFrame) -> DataFrame:
    """Lower median of the gaps between distinct days."""
    w = Window.partitionBy(*CLASS).orderBy("day")
    gaps = days.select(*CLASS, "day").distinct().withColumn("gap", F.datediff("day", F.lag("day").over(w))).where("gap is not null")
    return gaps.groupBy(*CLASS).agg(F.expr("percentile_disc(0.5) within group (order by gap)").cast("double").alias("common_days"))


def effective_gaps(visits: DataFrame, shares: DataFrame) -> DataFrame:
    """Watched time from the day after one visit to the next visit (lane, kind, day, prompted): a difference of running sums
    of the lane's daily shares."""
    by = visits.groupBy(*CLASS, "day").agg(F.bool_and("prompted").alias("prompted"))
    run = shares.withColumn("run", F.sum("share").over(Window.partitionBy("lane").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*CLASS).orderBy("day")
    at = by.join(run.select("lane", "day", "run"), ["lane", "day"])
    out = at.select(*CLASS, F.lag("day").over(w).alias("start"), F.col("day").alias("end"), (F.col("run") - F.lag("run").over(w)).alias("length"), F.col("prompted").alias("censored"))
    return out.where("start is not null")


def gap_summary(gaps: DataFrame, digits: int = 6) -> DataFrame:
    """Uncensored gap lengths of each class: their number, longest, and median (the mean of the middle two). The table of
    distinct lengths and counts adds up over parts, so old parts may be kept as that alone."""
    table = gaps.where("not censored").groupBy(*CLASS, F.round("length", digits).alias("length")).agg(F.count("*").alias("n"))
    return table.groupBy(*CLASS).agg(F.sum("n").alias("count"), F.max("length").alias("longest"), F.expr("percentile(length, 0.5, n)").alias("typical"))


def long_absences(gaps: DataFrame, min_samples: int = 3, factor: float = 2.0) -> DataFrame:
    """Each gap against the uncensored ones before it: undecided under min_samples, exceeds if longer than the longest and at
    least `factor` times their median, else within."""
    w = Window.partitionBy(*CLASS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    free = F.when(~F.col("censored"), F.col("length"))
    past = gaps.withColumns({"n": F.count(free).over(w), "longest": F.max(free).over(w)})
    # only gaps that break the record need the median of what was before
    record = past.where((F.col("n") >= min_samples) & (F.col("length") > F.col("longest"))).select(*CLASS, F.col("start").alias("at"))
    before = gaps.where("not censored").select(*CLASS, F.col("start").alias("s"), F.col("length").alias("l"))
    typical = record.join(before, CLASS).where("s < at").groupBy(*CLASS, "at").agg(F.median("l").alias("typical")).withColumnRenamed("at", "start")
    past = past.join(typical, [*CLASS, "start"], "left")
    return past.withColumn("verdict", F.when(F.col("n") < min_samples, "undecided").when(F.col("length") >= factor * F.col("typical"), "exceeds").otherwise("within"))


def ring_median(observed: DataFrame) -> DataFrame:
    """Usual minute of the day of (lane, kind, minute): the mean direction on the ring plus the lower median of offsets."""
    turn = 2 * 3.141592653589793 / 1440
    mean = observed.groupBy(*CLASS).agg(F.avg(F.sin(F.col("minute") * turn)).alias("s"), F.avg(F.cos(F.col("minute") * turn)).alias("c"))
    mean = mean.select(*CLASS, F.round(F.atan2("s", "c") / turn, 9).alias("centre"))
    d = F.pmod(F.col("minute") - F.col("centre"), F.lit(1440.0))
    off = observed.join(mean, CLASS).withColumn("off", F.when(d > 720, d - 1440).otherwise(d))
    return off.groupBy(*CLASS, "centre").agg(F.expr("percentile_disc(0.5) within group (order by off)").alias("mid")).select(*CLASS, F.pmod(F.col("centre") + F.col("mid"), F.lit(1440.0)).alias("usual_minute"))


READING = "lane long, kind string, elapsed int, first int, last int, hits int, hit_weight double, opportunities int, opened int, overdue boolean"


class History:
    """Hazard readings of one class's intervals. line: the part of intervals at risk after which a cluster isn't extended."""

    def __init__(self, days: list[int], seen: list[float], censored: list[bool], line: float):
        if not 0 < line < 1:
            raise ValueError("line must lie in (0, 1)")
        self.rows, self.line = list(zip(days, seen, censored, strict=True)), line
        self.lengths = sorted(set(days))

    def caught(self, risk: list, end: int) -> float:
        came = sum(1.0 for d, _, c in risk if d <= end and not c)
        out = sum(s for d, s, _ in risk if d > end)
        return came / (came + out) if came + out > 0 else 1.0

    def read(self, elapsed: int) -> dict | None:
        """The cluster of gap lengths that starts at elapsed."""
        if elapsed not in self.lengths:
            return None
        risk, last = [r for r in self.rows if r[0] >= elapsed], elapsed
        while last + 1 in self.lengths and self.caught(risk, last) <= self.line:
            last += 1
        inside = [r for r in self.rows if elapsed <= r[0] <= last]
        hits = [s for _, s, c in inside if not c]
        free = len(risk) - (len(inside) - len(hits))
        if not hits or free < 2:
            return None
        return {"elapsed": elapsed, "first": elapsed, "last": last, "hits": len(hits), "hit_weight": sum(hits), "opportunities": free, "overdue": False}

    def at(self, elapsed: int) -> dict | None:
        """The reading at elapsed, and the day on which the window that covers it opened."""
        found = self.read(elapsed)
        if found is None:
            return None
        day = elapsed
        while day - 1 in self.lengths:
            day -= 1
        while day < elapsed:
            earlier = self.read(day)
            if earlier and earlier["last"] >= elapsed:
                break
            day = earlier["last"] + 1 if earlier else day + 1
        return found | {"opened": min(day, elapsed)}

    def median(self) -> int | None:
        free = sorted((d, s) for d, s, c in self.rows if not c and s > 0)
        half, run = sum(s for _, s in free) / 2, 0.0
        for d, s in free:
            run += s
            if run >= half:
                return d
        return None

    def overdue(self, elapsed: int) -> dict | None:
        """Beyond what history reads: every typical interval after the second longest gap."""
        longest, typical = sorted((d for d, _, _ in self.rows), reverse=True), self.median()
        if len(longest) < 2 or elapsed <= longest[1] or typical is None or (elapsed - longest[1]) % typical:
            return None
        usual = self.read(typical)
        return usual and usual | {"elapsed": elapsed, "first": elapsed, "last": elapsed, "opened": elapsed, "overdue": True}


def readings(intervals: DataFrame, line: float = 0.67, beyond: int = 30) -> DataFrame:
    """For each class, every elapsed number of days up to `beyond` past its longest gap that has a reading."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        h = History(t["days"].tolist(), t["seen"].tolist(), t["censored"].tolist(), line)
        rows = [h.at(e) or h.overdue(e) for e in range(1, max(h.lengths) + beyond + 1)]
        out = pd.DataFrame([r for r in rows if r], columns=["elapsed", "first", "last", "hits", "hit_weight", "opportunities", "opened", "overdue"])
        out.insert(0, "lane", t["lane"].iloc[0])
        out.insert(1, "kind", t["kind"].iloc[0])
        return out

    return intervals.select(*CLASS, "days", "seen", "censored").groupBy(*CLASS).applyInPandas(run, READING)
