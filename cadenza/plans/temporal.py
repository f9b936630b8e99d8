"""Queries over the event series, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.clock import absolute_slot, slot_of
from cadenza.operators import temporal as T
from cadenza.sources import series as S

CUTOFF = "2024-01-28"
LAST = "2024-01-30"


def _eps(spark, d):
    return T.episodes(S.records(spark, d))


def _days(spark, d):
    return T.occurrence_days(_eps(spark, d))


def _pieces(spark, d):
    return T.standing_pieces(S.gaps(spark, d), S.records(spark, d))


def _shares(spark, d):
    spine = T.lane_days(S.records(spark, d), F.lit(LAST).cast("date"))
    return T.day_shares(spine, T.missed_slots(_pieces(spark, d)))


def _round(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def read_series(spark, d):
    return S.records(spark, d, CUTOFF).drop("day")


def skip_reasons(spark, d):
    return S.events(spark, d).where("skip_reason is not null").groupBy(F.col("day").cast("string").alias("day"), "skip_reason").agg(F.count("*").alias("n"))


def class_records(spark, d):
    return S.records(spark, d).where("lane = 8 and kind = 'view'").select("uri", "start_us")


def truncated_series(spark, d):
    return S.records(spark, d, "2024-01-15").groupBy("lane").agg(F.count("*").alias("n"), F.max("start_us").alias("last_us"))


def active_days(spark, d):
    return S.events(spark, d).select("lane", F.col("day").cast("string").alias("day")).distinct()


def gap_day_pieces(spark, d):
    return T.day_pieces(S.gaps(spark, d)).select("uri", F.col("day").cast("string").alias("day"), "piece_begin", "piece_end")


def gap_standing_pieces(spark, d):
    return _pieces(spark, d).select("uri", F.col("day").cast("string").alias("day"), "piece_begin", "piece_end")


def clock_slots(spark, d):
    r = S.records(spark, d)
    return r.select("uri", slot_of(F.col("start_us")).alias("slot"), absolute_slot(F.col("start_us")).alias("abs_slot"), slot_of(F.col("start_us"), 60).alias("hour_slot"))


def merged_starts(spark, d):
    return T.merge_starts(S.records(spark, d)).select("uri", "episode")


def class_episodes(spark, d):
    return _eps(spark, d).drop("day", "episode")


def class_occurrence_days(spark, d):
    return _days(spark, d).withColumn("day", F.col("day").cast("string"))


def class_blind_days(spark, d):
    return T.blind_days(_days(spark, d)).withColumn("day", F.col("day").cast("string"))


def lane_gap_union(spark, d):
    return T.gap_union(_pieces(spark, d)).withColumn("day", F.col("day").cast("string"))


def slot_coverage(spark, d):
    return _round(T.missed_slots(_pieces(spark, d)), "missed").withColumn("day", F.col("day").cast("string"))


def lane_day_shares(spark, d):
    return _round(_shares(spark, d), "share").withColumn("day", F.col("day").cast("string"))


def watched_days(spark, d):
    s = _shares(spark, d).where("day >= date'2024-01-10'")
    return _round(s.groupBy("lane").agg(F.sum("share").alias("watched")), "watched", digits=9)


def class_density(spark, d):
    return _round(T.density(_days(spark, d), _shares(spark, d)), "watched", "days_per_occurrence", "occurrence_day_share", digits=9)


def _profile(spark, d):
    return T.day_profile(_eps(spark, d), T.missed_slots(_pieces(spark, d)), F.lit(LAST).cast("date"))


def class_day_profile(spark, d):
    return _round(_profile(spark, d), "share", digits=9)


def class_peaks(spark, d):
    """Peaks of a class's profile that two of its recent days or more started in."""
    return _round(T.peaks(_profile(spark, d), days=T.profile_days(_eps(spark, d))), "share", digits=9).select("lane", "kind", "first_slot", "last_slot", "share", "days")


def _intervals(spark, d):
    days, shares = _days(spark, d), _shares(spark, d)
    return T.day_intervals(days, shares, T.density(days, shares), _profile(spark, d), T.missed_slots(_pieces(spark, d)))


def class_day_intervals(spark, d):
    return _round(_intervals(spark, d), "seen", digits=9).withColumns({c: F.col(c).cast("string") for c in ("previous", "following")})


def class_median_days(spark, d):
    return T.median_days(_round(_intervals(spark, d), "seen", digits=9))


def class_common_interval(spark, d):
    return T.common_interval_days(_days(spark, d))


def _order_gaps(spark, d):
    v = S.table(spark, d, "orders").select(F.col("o_custkey").alias("lane"), F.lit("visit").alias("kind"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "P").alias("prompted"))
    w = T.Window.partitionBy("lane").orderBy("day")
    by = v.groupBy("lane", "kind", "day").agg(F.bool_and("prompted").alias("prompted"))
    return by.select("lane", "kind", F.lag("day").over(w).alias("start"), F.col("day").alias("end"), F.datediff("day", F.lag("day").over(w)).cast("double").alias("length"), F.col("prompted").alias("censored")).where("start is not null")


def effective_gaps(spark, d):
    v = _days(spark, d).select("lane", "kind", "day", (F.col("natural") == 0).alias("prompted"))
    return _round(T.effective_gaps(v, _shares(spark, d)), "length", digits=9).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


def visit_gap_summary(spark, d):
    return T.gap_summary(_order_gaps(spark, d)).drop("kind")


def visit_long_absences(spark, d):
    return T.long_absences(_order_gaps(spark, d)).groupBy("lane", "verdict").agg(F.count("*").alias("n"), F.sum("length").alias("days"))


def usual_minute(spark, d):
    e = _eps(spark, d).where("natural").select("lane", "kind", (F.floor(F.col("start_us") / 60_000_000) % 1440).alias("minute"))
    return _round(T.ring_median(e), "usual_minute", digits=9)


def class_hazard_readings(spark, d):
    return T.readings(_intervals(spark, d))


def kind_rhythm_report(spark, d):
    days, shares = _days(spark, d), _shares(spark, d)
    n = days.groupBy("lane", "kind").agg(F.count("*").alias("n_days"), F.sum("count").alias("n_episodes"), F.sum("natural").alias("n_natural"))
    dens = T.density(days, shares).select("lane", "kind", F.round("days_per_occurrence", 9).alias("days_per_occurrence"))
    return n.join(dens, ["lane", "kind"], "left").join(T.common_interval_days(days), ["lane", "kind"], "left")


def baseline_drift(spark, d):
    """Usual start of each class over all history and over the last 14 days, and whether it moved by an hour or more."""
    e = _eps(spark, d).where("natural").select("lane", "kind", "day", (F.floor(F.col("start_us") / 60_000_000) % 1440).alias("minute"))
    late = e.where("day > date'2024-01-16'")
    enough = lambda x: x.join(x.groupBy("lane", "kind").agg(F.count_distinct("day").alias("n")).where("n >= 3").drop("n"), ["lane", "kind"], "left_semi")
    a, b = T.ring_median(enough(e)).withColumnRenamed("usual_minute", "usual"), T.ring_median(enough(late)).withColumnRenamed("usual_minute", "recent")
    out = a.join(b, ["lane", "kind"])
    off = F.pmod(F.col("recent") - F.col("usual"), F.lit(1440.0))
    return out.withColumn("drifted", F.abs(F.round(F.when(off > 720, off - 1440).otherwise(off), 3)) >= 60).select("lane", "kind", F.round("usual", 9).alias("usual"), F.round("recent", 9).alias("recent"), "drifted")


def baseline_durations(spark, d):
    """Usual minutes of each class over all history and over the last 14 days (medians of three episodes or more), and whether they
    moved by an hour or more."""
    e = _eps(spark, d).where("natural").select("lane", "kind", "day", ((F.col("last_us") - F.col("start_us")) / 60_000_000).alias("minutes"))
    late = F.when(F.col("day") > F.lit("2024-01-16").cast("date"), F.col("minutes"))
    out = e.groupBy("lane", "kind").agg(F.count("*").alias("n"), F.median("minutes").alias("usual"), F.count(late).alias("n_recent"), F.median(late).alias("recent")).where("n >= 3 and n_recent >= 3")
    return out.select("lane", "kind", F.round("usual", 6).alias("usual"), F.round("recent", 6).alias("recent"), (F.abs(F.round(F.col("recent") - F.col("usual"), 6)) >= 60).alias("drifted"))


def calendar_conditions(spark, d):
    day = F.col("day")
    days = S.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        day.cast("string").alias("day"), (F.weekday(day) + 1).alias("weekday"), F.dayofmonth(day).alias("day_of_month"), (day == F.last_day(day)).alias("month_end"),
        F.when(F.weekday(day) >= 5, "weekend").otherwise("workday").alias("nominal_type"), F.when(F.year(day) >= 1997, F.when(F.weekday(day) >= 5, "weekend").otherwise("workday")).alias("day_type"),
    )




DAYS_SQL = """
st AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER c <= 2700000000 THEN 0 ELSE 1 END AS new FROM rec WINDOW c AS (PARTITION BY lane, kind ORDER BY start_us, uri)),
ms AS (SELECT *, CAST(sum(new) OVER (PARTITION BY lane, kind ORDER BY start_us, uri) AS BIGINT) AS episode FROM st),
eps AS (SELECT lane, kind, episode, min(start_us) AS start_us, max(last_us) AS last_us, count(*) AS n_records, arg_min(uri, (start_us, uri)) AS first_uri, NOT arg_min(reminded, (start_us, uri)) AS "natural",
  CAST(make_timestamp(min(start_us)) AS DATE) AS day FROM ms GROUP BY lane, kind, episode),
days AS (SELECT lane, kind, day, arg_min(first_uri, (start_us, first_uri)) AS first_uri, min(start_us) AS first_us, count(*) AS count, CAST(sum("natural"::INT) AS BIGINT) AS "natural",
  arg_min(first_uri, (start_us, first_uri)) FILTER (WHERE "natural") AS natural_uri, min(start_us) FILTER (WHERE "natural") AS natural_us FROM eps GROUP BY lane, kind, day)
"""
PIECES_SQL = """
dp AS (SELECT uri, lane, voidable, begin_us, end_us, unnest(range(begin_us // 86400000000, (greatest(end_us, begin_us + 1) - 1) // 86400000000 + 1)) AS dn FROM gap),
pc AS (SELECT uri, lane, voidable, CAST(DATE '1970-01-01' + CAST(dn AS INT) AS DATE) AS day, greatest(begin_us, dn * 86400000000) AS piece_begin, greatest(begin_us, least(end_us, (dn + 1) * 86400000000)) AS piece_end, dn FROM dp),
sp AS (SELECT * FROM pc WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.lane = pc.lane AND r.day = pc.day AND pc.voidable AND r.start_us >= pc.piece_begin AND r.start_us < pc.piece_end)),
un0 AS (SELECT *, CASE WHEN piece_begin <= max(piece_end) OVER (PARTITION BY lane, day ORDER BY piece_begin, piece_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp WHERE piece_end > piece_begin),
un1 AS (SELECT *, sum(new) OVER (PARTITION BY lane, day ORDER BY piece_begin, piece_end ROWS UNBOUNDED PRECEDING) AS span FROM un0),
un AS (SELECT lane, day, min(dn) AS dn, min(piece_begin) AS begin_us, max(piece_end) AS end_us FROM un1 GROUP BY lane, day, span),
sl AS (SELECT lane, day, dn, begin_us, end_us, unnest(range((begin_us - dn * 86400000000) // 900000000, least((end_us - 1 - dn * 86400000000) // 900000000, 95) + 1)) AS slot FROM un),
missed AS (SELECT lane, day, CAST(slot AS INT) AS slot, least(sum(least(end_us, dn * 86400000000 + (slot + 1) * 900000000) - greatest(begin_us, dn * 86400000000 + slot * 900000000)) / 900000000.0, 1.0) AS missed FROM sl GROUP BY lane, day, slot),
spine AS (SELECT lane, CAST(unnest(generate_series(min(day), DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM rec GROUP BY lane HAVING min(day) <= DATE '2024-01-30'),
shares AS (SELECT s.lane, s.day, 1 - coalesce(m, 0.0) / 96 AS share FROM spine s LEFT JOIN (SELECT lane, day, sum(missed) AS m FROM missed GROUP BY lane, day) x ON s.lane = x.lane AND s.day = x.day)
"""
DENSITY_SQL = """
nat AS (SELECT lane, kind, min(day) AS since, CAST(sum("natural") AS BIGINT) AS occurrences, count(*) AS occurrence_days FROM
  (SELECT *, row_number() OVER (PARTITION BY lane, kind ORDER BY day DESC) AS r FROM days WHERE "natural" > 0) WHERE r <= 20 GROUP BY lane, kind),
wat AS (SELECT n.lane, n.kind, sum(share) AS watched FROM nat n JOIN shares s ON s.lane = n.lane AND s.day >= n.since
  WHERE NOT EXISTS (SELECT 1 FROM days b WHERE b."natural" = 0 AND b.lane = n.lane AND b.kind = n.kind AND b.day = s.day) GROUP BY n.lane, n.kind),
dens AS (SELECT n.lane, n.kind, occurrences, occurrence_days, watched, watched / occurrences AS days_per_occurrence, least(occurrence_days / watched, 1.0) AS occurrence_day_share
  FROM nat n JOIN wat w ON n.lane = w.lane AND n.kind = w.kind WHERE watched > 0)
"""
#: seen: the product, over watched days between, of 1 - min(share of days * sum over slots of profile * (1 - watched), 1), with a
#: flat profile of 1/96 a slot for a class that has none.
INTERVALS_SQL = """
iv0 AS (SELECT lane, kind, lag(day) OVER (PARTITION BY lane, kind ORDER BY day) AS previous, day AS following, "natural" = 0 AS censored FROM days),
un9 AS (SELECT c.lane, c.kind, m.day, sum(coalesce(p.share, CASE WHEN h.lane IS NULL THEN 1.0 / 96 ELSE 0 END) * m.missed) AS away FROM (SELECT DISTINCT lane, kind FROM days) c JOIN missed m ON m.lane = c.lane JOIN shares s ON s.lane = m.lane AND s.day = m.day
  LEFT JOIN (SELECT DISTINCT lane, kind FROM prof) h ON h.lane = c.lane AND h.kind = c.kind LEFT JOIN prof p ON p.lane = c.lane AND p.kind = c.kind AND p.slot = m.slot GROUP BY 1, 2, 3),
iv AS (SELECT i.lane, i.kind, previous, following, censored, date_diff('day', previous, following) AS days,
  coalesce((SELECT product(1 - least(coalesce(d.occurrence_day_share, 1.0) * u.away, 1.0)) FROM un9 u WHERE u.lane = i.lane AND u.kind = i.kind AND u.day > i.previous AND u.day < i.following), 1.0) AS seen
  FROM iv0 i LEFT JOIN dens d ON d.lane = i.lane AND d.kind = i.kind WHERE previous IS NOT NULL)
"""
PROFILE_SQL = """
on0 AS (SELECT DISTINCT lane, kind, day, CAST((start_us % 86400000000) // 900000000 AS INT) AS slot FROM eps WHERE "natural"),
on2 AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY lane, kind ORDER BY day DESC) AS r FROM on0) WHERE r <= 30),
on1 AS (SELECT * FROM on2 WHERE day <= DATE '2024-01-30'),
nd AS (SELECT lane, kind, count(DISTINCT day)::DOUBLE AS n_days FROM on1 GROUP BY lane, kind),
tp AS (SELECT lane, kind, slot, count(*)::DOUBLE AS top FROM on1 GROUP BY lane, kind, slot),
ls AS (SELECT o.lane, o.kind, m.slot, sum(missed) AS lost FROM (SELECT DISTINCT lane, kind, day FROM on1) o JOIN missed m ON m.lane = o.lane AND m.day = o.day GROUP BY o.lane, o.kind, m.slot),
gr AS (SELECT nd.lane, nd.kind, g.slot, coalesce(top, 0.0) AS top, n_days - coalesce(lost, 0.0) AS bottom FROM nd CROSS JOIN (SELECT unnest(range(96))::INT AS slot) g
  LEFT JOIN tp ON tp.lane = nd.lane AND tp.kind = nd.kind AND tp.slot = g.slot LEFT JOIN ls ON ls.lane = nd.lane AND ls.kind = nd.kind AND ls.slot = g.slot),
al AS (SELECT lane, kind, sum(top) / sum(bottom) AS whole FROM gr GROUP BY lane, kind HAVING sum(bottom) > 0 AND sum(top) > 0),
po AS (SELECT a.lane, a.kind, a.slot, any_value(a.top) AS top, any_value(a.bottom) AS bottom, sum(b.top) AS pt, sum(b.bottom) AS pb FROM gr a JOIN gr b ON a.lane = b.lane AND a.kind = b.kind
  AND ((b.slot - a.slot + 96 + 3) % 96) <= 6 GROUP BY a.lane, a.kind, a.slot),
rt AS (SELECT p.lane, p.kind, slot, least(greatest((top + 4.0 * ((pt + 4.0 * whole) / (pb + 4.0))) / (bottom + 4.0), 0.0), 1.0) AS rate FROM po p JOIN al ON al.lane = p.lane AND al.kind = p.kind),
prof AS (SELECT lane, kind, slot, rate / sum(rate) OVER (PARTITION BY lane, kind) AS share FROM rt)
"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([S.SQL.strip(), *[p.strip() for p in parts]]) + " "


GAPS = "og AS (SELECT * FROM (SELECT lane, lag(day) OVER (PARTITION BY lane ORDER BY day) AS start, day AS \"end\", date_diff('day', lag(day) OVER (PARTITION BY lane ORDER BY day), day)::DOUBLE AS length, prompted AS censored FROM (SELECT o_custkey AS lane, CAST(o_orderdate AS DATE) AS day, bool_and(o_orderstatus = 'P') AS prompted FROM orders GROUP BY 1, 2)) WHERE start IS NOT NULL)"
RING = """
{0}m AS (SELECT lane, kind, round(atan2(avg(sin(minute * (2 * pi() / 1440))), avg(cos(minute * (2 * pi() / 1440)))) / (2 * pi() / 1440), 9) AS centre FROM {0} GROUP BY lane, kind),
{0}o AS (SELECT e.lane, e.kind, centre, CASE WHEN ((minute - centre) % 1440 + 1440) % 1440 > 720 THEN ((minute - centre) % 1440 + 1440) % 1440 - 1440 ELSE ((minute - centre) % 1440 + 1440) % 1440 END AS off FROM {0} e JOIN {0}m m ON e.lane = m.lane AND e.kind = m.kind),
{0}r AS (SELECT lane, kind, ((centre + quantile_disc(off, 0.5)) % 1440 + 1440) % 1440 AS usual FROM {0}o GROUP BY lane, kind, centre)"""
MINUTES = "SELECT lane, kind, day, (start_us // 60000000) % 1440 AS minute FROM eps WHERE \"natural\""

SQL = {
    "read_series": _with() + f"SELECT uri, lane, kind, start_us, last_us, k, reminded FROM rec WHERE day < DATE '{CUTOFF}'",
    "skip_reasons": _with() + "SELECT CAST(day AS VARCHAR) AS day, skip_reason, count(*) AS n FROM ev WHERE skip_reason IS NOT NULL GROUP BY day, skip_reason",
    "class_records": _with() + "SELECT uri, start_us FROM rec WHERE lane = 8 AND kind = 'view'",
    "truncated_series": _with() + "SELECT lane, count(*) AS n, max(start_us) AS last_us FROM rec WHERE day < DATE '2024-01-15' GROUP BY lane",
    "active_days": _with() + "SELECT DISTINCT lane, CAST(day AS VARCHAR) AS day FROM ev",
    "gap_day_pieces": _with(PIECES_SQL) + "SELECT uri, CAST(day AS VARCHAR) AS day, piece_begin, piece_end FROM pc",
    "gap_standing_pieces": _with(PIECES_SQL) + "SELECT uri, CAST(day AS VARCHAR) AS day, piece_begin, piece_end FROM sp",
    "clock_slots": _with() + "SELECT uri, CAST((start_us % 86400000000) // 900000000 AS INT) AS slot, start_us // 86400000000 * 96 + (start_us % 86400000000) // 900000000 AS abs_slot, CAST((start_us % 86400000000) // 3600000000 AS INT) AS hour_slot FROM rec",
    "merged_starts": _with(DAYS_SQL) + "SELECT uri, episode FROM ms",
    "class_episodes": _with(DAYS_SQL) + "SELECT lane, kind, start_us, last_us, n_records, first_uri, \"natural\" FROM eps",
    "class_occurrence_days": _with(DAYS_SQL) + "SELECT lane, kind, CAST(day AS VARCHAR) AS day, first_uri, first_us, count, \"natural\", natural_uri, natural_us FROM days",
    "class_blind_days": _with(DAYS_SQL) + "SELECT lane, kind, CAST(day AS VARCHAR) AS day FROM days WHERE \"natural\" = 0",
    "lane_gap_union": _with(PIECES_SQL) + "SELECT lane, CAST(day AS VARCHAR) AS day, begin_us, end_us FROM un",
    "slot_coverage": _with(PIECES_SQL) + "SELECT lane, CAST(day AS VARCHAR) AS day, slot, round(missed, 9) AS missed FROM missed",
    "lane_day_shares": _with(PIECES_SQL) + "SELECT lane, CAST(day AS VARCHAR) AS day, round(share, 9) AS share FROM shares",
    "watched_days": _with(PIECES_SQL) + "SELECT lane, round(sum(share), 9) AS watched FROM shares WHERE day >= DATE '2024-01-10' GROUP BY lane",
    "class_density": _with(DAYS_SQL, PIECES_SQL, DENSITY_SQL) + "SELECT lane, kind, occurrences, occurrence_days, round(watched, 9) AS watched, round(days_per_occurrence, 9) AS days_per_occurrence, round(occurrence_day_share, 9) AS occurrence_day_share FROM dens",
    "class_day_profile": _with(DAYS_SQL, PIECES_SQL, PROFILE_SQL) + "SELECT lane, kind, slot, round(share, 9) AS share FROM prof",
    "class_peaks": _with(DAYS_SQL, PIECES_SQL, PROFILE_SQL)
    + """, tw AS (SELECT lane, kind, slot + turn * 96 AS pos, share, share > 1.0 / 96 AS above FROM prof, (SELECT unnest([0, 1]) AS turn)),
bg AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY lane, kind ORDER BY pos), false) AS begins FROM tw),
ru AS (SELECT *, sum(begins::INT) OVER (PARTITION BY lane, kind ORDER BY pos) AS run FROM bg),
pk AS (SELECT lane, kind, CAST(min(pos) AS INT) AS first_slot, CAST(max(pos) AS INT) AS last_slot, sum(share) AS share FROM ru WHERE above GROUP BY lane, kind, run)
SELECT p.lane, p.kind, first_slot, last_slot, round(share, 9) AS share, days FROM (SELECT pk.lane, pk.kind, first_slot, last_slot, share, count(DISTINCT o.day) AS days FROM pk JOIN on2 o ON o.lane = pk.lane AND o.kind = pk.kind AND (o.slot - first_slot + 96) % 96 <= last_slot - first_slot GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT o.day) >= 2) p JOIN (SELECT lane, kind, bool_or(slot = 95 AND share > 1.0 / 96) AS wraps, bool_and(share > 1.0 / 96) AS whole FROM prof GROUP BY lane, kind) w
  ON p.lane = w.lane AND p.kind = w.kind WHERE first_slot < 96 AND NOT (first_slot = 0 AND wraps) AND NOT whole AND share >= 0.1""",
    "class_day_intervals": _with(DAYS_SQL, PIECES_SQL, DENSITY_SQL, PROFILE_SQL, INTERVALS_SQL) + "SELECT lane, kind, CAST(previous AS VARCHAR) AS previous, CAST(following AS VARCHAR) AS following, CAST(days AS INT) AS days, round(seen, 9) AS seen, censored FROM iv",
    "class_median_days": _with(DAYS_SQL, PIECES_SQL, DENSITY_SQL, PROFILE_SQL, INTERVALS_SQL)
    + """, ok AS (SELECT lane, kind, days, round(seen, 9) AS seen, following FROM iv WHERE NOT censored AND round(seen, 9) > 0),
rn AS (SELECT *, sum(seen) OVER (PARTITION BY lane, kind ORDER BY days, seen, following ROWS UNBOUNDED PRECEDING) AS run, sum(seen) OVER (PARTITION BY lane, kind) AS total FROM ok)
SELECT lane, kind, min(days)::DOUBLE AS median_days FROM rn WHERE run >= total / 2 - 1e-12 GROUP BY lane, kind""",
    "class_common_interval": _with(DAYS_SQL) + "SELECT lane, kind, quantile_disc(gap, 0.5)::DOUBLE AS common_days FROM (SELECT lane, kind, date_diff('day', lag(day) OVER (PARTITION BY lane, kind ORDER BY day), day) AS gap FROM days) WHERE gap IS NOT NULL GROUP BY lane, kind",
    "effective_gaps": _with(DAYS_SQL, PIECES_SQL)
    + """SELECT * FROM (SELECT lane, kind, CAST(start AS VARCHAR) AS start, CAST(day AS VARCHAR) AS "end", round((SELECT sum(share) FROM shares s WHERE s.lane = x.lane AND s.day > x.start AND s.day <= x.day), 9) AS length, \"natural\" = 0 AS censored
FROM (SELECT *, lag(day) OVER (PARTITION BY lane, kind ORDER BY day) AS start FROM days) x) WHERE start IS NOT NULL""",
    "visit_gap_summary": f"WITH {GAPS} SELECT lane, count(*) AS count, max(length) AS longest, median(length) AS typical FROM og WHERE NOT censored GROUP BY lane",
    "visit_long_absences": f"""WITH {GAPS}, h AS (SELECT *, count(CASE WHEN NOT censored THEN length END) OVER w AS n, max(CASE WHEN NOT censored THEN length END) OVER w AS longest, median(CASE WHEN NOT censored THEN length END) OVER w AS typical FROM og
WINDOW w AS (PARTITION BY lane ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT lane, CASE WHEN n < 3 THEN 'undecided' WHEN length > longest AND length >= 2 * typical THEN 'exceeds' ELSE 'within' END AS verdict, count(*) AS n, sum(length) AS days FROM h GROUP BY 1, 2""",
    "usual_minute": _with(DAYS_SQL, f"mi AS ({MINUTES})", RING.format("mi")) + "SELECT lane, kind, round(usual, 9) AS usual_minute FROM mir",
    "baseline_drift": _with(DAYS_SQL, f"mi0 AS ({MINUTES})", "mi AS (SELECT * FROM mi0 WHERE (lane, kind) IN (SELECT (lane, kind) FROM mi0 GROUP BY lane, kind HAVING count(DISTINCT day) >= 3))", "la0 AS (SELECT * FROM mi0 WHERE day > DATE '2024-01-16')", "la AS (SELECT * FROM la0 WHERE (lane, kind) IN (SELECT (lane, kind) FROM la0 GROUP BY lane, kind HAVING count(DISTINCT day) >= 3))", RING.format("mi"), RING.format("la"))
    + "SELECT a.lane, a.kind, round(a.usual, 9) AS usual, round(b.usual, 9) AS recent, abs(round(CASE WHEN ((b.usual - a.usual) % 1440 + 1440) % 1440 > 720 THEN ((b.usual - a.usual) % 1440 + 1440) % 1440 - 1440 ELSE ((b.usual - a.usual) % 1440 + 1440) % 1440 END, 3)) >= 60 AS drifted FROM mir a JOIN lar b ON a.lane = b.lane AND a.kind = b.kind",
    "baseline_durations": _with(DAYS_SQL, "du AS (SELECT lane, kind, day, (last_us - start_us) / 60000000.0 AS m FROM eps WHERE \"natural\")", "dm AS (SELECT lane, kind, median(m) AS usual, median(CASE WHEN day > DATE '2024-01-16' THEN m END) AS recent FROM du GROUP BY 1, 2 HAVING count(*) >= 3 AND count(CASE WHEN day > DATE '2024-01-16' THEN 1 END) >= 3)")
    + "SELECT lane, kind, round(usual, 6) AS usual, round(recent, 6) AS recent, abs(round(recent - usual, 6)) >= 60 AS drifted FROM dm",
    "kind_rhythm_report": _with(DAYS_SQL, PIECES_SQL, DENSITY_SQL)
    + """SELECT n.lane, n.kind, n_days, n_episodes, n_natural, round(days_per_occurrence, 9) AS days_per_occurrence, common_days FROM
(SELECT lane, kind, count(*) AS n_days, CAST(sum(count) AS BIGINT) AS n_episodes, CAST(sum("natural") AS BIGINT) AS n_natural FROM days GROUP BY lane, kind) n LEFT JOIN dens d ON d.lane = n.lane AND d.kind = n.kind
LEFT JOIN (SELECT lane, kind, quantile_disc(gap, 0.5)::DOUBLE AS common_days FROM (SELECT lane, kind, date_diff('day', lag(day) OVER (PARTITION BY lane, kind ORDER BY day), day) AS gap FROM days) WHERE gap IS NOT NULL GROUP BY lane, kind) c ON c.lane = n.lane AND c.kind = n.kind""",
    "calendar_conditions": """SELECT DISTINCT CAST(d AS VARCHAR) AS day, CAST(isodow(d) AS INT) AS weekday, CAST(day(d) AS INT) AS day_of_month, d = last_day(d) AS month_end, CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'workday' END AS nominal_type,
CASE WHEN year(d) >= 1997 THEN CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'workday' END END AS day_type FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
}
QUERIES = {n: globals()[n] for n in SQL} | {"class_hazard_readings": class_hazard_readings}
