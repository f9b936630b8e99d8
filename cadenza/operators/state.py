"""State upkeep as tables: vocabularies and their growth, sealing of days, names, links, fields, watermarks, leases."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def padded(number: Column) -> Column:
    """A number with four digits at least, and all that it has (lpad would cut it to four)."""
    text = number.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def class_id(token: Column) -> Column:
    """The number of a class token such as s-k0007 if it is written canonically, else null; null too beyond a long."""
    n = F.regexp_extract(token, r"^([a-z])-k(\d{4,})$", 2).try_cast("long")
    return F.when(token == F.concat(F.substring(token, 1, 1), F.lit("-k"), padded(n)), n)


def promoted(pool: DataFrame, key: list[str], min_count: int = 2, min_days: int = 2) -> DataFrame:
    """Groups of a pool (key, day) with enough members on enough distinct days."""
    by = pool.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))
    return by.where((F.col("n") >= min_count) & (F.col("days") >= min_days))


def anchors(members: DataFrame, key: list[str], order: list, n: int = 8) -> DataFrame:
    """The latest members of each class."""
    w = Window.partitionBy(*key).orderBy(*order)
    return members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def sealed(rows: DataFrame, horizon: Column) -> DataFrame:
    """Rows strictly before the horizon."""
    return rows.where(F.col("start_us") < horizon)


def closed_days(spine: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Days (lane, day) without a row that isn't sealed yet."""
    return spine.join(open_rows.select("lane", "day").distinct(), ["lane", "day"], "left_anti")


def claimed_names(rows: DataFrame, address: list[str], order: list) -> DataFrame:
    """Each address goes to the first that claims it; later ones get a numbered suffix and keep what they asked for."""
    n = F.row_number().over(Window.partitionBy(*address).orderBy(*order))
    return rows.withColumn("claim", n).withColumns({"given": F.when(F.col("claim") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), F.col("claim").cast("string"))), "original_name": F.when(F.col("claim") > 1, F.col("name"))}).drop("claim")


def contiguous_through(done: DataFrame, key: list[str]) -> DataFrame:
    """Per key: the last sequence number up to which all from the first are there, and how many lie beyond."""
    w = Window.partitionBy(*key)
    r = done.select(*key, "seq").distinct().withColumns({"i": F.row_number().over(w.orderBy("seq")) - 1, "first": F.min("seq").over(w)})
    ok = F.col("seq") - F.col("first") == F.col("i")
    return r.groupBy(*key).agg(F.max(F.when(ok, F.col("seq"))).alias("through"), F.count(F.when(~ok, 1)).alias("beyond"))


def released_through(marks: DataFrame, key: list[str]) -> DataFrame:
    """One monotone mark per key, and how many marks would have set it back."""
    w = Window.partitionBy(*key).orderBy("seq")
    back = F.col("mark") < F.max("mark").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marks.withColumn("back", back).groupBy(*key).agg(F.max("mark").alias("released"), F.count(F.when(F.col("back"), 1)).alias("rejected"))


def ready_in_order(items: DataFrame, key: list[str]) -> DataFrame:
    """Items (key, seq, committed) that may be delivered: all before them are committed, they aren't."""
    before = F.min(F.col("committed").cast("int")).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("before", F.coalesce(before, F.lit(1))).where((F.col("before") == 1) & ~F.col("committed")).drop("before")


def backoff(attempt: Column, base: float = 2.0, cap: float = 300.0) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def identity_plan(held: DataFrame, extracted: DataFrame) -> DataFrame:
    """For each id of either side (id, digest): create, update, noop, or keep what wasn't extracted."""
    b = held.select("id", F.col("digest").alias("h")).join(extracted.select("id", F.col("digest").alias("e")), "id", "full_outer")
    op = F.when(F.col("e").isNull(), "keep").when(F.col("h").isNull(), "create").when(F.col("h") == F.col("e"), "noop").otherwise("update")
    return b.select("id", op.alias("op"))


def remapped_links(links: DataFrame, merged: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links (a, b, kind) with ends moved along merges (id, into); links of deleted ends, to themselves, and doubles go."""
    m = merged.select(F.col("id"), F.col("into"))
    for end in ("a", "b"):
        links = links.join(m.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        links = links.join(deleted.select(F.col("id").alias(end)), end, "left_anti")
    return links.where("a <> b").select("a", "b", "kind").distinct()


def reciprocal(links: DataFrame) -> DataFrame:
    """Links whose counterpart is there too."""
    return links.alias("x").join(links.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.kind") == F.col("y.kind")), "left_semi")


def patched(current: DataFrame, incoming: DataFrame, patch: list[str], replace: list[str]) -> DataFrame:
    """Fields of current (id, ...) after incoming: patch fields keep what incoming leaves null, replace fields take all."""
    i = incoming.select("id", F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in [*patch, *replace]])
    j = current.join(i, "id", "left")
    done = {c: F.coalesce(f"__{c}", c) for c in patch} | {c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) for c in replace}
    return j.select("id", *[done.get(c, F.col(c)).alias(c) for c in current.columns if c != "id"])


def leases(requests: DataFrame, held: DataFrame, now_us: int, lease_us: int, limit: int, attempts: int = 3) -> DataFrame:
    """Open requests (id, deadline_us, tries) to claim now: by deadline, without those leased by others, tried out or late."""
    taken = held.where(F.col("until_us") > now_us).select("id")
    free = requests.where((F.col("deadline_us") > now_us) & (F.col("tries") < attempts)).join(taken, "id", "left_anti")
    return free.orderBy("deadline_us", "id").limit(limit).withColumn("until_us", F.least(F.lit(now_us + lease_us), F.col("deadline_us")))


@pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks; null where it doesn't parse or holds a non-finite number."""

    def one(x):
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


def closure(edges: DataFrame, most: int = 32) -> DataFrame:
    """All ancestors of each node of an acyclic graph (child, parent), itself included. One join a level; checkpoints aren't
    needed for the few levels of a concept graph."""
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    reach, frontier = nodes.select("child", F.col("child").alias("parent")), edges.distinct()
    for _ in range(most):
        if not frontier.limit(1).count():
            return reach.distinct()
        reach = reach.union(frontier)
        frontier = frontier.select("child", F.col("parent").alias("mid")).join(edges.select(F.col("child").alias("mid"), "parent"), "mid").select("child", "parent").distinct()
    raise ValueError("the graph has a cycle or is too deep")


def value_sets(raised: DataFrame, by: list[str]) -> DataFrame:
    """Single values of one dimension (by, dimension, value) that hold, as one set where there are two or more."""
    s = raised.groupBy(*by, "dimension").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return s.where(F.size("values") >= 2)


def revisable(classes: DataFrame, today: Column, cooling: int, cap: int) -> DataFrame:
    """Classes (class_id, touched, changed, n) that may be split or merged now: none that changed already or was touched within
    the cooling time; the largest first, as many as the cap."""
    ok = classes.where(~F.col("changed") & (F.datediff(today, F.col("touched")) >= cooling))
    return ok.orderBy(F.col("n").desc(), "class_id").limit(cap)
