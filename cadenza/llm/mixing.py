"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its documents: a whole part, and a fraction
that pivotal rounding turns into 0 or 1. Two documents with fractions meet; mass (in words, so that the source's total stays
put) moves from one to the other in a random direction, by chances that keep each one's expectation, until one is at 0 or 1.
Buckets of a source do so apart, each leaving one document with a fraction at most; those meet in fewer buckets, level by
level, as a reduction tree. The last fraction of a source is settled by taking that part of its words.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import SPACES, WORD, documents, saved, table

WEIGHTS = (3, 1, 2)
FANIN = 512


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, place (its rank by code point, null last) and target of each source of docs (source, size).

    Weights repeat over the ranks. The total target is share * all sizes; where a weight's share is over most * its source's
    size it stops there and the rest is shared by weight: all others get level * weight, with the level read off the sources
    in the order in which a rising level meets their limits. Works on one row a source."""
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by = by.withColumn("place", place).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    meets = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, whole = meets.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    after = meets.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after)).withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("limit") / F.col("weight")).alias("m"), "place", "level"))).over(whole)
    by = by.withColumn("first", first)
    capped = F.col("first").isNull() | (F.struct((F.col("limit") / F.col("weight")).alias("m"), "place") < F.struct(F.col("first.m"), F.col("first.place")))
    return by.select("source", "source_size", "n", "place", F.when(capped, F.col("limit")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def pivotal(sizes: list[int], parts: list[float], rng: random.Random) -> list[float]:
    """Chances after meeting in turn: all 0.0 or 1.0 but one at most; sum of size * chance is kept but for rounding."""
    out, held = list(parts), None
    for i, p in enumerate(parts):
        if not 0.0 < p < 1.0:
            continue
        if sizes[i] == 0:
            out[i] = float(rng.random() < p)
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        wa, wb = sizes[a], sizes[b]
        up = min((1.0 - out[a]) * wa, out[b] * wb)  # words that can move to a
        down = min(out[a] * wa, (1.0 - out[b]) * wb)
        move = up if rng.random() * (up + down) < down else -down
        pa_, pb = out[a] + move / wa, out[b] - move / wb
        for k, x in ((a, pa_), (b, pb)):
            out[k] = 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
        held = a if 0.0 < out[a] < 1.0 else b if 0.0 < out[b] < 1.0 else None
    return out


#: Rows of one kind (equal in all that the mix looks at) that are written out by one task.
SAME = 10_000


def _plan(docs: DataFrame, seed: int, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """For each kind of row (doc_id, source, row_key, size): m, its rows, source_size and target of its source, and copies: how many
    whole copies the mix takes of all its rows, a part counted as a part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = documents(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", F.xxhash64("doc_id", text, F.lit(seed)).alias("row_key"), size.alias("size"))
    kinds = saved(rows.groupBy("doc_id", "source", "row_key", "size").agg(F.count(F.lit(1)).alias("m")))
    goals = targets(kinds.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most)
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    goals = saved(goals.withColumn("copies", copies).withColumn("buckets", F.ceil(F.col("n") / FANIN).cast("long")))
    wide = goals.agg(F.max("buckets").alias("b")).first()["b"] or 1
    rows = kinds.join(goals, kinds["source"].eqNullSafe(goals["source"])).drop(goals["source"]).withColumn("copies", F.col("copies") * F.col("m"))
    rows = rows.select("doc_id", "source", "row_key", "size", "m", "source_size", "target", "place", "buckets", F.floor("copies").cast("double").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"))
    rows = rows.withColumn("bucket", F.pmod("row_key", F.col("buckets")))
    schema = rows.schema

    def meet(level: int):
        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            t = t.sort_by([("row_key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
            rng = random.Random(f"{seed}/{key[0].as_py()}/{level}/{key[1].as_py()}")
            out = pivotal(t.column("size").to_pylist(), t.column("part").to_pylist(), rng)
            return t.set_column(t.column_names.index("part"), "part", pa.array(out, pa.float64()))

        return run

    done, level = None, 0
    while True:
        rows = saved(rows.groupBy("place", "bucket").applyInArrow(meet(level), schema))
        if wide <= 1:
            break
        settled = rows.where("part = 0 or part = 1")
        done = settled if done is None else done.unionAll(settled)
        rows = rows.where("part > 0 and part < 1").withColumn("bucket", F.floor(F.col("bucket") / FANIN))
        wide, level = -(-wide // FANIN), level + 1
    rows = rows if done is None else done.unionAll(rows)
    return rows.select("doc_id", "source", "row_key", "size", "m", "source_size", "target", (F.col("whole") + F.col("part")).alias("copies"))


def _words(rank) -> Column:
    """Words that the mix takes of the rank-th (from 0) of a kind's m rows: copies are dealt evenly, the first rows first."""
    whole = F.floor("copies")
    left = whole % F.col("m")
    own = (whole - left) / F.col("m") + F.when(rank < left, 1.0).when(rank == left, F.col("copies") - whole).otherwise(0.0)
    return F.round(own * F.col("size")).cast("long")


def taken(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, source, row_key, size (words), source_size, target of its
    source, and taken: words that the mix takes of it, repeats counted, at most `most` * size.

    taken is a multiple of size for all but one document of a source. Runs agree, whatever the partitioning: chances are drawn
    from the seed, the source's rank, the level and the bucket, in the order of (row_key, doc_id, size). Null texts have no
    words; null is a source of its own, the last. Repeated rows are summed before any shuffle, drawn for together, and written
    out again as rows, SAME by a task. No text is shuffled. An empty table gives an empty table.
    """
    plan = _plan(docs, seed, weights, share, most)
    few = plan.where(F.col("m") <= SAME).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("rank"))
    many = plan.where(F.col("m") > SAME).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(SAME).cast("long"))).alias("first"))
    many = many.repartition("row_key", "first").select("*", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + SAME, F.col("m")) - 1)).alias("rank")).drop("first")
    return few.unionByName(many).select("doc_id", "source", "row_key", "size", "source_size", "target", _words(F.col("rank")).alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself, with the columns of docs: a document taken twice is there twice, one not taken isn't. Of the one
    document a source that is taken in part, the copy holds the text's first words, n_chars to match. Rows without a
    word are left out, as they add nothing to a mix. Of repeated rows (doc_id, text and source), whose other columns may differ, the
    mix takes copies of one, as many as were drawn for all. An empty table gives an empty table."""
    plan = _plan(docs, seed, WEIGHTS, 1.5, 2.0).where("size > 0 and copies * size >= 0.5")
    plan = plan.select("row_key", F.col("source").alias("__source"), F.col("size").alias("__size"), F.round(F.col("copies") * F.col("size")).cast("long").alias("__taken"), "m")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__row", F.struct(*[docs[c] for c in docs.columns])).select("__row", F.xxhash64(F.col("doc_id").cast("long"), text, F.lit(seed)).alias("row_key"))
    each = rows.join(plan, (rows["row_key"] == plan["row_key"]) & F.col("__row.source").cast("string").eqNullSafe(F.col("__source"))).drop(plan["row_key"])
    each = each.where("m = 1").unionByName(each.where("m > 1").dropDuplicates(["row_key", "__source"])).drop("m")
    copies = F.ceil(F.col("__taken") / F.col("__size"))  # in two steps, so that no array of them grows with the table
    each = each.withColumn("__many", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1, F.lit(SAME).cast("long"))))
    each = each.withColumn("__copy", F.explode(F.sequence(F.col("__many"), F.least(F.col("__many") + SAME, copies) - 1)))
    left = F.col("__taken") - F.col("__copy") * F.col("__size")
    cut = left < F.col("__size")
    first = F.array_join(F.slice(F.split(F.regexp_replace("__row.text", rf"^{SPACES}", ""), SPACES), F.lit(1), left.cast("int")), " ")
    out = {c: F.col("__row")[c] for c in docs.columns} | {"text": F.when(cut, first).otherwise(F.col("__row.text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return each.select(*[out[c].alias(c) for c in docs.columns])
