"""Session helpers that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import union_find

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. A session that names none is refused, since
    a folder of the driver's own can't be read by executors, unless all of it runs on one machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder is None:
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into the reliable checkpoint folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with a column `name` of the type, null where df has none."""
    return df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns, whatever else df has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text: two numbers, by partial sums."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def words(text: str = "text"):
    """The words of a text as an array, by DataFrame functions; empty for null and blank texts."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast(T.ArrayType(T.StringType()))).otherwise(F.split(bare, SPACES))


def let(value, body):
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A node with more edges than SPLIT is dealt out in parts, the HUBS largest ones first; the others have at most a HUBS-th of all.
SPLIT, HUBS = 256, 10_000


def with_least(edges: DataFrame, low: DataFrame, split: bool = True) -> DataFrame:
    """edges (a, b) with m, that low (a, m, and d, the number of a's edges) gives for a. The rows of a hub are dealt to as many
    tasks as it has SPLIT edges: the hubs broadcast are HUBS at most. Without split, for edges known to have no hub, a plain join."""
    if not split:
        return edges.join(low, "a").select("a", "b", "m")
    hubs = F.broadcast(low.orderBy(F.col("d").desc()).limit(HUBS).where(F.col("d") > SPLIT).select("a", F.ceil(F.col("d") / SPLIT).cast("int").alias("parts")))
    left = edges.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("s"))
    right = low.join(hubs, "a", "left").select("a", "m", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("s"))
    return left.join(right, ["a", "s"]).select("a", "b", "m")


#: Edges that one task joins: 130 MB, as pairs of pairs of numbers. Beyond, rounds over all tasks come first.
ALONE = 1 << 22


def _joined(whole: bool):
    """The nodes (long, or a struct of longs) of a partition's edges with the least one that each reaches there; without the least
    ones themselves unless whole."""

    def values(c: pa.ChunkedArray) -> list[np.ndarray]:
        c = c.combine_chunks()
        return [x.to_numpy(zero_copy_only=False) for x in (c.flatten() if pa.types.is_struct(c.type) else [c])]

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        kind = t.schema.field("a").type
        ends = [np.concatenate(x) for x in zip(values(t.column("a")), values(t.column("b")), strict=True)]
        order = np.lexsort(ends[::-1])
        new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in ends], axis=0)])
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        nodes = [x[order[new]] for x in ends]
        low = union_find(len(nodes[0]), node[: t.num_rows], node[t.num_rows :])
        some = np.arange(len(low)) if whole else np.flatnonzero(low != np.arange(len(low)))
        column = lambda at: pa.StructArray.from_arrays([pa.array(x[at]) for x in nodes], fields=list(kind)) if pa.types.is_struct(kind) else pa.array(nodes[0][at])
        yield from pa.table([column(some), column(low[some])], names=["node", "component"] if whole else ["a", "b"]).to_batches(1 << 16)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b of one ordered type, long or a struct of longs): node and component, the least node
    reached.

    What meets in a partition is joined there. ALONE edges or fewer are then one task's; of more, there are alternating
    large-star and small-star steps (Kiveris et al. 2014) until so few are left or nothing changes. Each step is a groupBy with
    partial minima and a join that splits hubs where there are any; no neighbourhood is ever collected. The number of rounds
    grows with the logarithm of the longest chain; a round is a dozen shuffles, which is why few edges have none. An empty table
    gives an empty table."""

    def told(e: DataFrame):
        """What tells one round's edges from another's, and the largest number of edges that end in one node."""
        ends = e.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        return ends.agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()

    kind = edges.schema["a"].dataType.simpleString()
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_joined(False), f"a {kind}, b {kind}"))
    alone = lambda: saved(e.coalesce(1).mapInArrow(_joined(True), f"node {kind}, component {kind}"))
    if e.count() <= ALONE:
        return alone()
    mark, degree = told(e), F.count(F.lit(1)).alias("d")
    while True:
        split = mark["most"] > 4 * SPLIT
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), degree).select("a", F.least("a", "m").alias("m"), "d")
        large = with_least(both, low, split).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = with_least(large, large.groupBy("a").agg(F.min("b").alias("m"), degree), split)
        e = saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        before, mark = mark, told(e)
        if mark == before:
            break
        if mark["n"] is not None and mark["n"] <= ALONE:
            return alone()
    tops = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(tops)
