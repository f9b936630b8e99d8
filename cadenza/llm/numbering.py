"""Global row numbers by DataFrame functions, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

ROWS = 100_000


def numbered(df: DataFrame, *order, name: str = "row_number", n_rows: int | None = None) -> DataFrame:
    """df with 0, 1, ... in the given order of columns. df should be narrow: it is written to the checkpoint folder, so that
    the sampled ranges are drawn once. Ranges of about ROWS rows are sorted each for itself; only the ranges' sizes meet in
    one task, one row for each range. Rows that tie in the whole order get numbers in no order; let the order be total."""
    n = df.count() if n_rows is None else n_rows
    parts = max(1, min(-(-n // ROWS), 20_000), min(n // 1000, df.sparkSession.sparkContext.defaultParallelism))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id that each task counts up holds the partition in its high bits and the row in its low 33
    held = saved(dealt.withColumn("__id", F.monotonically_increasing_id()))
    at, row = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(at.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return held.withColumn("__part", at).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row).drop("__id", "__part", "__before")
