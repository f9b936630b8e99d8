"""Stores as folders of Parquet: partitioned days, generations, append-only logs, and calendars from JSON.

All paths go through Spark, so any store that Spark reads and writes will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

HOLIDAYS = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("days", T.ArrayType(T.StructType([T.StructField("date", T.DateType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())]))),
    T.StructField("_corrupt", T.StringType()),
])


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replaces the partitions of the days that df holds, and no others. A day's rows are gathered into few files by a
    rebalance, which splits a day that is large."""
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, schema: T.StructType, before: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if before is None else df.where(F.col("day") < F.lit(before).cast("date"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key of an append-only log."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


class Generations:
    """A table in whole generations: each write makes a folder, and a log of generations tells which one counts. A writer names
    the generation it read; if another came first, it is refused and its folder is never read. One writer at a time: Parquet
    folders have no compare-and-set, so two at once are told apart only by what the log shows when they look."""

    SCHEMA = "generation long, checkpoint long, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> tuple[int, int, str | None]:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/log").orderBy(F.col("generation").desc()).limit(1).collect()
        except AnalysisException:
            rows = []
        return (rows[0]["generation"], rows[0]["checkpoint"], rows[0]["folder"]) if rows else (0, 0, None)

    def read(self) -> DataFrame | None:
        folder = self.state()[2]
        return None if folder is None else self.spark.read.parquet(f"{self.path}/{folder}")

    def replace_all(self, df: DataFrame, checkpoint: int, expected: int) -> int:
        generation, held, _ = self.state()
        if generation != expected:
            raise ValueError(f"generation {generation} is there, not {expected}")
        if checkpoint < held:
            raise ValueError("the checkpoint would go back")
        folder = f"generation-{generation + 1}"
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        append_log(self.spark.createDataFrame([(generation + 1, checkpoint, folder)], self.SCHEMA), f"{self.path}/log")
        return generation + 1

    def apply(self, upserts: DataFrame, deletes: DataFrame, checkpoint: int, expected: int) -> int:
        """The held rows without those deleted or written again, and those written."""
        if upserts.select("id").join(deletes.select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an id is both written and deleted")
        held = self.read()
        gone = deletes.select("id").unionByName(upserts.select("id"))
        kept = upserts if held is None else held.join(gone, "id", "left_anti").unionByName(upserts)
        return self.replace_all(kept, checkpoint, expected)


def holidays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Days of the calendars at path (a JSON object a line, one a region and year), and the lines that are passed over: those
    that don't parse, hold a day twice, or a holiday without a name."""
    # the bad-record column can't be asked for alone, so the lines are parsed once and split by what was found
    raw = spark.read.schema(HOLIDAYS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    twice = F.size("days") != F.size(F.array_distinct(F.transform("days", lambda x: x["date"])))
    unnamed = F.exists("days", lambda x: (x["kind"] == "holiday") & (F.coalesce(x["name"], F.lit("")) == ""))
    bad = F.col("_corrupt").isNotNull() | F.col("region").isNull() | F.col("year").isNull() | F.coalesce(twice | unnamed, F.lit(True))
    marked = raw.withColumn("bad", bad)
    return marked.where("not bad").select("region", "year", F.inline("days")), marked.where("bad").select("region", "year", F.col("_corrupt").alias("line"))


def day_types(days: DataFrame, calendar: DataFrame, region: str) -> DataFrame:
    """day_type of each day: holiday, make-up workday, weekend or workday; unknown (null) in years without a calendar; and
    the nominal type, which asks the weekday alone."""
    own = calendar.where(F.col("region") == region)
    years = own.select("year").distinct().withColumn("known", F.lit(True))
    named = own.select(F.col("date").alias("day"), "kind")
    nominal = F.when(F.weekday("day") >= 5, "weekend").otherwise("workday")
    out = days.withColumn("year", F.year("day")).join(years, "year", "left").join(named, "day", "left").withColumn("nominal", nominal)
    return out.select("day", F.when(F.col("known"), F.coalesce("kind", "nominal")).alias("day_type"), "nominal")
