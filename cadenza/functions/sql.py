"""The library's scalar functions as SQL functions of a session: those that SQL can say are SQL, which Catalyst inlines; the
others are Arrow functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cadenza.functions.evidence import beta_quantile_udf, miss_run_udf

DAY_US = 86_400_000_000
FUNCTIONS = {
    "day_of(us BIGINT) RETURNS DATE": f"date_add(DATE'1970-01-01', CAST(floor(us / {DAY_US}) AS INT))",
    "slot_of(us BIGINT, minutes INT) RETURNS INT": f"CAST(floor(pmod(us, {DAY_US}) / (minutes * 60000000L)) AS INT)",
    "ring_offset(observed DOUBLE, reference DOUBLE, size DOUBLE) RETURNS DOUBLE": "pmod(observed - reference, size) - CASE WHEN pmod(observed - reference, size) > size / 2 THEN size ELSE 0 END",
    "evidence_decay(rank_gap DOUBLE, half_life DOUBLE) RETURNS DOUBLE": "pow(0.5D, rank_gap / half_life)",
    "shrink_rate(num DOUBLE, den DOUBLE, prior DOUBLE, strength DOUBLE) RETURNS DOUBLE": "(num + strength * prior) / (den + strength)",
    "hotness(uses BIGINT, age_days DOUBLE, half_life DOUBLE) RETURNS DOUBLE": "(uses + 1) / (uses + 2) * pow(2.0D, -greatest(age_days, 0D) / half_life)",
    "dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)",
    "class_key(lane BIGINT, kind STRING) RETURNS STRING": "concat(lane, '/', kind)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, for this session alone."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("beta_quantile", beta_quantile_udf)
    spark.udf.register("miss_run", miss_run_udf)
