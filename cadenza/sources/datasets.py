"""Benchmark data sets from JSON: samples of sessions of messages, with questions and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = """sample_id string, scenarios array<string>,
sessions array<struct<session_id:string, at:string, messages:array<struct<message_id:string, speaker:string, text:string>>>>,
questions array<struct<question_id:string, category:string, question:string, answer:string, evidence:array<string>>>"""


def load(spark: SparkSession, path: str, adversarial: bool = False) -> tuple[DataFrame, DataFrame]:
    """Messages (sample_id, session_id, at, place, message_id, speaker, text) and questions (sample_id, ..., evidence) of the samples
    at path, one JSON object a line. A line that doesn't fit the schema fails the read."""
    raw = spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)
    sessions = raw.select("sample_id", F.inline("sessions"))
    messages = sessions.select("sample_id", "session_id", "at", F.posexplode("messages").alias("place", "m")).select("sample_id", "session_id", "at", "place", "m.*")
    questions = raw.select("sample_id", F.inline("questions"))
    return messages, questions if adversarial else questions.where(F.coalesce("category", F.lit("")) != "adversarial")


def dangling_evidence(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """Evidence that names no message of its sample."""
    e = questions.select("sample_id", "question_id", F.explode("evidence").alias("message_id"))
    return e.join(messages, ["sample_id", "message_id"], "left_anti")
