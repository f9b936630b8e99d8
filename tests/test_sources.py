"""Stores and calendars: round trips."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources import series, tables


def test_only_dirty_days_are_written_again(spark, sf, tmp_path):
    path, r = str(tmp_path / "days"), series.records(spark, sf)
    tables.write_days(r, path)
    schema = T.StructType([*[f for f in r.schema if f.name != "day"], T.StructField("day", T.DateType())])
    whole = tables.read_days(spark, path, schema)
    assert sorted(whole.select(*r.columns).collect()) == sorted(r.collect())
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    tables.write_days(r.where("day = date'2024-01-05'").withColumn("k", F.lit(-1)), path)
    changed = {p.parent.name for p in (tmp_path / "days").rglob("*.parquet") if before.get(p) != p.stat().st_mtime_ns}
    assert changed == {"day=2024-01-05"}
    early = tables.read_days(spark, path, schema, "2024-01-03")
    assert "PartitionFilters" in early._jdf.queryExecution().executedPlan().toString()
    assert early.count() == r.where("day < date'2024-01-03'").count()


def test_generations(spark, tmp_path):
    store = tables.Generations(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    assert store.state() == (0, 0, None) and store.read() is None
    assert store.replace_all(rows((1, "a"), (2, "b")), 5, 0) == 1
    with pytest.raises(ValueError, match="generation 1"):
        store.replace_all(rows((9, "z")), 6, 0)
    with pytest.raises(ValueError, match="go back"):
        store.replace_all(rows((9, "z")), 4, 1)
    with pytest.raises(ValueError, match="both"):
        store.apply(rows((1, "x")), rows((1, "x")), 6, 1)
    assert store.apply(rows((2, "c"), (3, "d")), rows((1, "")), 6, 1) == 2
    assert sorted(map(tuple, store.read().collect())) == [(2, "c"), (3, "d")]


def test_log_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "log")
    for night in (1, 2):
        tables.append_log(spark.createDataFrame([(1, night, f"s{night}")], "id int, night int, status string"), path)
    assert tables.latest(spark.read.parquet(path), ["id"], ["night"]).collect()[0]["status"] == "s2"


def test_holidays(spark, tmp_path):
    lines = [
        '{"region": "x", "year": 2024, "days": [{"date": "2024-01-01", "kind": "holiday", "name": "new year"}, {"date": "2024-01-06", "kind": "makeup"}]}',
        '{"region": "x", "year": 2025, "days": [{"date": "2025-01-01", "kind": "holiday"}]}',
        "{broken",
    ]
    (tmp_path / "c.json").write_text("\n".join(lines))
    good, bad = tables.holidays(spark, str(tmp_path / "c.json"))
    assert good.count() == 2 and bad.count() == 2
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 6, 7)] + [(dt.date(2025, 1, 4),)], "day date")
    got = {r["day"]: (r["day_type"], r["nominal"]) for r in tables.day_types(days, good, "x").collect()}
    assert [got[dt.date(2024, 1, d)][0] for d in (1, 2, 6, 7)] == ["holiday", "workday", "makeup", "weekend"]
    assert got[dt.date(2025, 1, 4)] == (None, "weekend")


def test_datasets(spark, tmp_path):
    import json

    from cadenza.sources import datasets

    sample = {"sample_id": "s1", "scenarios": ["a"], "sessions": [{"session_id": "x", "at": "2024", "messages": [{"message_id": "m1", "speaker": "u", "text": "hi"}, {"message_id": "m2", "speaker": "a", "text": "yo"}]}],
              "questions": [{"question_id": "q1", "category": "single", "question": "?", "answer": "!", "evidence": ["m1", "gone"]}, {"question_id": "q2", "category": "adversarial", "question": "?", "answer": "", "evidence": []}]}
    (tmp_path / "d.json").write_text(json.dumps(sample) + "\n")
    messages, questions = datasets.load(spark, str(tmp_path / "d.json"))
    assert [(r["message_id"], r["place"]) for r in messages.orderBy("place").collect()] == [("m1", 0), ("m2", 1)]
    assert [r["question_id"] for r in questions.collect()] == ["q1"] and datasets.load(spark, str(tmp_path / "d.json"), adversarial=True)[1].count() == 2
    assert [r["message_id"] for r in datasets.dangling_evidence(messages, questions).collect()] == ["gone"]


def test_schemas_are_checked():
    from cadenza.operators import documents

    got = documents.struct_of([{"name": "a", "type": "text", "required": True}, {"name": "b", "type": "list"}])
    assert got.simpleString() == "struct<a:string,b:array<string>>" and not got["a"].nullable
    for bad in ([{"name": "a", "type": "text"}] * 2, [{"name": "a", "type": "blob"}]):
        with pytest.raises(ValueError):
            documents.struct_of(bad)
