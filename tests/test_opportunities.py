"""Known cases of opportunities, moments, units, gates and nightly states; all of them against SQL in test_queries.py."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions.evidence import beta_quantile, incomplete_beta
from cadenza.operators import opportunities as O
from cadenza.operators.reliability import folded

HOUR = 3_600_000_000
DAY = datetime.date(2024, 1, 10)
AT = 1_704_844_800_000_000  # that day's midnight


def test_what_comes_of_a_chain(spark):
    rel = spark.createDataFrame([(1, "a>b", "chain", "a", "b", "established", True, False), (1, "a>c", "chain", "a", "c", "rejected", True, False), (1, "a>d", "chain", "a", "d", "candidate", True, True)], "lane long, key string, segment string, antecedent string, consequent string, status string, upward boolean, conditioned boolean")
    acts = [("a", 1, 8, True), ("b", 2, 9, False), ("b", 3, 10, True), ("a", 4, 20, True), ("b", 5, 25, True), ("a", 6, 40, True), ("b", 7, 41, False), ("a", 8, 60, True), ("a", 9, 80, True)]
    eps = spark.createDataFrame([(1, k, u, AT + h * HOUR, AT + h * HOUR, n, DAY) for k, u, h, n in acts], "lane long, kind string, first_uri long, start_us long, last_us long, natural boolean, day date")
    pieces = spark.createDataFrame([(1, AT + 61 * HOUR, AT + 62 * HOUR)], "lane long, piece_begin long, piece_end long")
    got = {r["antecedent_uri"]: (r["key"], r["came"], r["consequent_uri"]) for r in O.event_opportunities(rel, eps, pieces, 6 * HOUR).collect()}
    assert got == {"1": ("a>b", True, 3), "4": ("a>b", True, 5), "6": ("a>b", None, None), "8": ("a>b", None, None), "9": ("a>b", False, None)}


def test_an_act_counts_for_the_first_moment(spark):
    rows = [("x", 1, 0, 30, True, "u", 0.5, "i"), ("x", 2, 25, 30, True, "u", 1.0, "j"), ("x", 3, 27, 33, False, None, 0.25, "j"), ("x", 4, 60, 61, None, None, 1.0, "j"), ("x", 5, 80, 81, True, "v", 0.5, "k"), ("x", 6, 80, 82, True, "w", 0.75, "i")]
    df = spark.createDataFrame([(k, i, AT + a * HOUR, AT + b * HOUR, AT + a * HOUR, c, o, s, n) for k, i, a, b, c, o, s, n in rows], "kind string, id long, from_us long, to_us long, formed_us long, came boolean, occurrence string, strength double, input string")
    got = sorted(((r["at_us"] - AT) // HOUR, r["signature"], r["came"], r["strength"], r["n"]) for r in O.moments(df, ["kind"]).collect())
    assert got == [(0, ["i"], True, 0.5, 1), (25, ["j"], False, 0.25, 2), (80, ["i", "k"], True, 0.75, 2)]


def test_a_unit_is_read_from_moments_like_it(spark):
    past = [(1, i, s, c, 1.0) for i, (s, c) in enumerate([(["a", "b"], True), (["a", "c"], False), (["a", "b"], True), (["a"], False), (["a", "c"], True), (["a", "b"], False)])]
    p = spark.createDataFrame(past, "lane long, at_us long, signature array<string>, came boolean, strength double")
    units = spark.createDataFrame([(1, 10, ["a", "b"]), (1, 11, ["b", "d"]), (1, 12, ["a", "b", "c"]), (1, 1, ["a", "b"])], "lane long, at_us long, signature array<string>")
    got = {r["now_us"]: r for r in O.unit_readings(p, units, ["lane"]).collect()}
    read = lambda of: folded(pd.DataFrame([{"came": c, "weight": w} for _, _, s, c, w in past if s in of]), 0.05, 8.0, 35)
    own, other, both = read([["a", "b"]]), read([["a", "c"]]), read([["a", "b"], ["a", "c"]])
    strength = min(0.5 / (1 - 0.5**0.125), other["n"])
    a, b = own["k"] + strength * other["mean"] + 0.5, own["n"] - own["k"] + strength * (1 - other["mean"]) + 0.5
    assert (got[10]["level"], got[10]["n_same_set"], got[10]["n_same_count"]) == ("same_set", 3, 5)
    assert got[10]["mean"] == pytest.approx(a / (a + b)) and got[10]["lower"] == pytest.approx(float(beta_quantile(0.05, a, b)))
    assert (got[11]["level"], got[11]["n_same_set"], got[11]["n_same_count"]) == ("same_count", 0, 5) and got[11]["upper"] == pytest.approx(both["upper"])
    assert got[12]["level"] == "strongest" and got[12]["mean"] is None
    assert got[1]["level"] == "same_set" and got[1]["n_same_count"] == 1


def test_what_a_unit_speaks_from(spark):
    rows = [(1, 1, True, True, "established", True, 0.2, 0.1), (1, 2, True, True, "established", True, 0.3, 0.0), (1, 3, True, False, None, None, None, 0.9), (2, 1, False, False, None, None, None, 0.9), (2, 2, True, True, "candidate", None, None, 0.8), (2, 3, True, False, None, None, None, 0.1), (3, 1, False, True, "candidate", True, 0.5, 0.2)]
    df = spark.createDataFrame(rows, "unit long, id long, due boolean, backed boolean, status string, large boolean, lift double, lower double")
    assert {r["unit"]: (r["id"], r["speakable"]) for r in O.basis(df, ["unit"]).collect()} == {1: (2, True), 2: (3, True), 3: (1, False)}


def test_gates_and_hysteresis(spark):
    rows = [(1, (0.1, 0.3), (0.5, 0.9), None), (2, (0.01, 0.3), None, None), (3, (0.01, 0.3), (0.1, 0.9), True), (4, (0.01, 0.04), (0.1, 0.9), True), (5, None, None, True), (6, (0.1, 0.3), (0.1, 0.15), True)]
    t = spark.createDataFrame([(i, s, r, True, True, None, w, 10, 0.5, 5) for i, s, r, w in rows], "id long, spread struct<low:double,high:double>, relative struct<low:double,high:double>, upward boolean, leave_one_out boolean, heterogeneity double, was_large boolean, n long, difference double, consequents long")
    got = {r["id"]: (r["stable"], r["large"], r["excess_share"]) for r in O.assessed(t, 0.05, 0.2, 0.05).collect()}
    assert {i: x[1] for i, x in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False} and got[1] == (True, True, 1.0)


def test_beta_function_and_its_inverse():
    for p, a, b in ((0.05, 0.5, 0.5), (0.95, 35.0, 0.5), (0.5, 3000.0, 0.7), (0.1, 0.2, 900.0), (0.3, 1.0, 1.0)):
        assert incomplete_beta(beta_quantile(p, a, b), a, b) == pytest.approx(p, abs=1e-9)
    assert incomplete_beta(0.3, 2, 3) == pytest.approx(0.3483) and beta_quantile(0.3, 1, 1) == pytest.approx(0.3)
    for bad in ((0.5, 0, 1), (0.5, 1, -1)):
        with pytest.raises(ValueError, match="positive"):
            incomplete_beta(*bad)
        with pytest.raises(ValueError, match="positive"):
            beta_quantile(*bad)


def test_answers_outside_the_vocabulary_are_told(spark):
    req, vocabulary = spark.range(4), spark.createDataFrame([("a", 1)], "name string, class_id int")
    answers = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (1, "b", 1), (2, None, 1)], "id long, name string, seq int")
    assert {r["id"]: (r["class_id"], r["state"]) for r in O.classified(req, vocabulary, answers).collect()} == {0: (1, "classified"), 1: (None, "outside"), 2: (None, "unanswered"), 3: (None, "unanswered")}
    assert O.classified(req.where(F.lit(False)), vocabulary, answers).count() == 0
