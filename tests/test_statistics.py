"""Tests and regressions against closed forms."""

import math

import pytest

from tidemark.operators import stats as S


def test_t_distribution():
    assert S.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert S.t_p_value(1.0, 1) == pytest.approx(0.5)
    assert S.t_p_value(2.570581836, 5) == pytest.approx(0.05, abs=1e-6)


def test_fisher_on_the_tea_table():
    p, odds = S.fisher_exact(3, 1, 1, 3)
    assert p == pytest.approx(0.4857142857)
    assert odds == pytest.approx(6.408309, rel=1e-5)


def test_logit_of_the_mean_and_log_odds_ratio(spark):
    rows = spark.createDataFrame([(1, 1)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 15 + [(0, 0)] * 45, "y int, x int")
    only = S.logit(rows, "y", [])
    assert only[0]["coef"] == pytest.approx(math.log(45 / 55))
    both = {t["term"]: t for t in S.logit(rows, "y", ["x"])}
    assert both["x"]["coef"] == pytest.approx(math.log((30 / 10) / (15 / 45)))
    assert both["x"]["z"] == pytest.approx(both["x"]["coef"] / math.sqrt(1 / 30 + 1 / 10 + 1 / 15 + 1 / 45), rel=1e-6)


def test_negative_binomial_mean(spark):
    rows = spark.createDataFrame([(v, 0) for v in [0, 0, 1, 1, 2, 3, 5, 9, 14, 0, 1, 22]] + [(2 * v, 1) for v in [0, 0, 1, 1, 2, 3, 5, 9, 14, 0, 1, 22]], "y int, x int")
    terms = {t["term"]: t for t in S.negative_binomial(rows, "y", ["x"])}
    assert terms["(Intercept)"]["coef"] == pytest.approx(math.log(58 / 12), abs=1e-5)
    assert terms["x"]["coef"] == pytest.approx(math.log(2), abs=1e-5)
    assert 0.2 < terms["x"]["theta"] < 2


def test_spearman_of_a_monotone_pair(spark):
    rows = spark.createDataFrame([(i, i**3, -i) for i in range(20)], "a int, b int, c int")
    got = {r.i: r.rho for r in S.spearman(rows, ["a"], ["b", "c"]).collect()}
    assert got == {"b": 1.0, "c": -1.0}


def test_ranks_are_the_same_whether_they_are_sent_or_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 2, i * 7 % 13, i * 5 % 11, i * i % 17) for i in range(200)], "g int, a int, b int, c int")
    got = []
    for sent in (S.SENT, 0):
        monkeypatch.setattr(S, "SENT", sent)
        got.append(sorted((r.g, r.i, r.n, r.rho) for r in S.spearman(rows, ["a"], ["b", "c"], ["g"]).collect()))
    assert got[0] == got[1] and len(got[0]) == 4


def test_outcomes_counted_beforehand_give_the_same_model(spark, monkeypatch):
    rows = spark.createDataFrame([(v * (1 + x), x) for v in [0, 0, 1, 1, 2, 3, 5, 9, 14, 0, 1, 22] for x in (0, 1)], "y int, x int")
    got = []
    for sent in (S.SENT, 0):
        monkeypatch.setattr(S, "SENT", sent)
        got.append([(t["coef"], t["theta"], t["aic"], t["p"]) for t in S.negative_binomial(rows, "y", ["x"])])
    for a, b in zip(*got):
        assert a == pytest.approx(b, rel=1e-7)


def test_a_larger_class_is_not_numbered_by_one_task(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.rollups import balanced

    rows = spark.createDataFrame([(i, None if i < 30 else i % 3 > 0) for i in range(330)], "i int, a boolean")
    out = balanced(rows, F.col("a"), [F.col("i") * 7919 % 101, F.col("i")])
    first = lambda a: sorted((i for i in range(30, 330) if (i % 3 > 0) == a), key=lambda i: (i * 7919 % 101, i))[:30]
    assert sorted(r.i for r in out.collect()) == sorted([*range(30), *first(True), *first(False)])
    assert "flag_" not in out._jdf.queryExecution().executedPlan().toString()
