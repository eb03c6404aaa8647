"""The logistic model against Newton's method, and the exports read back."""

import datetime as dt
import json
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.plans import catalog
from tidemark.sources import export


def test_logistic(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2)) * [1, 40] + [5, 0]
    y = rng.random(120) < 1 / (1 + np.exp(-(x[:, 0] - 5 + x[:, 1] / 30)))
    rows = spark.createDataFrame([(i, float(a), float(b), bool(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y boolean")
    model = learning.fit_logistic(rows, ["a", "b"], "y")
    got = {r.id: r.score for r in learning.score_logistic(model, rows, ["a", "b"]).collect()}
    z = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones(120)])
    w, penalty = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    want = 1 / (1 + np.exp(-z @ w))
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4
    assert learning.fit_logistic(rows.where("y"), ["a", "b"], "y") is None
    assert learning.fit_logistic(rows.limit(0), ["a", "b"], "y") is None


def test_missing_features_count_as_zero(spark):
    rows = spark.createDataFrame([(None, True), (0.0, True), (1.0, False), (2.0, False)], "a double, y boolean")
    scores = [r.score for r in learning.score_logistic(learning.fit_logistic(rows, ["a"], "y"), rows, ["a"]).collect()]
    assert scores[0] == scores[1] > scores[2] > scores[3]


def test_regimes(spark, small):
    got = catalog.QUERIES["ml03_regimes"](spark, small)
    assert [r.regime for r in got.orderBy("regime").collect()] == ["all", "warm"]
    for r in got.collect():
        areas = [a for a in r[1:5] if a is not None]
        assert all(0 <= a <= 1 for a in areas)
        assert r.gap is None or abs(r.gap - (r.all_test_auc - r.past_test_auc)) < 1e-6


def test_exports(spark, tmp_path):
    rows = [(1, Decimal("2.0000"), Decimal("2.5000"), dt.date(2020, 1, 2), 'a "b"', None, True), (2, Decimal("-3.0000"), None, None, "", 1.5, False)]
    df = spark.createDataFrame(rows, "id int, whole decimal(28,4), part decimal(28,4), day date, text string, number double, flag boolean")
    export.write_json(df, f"{tmp_path}/json")
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()), key=lambda r: r["id"])
    assert got[0] == {"id": 1, "whole": 2, "part": 2.5, "day": "2020-01-02", "text": 'a "b"', "number": None, "flag": True}
    assert got[1] == {"id": 2, "whole": -3, "part": None, "day": None, "text": "", "number": 1.5, "flag": False}
    assert isinstance(got[0]["whole"], int)
    export.write_csv(df.select("id", "text"), f"{tmp_path}/csv")
    assert {r.id for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {"1", "2"}
    export.write_json(df.limit(0), f"{tmp_path}/none")
    assert spark.read.text(f"{tmp_path}/none").count() == 0


def test_metrics_document(spark):
    totals = spark.createDataFrame([(5, "2020-01-02")], "n long, vintage string")
    rules = spark.createDataFrame([("b", 1.5), ("a", 2.0)], "rule string, pct double")
    got = json.loads(export.metrics_document(totals, rules, 0.05).first().value)
    assert got == {"totals": {"n": 5, "vintage": "2020-01-02"}, "rules": [{"rule": "a", "pct": 2.0}, {"rule": "b", "pct": 1.5}], "tolerance": 0.05}
    empty = json.loads(export.metrics_document(totals, rules.where(F.lit(False)), 0.05).first().value)
    assert empty["rules"] == []
