"""Ranking and drift on small fixtures."""

from tidemark.operators import evaluation


def test_auc_counts_ties_half(spark):
    rows = [(1.0, False), (2.0, True), (2.0, False), (3.0, True), (None, True)]
    got = evaluation.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    pairs = [1.0 if p > n else 0.5 if p == n else 0.0 for p in (2.0, 3.0) for n in (1.0, 2.0)]
    assert (got.n_pos, got.n_neg, got.auc) == (2, 2, sum(pairs) / 4)


def test_auc_without_both_labels(spark):
    got = evaluation.auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", "y").first()
    assert got.auc is None and got.mirrored_auc is None


def test_drift(spark):
    old = spark.createDataFrame([("gone", 1.0), ("same", 1.0), ("moved", 1.0)], "rule string, pct double")
    new = spark.createDataFrame([("came", 1.0), ("same", 1.04), ("moved", 1.06)], "rule string, pct double")
    got = {r.rule: r.status for r in evaluation.drift(old, new, "rule", "pct", 0.05).collect()}
    assert got == {"gone": "REMOVED", "came": "NEW", "moved": "DRIFT"}
