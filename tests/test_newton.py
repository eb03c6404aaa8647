"""Models of many groups fitted together, against Newton's method on each alone."""

import numpy as np

from tidemark.operators import evaluation, newton


def alone(x, y):
    s = x.std(0, ddof=1)
    z = np.column_stack([np.divide(x - x.mean(0), s, out=np.zeros_like(x), where=s > 0), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([*[1.0] * x.shape[1], 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return 1 / (1 + np.exp(-z @ w))


def test_groups_together_as_each_alone(spark):
    rng, data, rows = np.random.default_rng(5), {}, []
    for g, n in (("a", 150), ("b", 90), ("c", 40)):
        x = np.column_stack([rng.normal(size=(n, 2)) * [1, 30] + [2, 0], np.full(n, 3.0)])
        y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 2 + x[:, 1] / 20)))
        data[g] = (x, y)
        rows += [(g, i, *map(float, r), bool(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    rows += [("one label", i, 1.0, 2.0, 3.0, True) for i in range(5)] + [("lone", 0, 1.0, 2.0, 3.0, False)]
    df = spark.createDataFrame(rows, "g string, i int, p double, q double, r double, y boolean")
    fits = newton.fit(df, ["g"], ["p", "q", "r"], "y")
    assert sorted(k[0] for k in fits) == ["a", "b", "c"] and all(f.weights[2] == 0 for f in fits.values())
    scored = newton.scored(df, ["g"], ["p", "q", "r"], fits, digits=12)
    for g, (x, y) in data.items():
        got = np.array([r.score for r in scored.where(f"g = '{g}'").orderBy("i").collect()])
        assert np.abs(got - alone(x, y)).max() < 1e-8
    areas = {r.g: r.auc for r in evaluation.aucs(scored, ["g"], "score", "y").collect()}
    assert areas == {g: evaluation.auc(scored.where(f"g = '{g}'"), "score", "y").first().auc for g in data}


def test_missing_features_count_as_zero(spark):
    df = spark.createDataFrame([(1, None, True), (1, 0.0, True), (1, 1.0, False), (1, 2.0, False)], "g int, a double, y boolean")
    scores = [r.score for r in newton.scored(df, ["g"], ["a"], newton.fit(df, ["g"], ["a"], "y")).collect()]
    assert scores[0] == scores[1] > scores[2] > scores[3]
    assert newton.fit(df.limit(0), ["g"], ["a"], "y") == {}


def test_horizons_of_the_sweep(spark, small):
    """One horizon of the sweep has the features of the point-in-time table, and the models rank as fitted one by one."""
    from tidemark.operators import learning
    from tidemark.plans import features, ranking

    rows = ranking.sweep(spark, small)
    one = features.point_in_time(features.base(spark, small))
    mine = rows.where("horizon = 180").select(*one.columns)
    assert mine.exceptAll(one).count() == 0 and one.exceptAll(mine).count() == 0
    got = {(r.horizon, r.regime): (r.train_auc, r.test_auc) for r in ranking.d21c_horizon_models(spark, small).collect()}
    train, test = one.where(ranking._TRAINED), one.where(f"not ({ranking._TRAINED})")
    model = learning.fit_logistic(train, ranking._FEATURES, "was_restated")
    want = [evaluation.auc(learning.score_logistic(model, side, ranking._FEATURES), "score", "was_restated").first().auc for side in (train, test)] if model else None
    assert want is None or max(abs(a - b) for a, b in zip(got[180, "all"], want)) < 2e-3


def test_reports_are_not_multiplied_before_a_shuffle(spark, small):
    """All horizons count a company's revisions together, sectors and the market are broadcast: one exchange of the reports."""
    from tidemark.plans import features, ranking

    text = ranking.sweep(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("strategy=broadcast") >= 4
    once = ranking.sweep(spark, small)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "horizon" not in "".join(x for x in once.splitlines() if "Exchange hashpartitioning(cik" in x)
    resolved = features.t08_pit_recomputed(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert resolved.count("strategy=broadcast") >= 2
