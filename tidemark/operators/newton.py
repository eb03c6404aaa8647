"""Logistic models of many groups fitted at once, by Newton's method over aggregated gradients."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    """Of one group: means and deviations of the features, weights of the standardised ones, and the intercept."""

    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray
    intercept: float


def _numbers(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def _totals(rows: DataFrame, d: int, of_group: Callable) -> dict[int, np.ndarray]:
    """Sums, by the number `_g` of their group, of what `of_group(number, features, labels)` gives for some rows: one array of numbers."""

    def of_task(batches):  # plain arrays and numpy alone: tasks need no import of this package
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            *x, y, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(d + 2))
            for k in np.unique(g):
                own = g == k
                sums = of_group(int(k), [c[own] for c in x], y[own])
                found[k] = found[k] + sums if k in found else sums
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in found], pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["_g", "_sums"])

    parts = rows.mapInArrow(of_task, "_g int, _sums array<double>")
    out: dict[int, dict[int, float]] = {}
    for r in parts.select("_g", F.posexplode("_sums").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r._g, {})[r.i] = r.v
    return {g: np.array([v for _, v in sorted(values.items())]) for g, values in out.items()}


def fit(df: DataFrame, groups: list[str], features: list[str], label: str, strength: float = 1.0, rounds: int = 50, close: float = 1e-9) -> dict[tuple, Fit]:
    """A model for each group that holds both labels: standardised features, an L2 penalty of 1 / strength on the weights.

    All groups take each step together: one pass over the rows sums gradients and second derivatives by group, in numpy
    inside the tasks, so the driver gets (features + 1)^2 numbers of each group, and solves. Missing features count as 0, constant ones have no
    weight. `df` is read once for each step; give it written. Groups are bounded: they are models.
    """
    x, d = _numbers(features), len(features)
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("pos")).collect()
    counts = [r for r in counts if 0 < r.pos < r.n]
    if not counts:
        return {}
    keys = [tuple(r[g] for g in groups) for r in counts]
    schema = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups) + ", _g int"
    numbers = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], schema)
    rows = df.join(F.broadcast(numbers), groups).select(*(c.alias(f"x{i}") for i, c in enumerate(x)), F.col(label).cast("double").alias("_y"), "_g")  # a row for each model

    sums = _totals(rows, d, lambda k, x, y: np.array([c.sum() for c in x]))
    means = {g: v / counts[g].n for g, v in sums.items()}
    squares = _totals(rows, d, lambda k, x, y: np.array([((c - m) ** 2).sum() for c, m in zip(x, means[k], strict=True)]))
    found = {}
    for g, v in squares.items():
        s = np.sqrt(v / (counts[g].n - 1))
        # what is left of a constant is rounding
        found[g] = Fit(means[g], np.where(s > 1e-10 * np.abs(means[g]), s, 0.0), np.zeros(d), 0.0)

    open_, penalty = set(found), np.array([*([1 / strength] * d), 0.0])
    for _ in range(rounds):
        if not open_:
            break
        models = {g: (f.means, f.deviations, f.weights, f.intercept) for g, f in found.items()}

        def derivatives(k, x, y, models=models):
            mean, deviation, weights, intercept = models[k]
            z = np.ones((len(y), d + 1))
            for i, c in enumerate(x):
                z[:, i] = (c - mean[i]) / deviation[i] if deviation[i] > 0 else 0.0
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(z[:, :d] @ weights + intercept)))
            return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        for g, v in _totals(rows.where(F.col("_g").isin(*open_)), d, derivatives).items():
            own = found[g]
            gradient = v[: d + 1] + penalty * np.append(own.weights, own.intercept)
            step = np.linalg.solve(v[d + 1 :].reshape(d + 1, d + 1) + np.diag(penalty), gradient)
            own.weights, own.intercept = own.weights - step[:-1], own.intercept - float(step[-1])
            if np.abs(step).max() < close:
                open_.discard(g)
    return {keys[g]: f for g, f in found.items()}


def scored(df: DataFrame, groups: list[str], features: list[str], fits: dict[tuple, Fit], digits: int = 5) -> DataFrame:
    """The rows of groups that have a model with `score`, the chance of the label by it, to some digits so that few distinct scores are ranked.

    Every number of a model is a column that is never null, so the generated code stays small enough to be compiled.
    """
    d = len(features)
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups), *(f"_{n}{i} double not null" for n in "msb" for i in range(d)), "_a double not null"])
    rows = []
    for k, f in fits.items():
        some = f.deviations > 0
        rows.append((*k, *f.means.tolist(), *np.where(some, f.deviations, 1.0).tolist(), *np.where(some, f.weights, 0.0).tolist(), f.intercept))
    models = df.sparkSession.createDataFrame(rows, schema)  # a row for each model
    weighted = [(c - F.col(f"_m{i}")) / F.col(f"_s{i}") * F.col(f"_b{i}") for i, c in enumerate(_numbers(features))]
    score = 1 / (1 + F.exp(-(sum(weighted, F.lit(0.0)) + F.col("_a"))))
    return df.join(F.broadcast(models), groups).withColumn("score", F.round(score, digits)).drop(*models.columns[len(groups) :])
