"""How well a score ranks, and how far published figures have moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve of a score for a boolean label, ties counted half, and its mirror.

    Rows are summed per distinct score before the running count, so only distinct scores pass the global window:
    round a continuous score first. Null scores are left out; without both labels the area is null.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    below = F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg")
    sums = per.withColumn("below", below).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("won"))
    area = F.col("won") / F.nullif(2.0 * F.col("n_pos") * F.col("n_neg"), F.lit(0.0))
    return sums.select("n_pos", "n_neg", F.round(area, 6).alias("auc"), F.round(F.greatest(area, 1 - area), 6).alias("mirrored_auc"))


def aucs(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """The area of each group and its mirror, as `auc` gives one; null where a group lacks a label."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg")
    sums = per.withColumn("below", below).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("won"))
    area = F.col("won") / F.nullif(2.0 * F.col("n_pos") * F.col("n_neg"), F.lit(0.0))
    return sums.select(*by, "n_pos", "n_neg", F.round(area, 6).alias("auc"), F.round(F.greatest(area, 1 - area), 6).alias("mirrored_auc"))


def drift(baseline: DataFrame, current: DataFrame, rule: str, value: str, tolerance: float) -> DataFrame:
    """REMOVED, NEW or DRIFT for each rule whose value is gone, came or moved by more than `tolerance`."""
    old, new = (d.select(rule, F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for d, n in ((baseline, "before"), (current, "after")))
    both = old.join(new, rule, "full_outer")
    status = F.when(F.col("in_after").isNull(), "REMOVED").when(F.col("in_before").isNull(), "NEW").when(F.abs(F.col("after") - F.col("before")) > tolerance, "DRIFT")
    return both.select(rule, "before", "after", status.alias("status")).where("status is not null")
