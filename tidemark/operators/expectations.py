"""Assertions on data: each gives the rows that break it; `report` counts them by severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().where("count > 1")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def accepted_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def no_overlap(versions: DataFrame, key: str) -> DataFrame:
    """Versions that end on or after the next one's start."""
    from pyspark.sql import Window

    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from", "valid_to"))
    return versions.withColumn("next_from", following).where("next_from <= valid_to")


def report(checks: dict[str, tuple[DataFrame, int, int]]) -> DataFrame:
    """name, failures, severity (pass, warn, error) for {name: (broken rows, warn above, error above)}."""
    rows = [d.agg(F.count("*").alias("failures")).select(F.lit(n).alias("name"), "failures", F.when(F.col("failures") > e, "error").when(F.col("failures") > w, "warn").otherwise("pass").alias("severity")) for n, (d, w, e) in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def row_checks(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """name and failures of conditions that no row of a table should meet, all counted in one pass. Null is no failure."""
    one = df.agg(*(F.count_if(c).alias(f"c{k}") for k, c in enumerate(broken.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c{k}").alias("failures")) for k, n in enumerate(broken)))))


def counted(broken: DataFrame, name: str) -> DataFrame:
    """name and failures of an assertion, from the rows that break it."""
    return broken.agg(F.lit(name).alias("name"), F.count("*").alias("failures"))


def graded(found: list[DataFrame], levels: dict[str, tuple[int, int]]) -> DataFrame:
    """name, failures and severity (pass, warn, error) by {name: (warn above, error above)}."""
    rows, severity = reduce(DataFrame.unionByName, found), F.lit("pass")
    for name, (warn, error) in levels.items():
        severity = F.when((F.col("name") == name) & (F.col("failures") > error), "error").when((F.col("name") == name) & (F.col("failures") > warn), "warn").otherwise(severity)
    return rows.select("name", "failures", severity.alias("severity"))
