"""Small result tables as CSV, JSON lines and one JSON document; Spark writes each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header. For results of few rows: they pass one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _json_value(name: str, type_) -> Column:
    c = F.col(name)
    if not isinstance(type_, DecimalType):
        return c.cast("string") if type_.typeName() == "date" else c
    # whole numbers without a point, others as floating numbers
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("double").cast("string"))


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a JSON object, nulls kept, dates ISO, whole decimals as integers."""
    parts = []
    for f in df.schema.fields:
        value = _json_value(f.name, f.dataType)
        if isinstance(f.dataType, DecimalType):
            text = F.coalesce(value, F.lit("null"))
        else:
            one = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            text = F.substring(one, F.lit(6), F.length(one) - 6)  # between {"v": and }
        parts.append(F.concat(F.to_json(F.array(F.lit(f.name))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(f.name)))) - 2), F.lit(":"), text))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).coalesce(1).write.mode("overwrite").text(path)


def metrics_document(totals: DataFrame, rules: DataFrame, tolerance: float) -> DataFrame:
    """One row, one column `value`: the one-row totals, the rules in order of name and the tolerance as a document."""
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("rule", *(c for c in rules.columns if c != "rule")))).alias("rules"))
    both = totals.select(F.struct("*").alias("totals")).crossJoin(F.broadcast(listed))  # single rows
    return both.select(F.to_json(F.struct("totals", "rules", F.lit(tolerance).alias("tolerance"))).alias("value"))
