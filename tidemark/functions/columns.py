"""Column functions that the models share; none needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_numeric(c: Column) -> Column:
    """Plain or scientific decimal text as decimal(28,4); anything else is null."""
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"), c.try_cast("decimal(28,4)"))


def yyyymmdd(c: Column) -> Column:
    """Eight digits as a date; anything else, impossible days too, is null."""
    return F.when(c.rlike(r"^[0-9]{8}\z"), F.try_to_date(c, "yyyyMMdd"))


#: Fixed value: the public mark of a null in such keys.
_NULL_MARK = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*names: str) -> Column:
    """md5 of the columns as text, nulls marked."""
    return F.md5(F.concat_ws("-", *(F.coalesce(F.col(n).cast("string"), F.lit(_NULL_MARK)) for n in names)))


def material(old: Column, new: Column, share: str) -> Column:
    """Differs, by `share` of the old value at least; any change of a zero counts. No division, so exact."""
    return (new != old) & ((old == 0) | (F.abs(new - old) >= F.lit(share).cast("decimal(9,6)") * F.abs(old)))


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def next_weekday(c: Column) -> Column:
    """Saturday and Sunday become the Monday after."""
    return F.date_add(c, F.when(F.weekday(c) == 5, 2).when(F.weekday(c) == 6, 1).otherwise(0))


def major_group(sic: Column) -> Column:
    return F.when(sic.rlike(r"^[0-9]{4}\z"), F.left(sic, F.lit(2)))
