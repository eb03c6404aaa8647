"""Places of rows in a total order, tiles and exact percentiles, all by sorting in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import written

#: So many values at most are kept by one aggregation for its percentiles.
BUFFER = 1_000_000
_PLACES = (1 << 33) - 1  # the part of a row's number that counts within its partition


def numbered(df: DataFrame, groups: list[str], *order: Column) -> DataFrame:
    """The rows with `_number`, their place (from 1) in their group by a total order, and `_total`, the group's rows.

    Rows are sorted by range partitions and written once; a row's place is its place in its partition, plus what its
    group has in the partitions before. Only counts by partition and group meet in a window, so no task sees more than its
    share, were all rows of one group. Null is a group.
    """
    by = [*(F.col(g) for g in groups), *order]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_PLACES))})
    counts = placed.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    line = Window.partitionBy(*groups).orderBy("_part")  # a row for each partition of the data that has the group
    counts = counts.select("*", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups), F.col("r._part") == F.col("c._part"))
    met = placed.alias("r").join(counts.alias("c"), same)
    return met.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("_number"), "_total")


def tile(number: Column, total: Column, k: int) -> Column:
    """The tile of a place among k of equal size; the first ones have a row more where they don't divide."""
    small, more, n = F.floor(total / k), total % k, number - 1
    large = more * (small + 1)
    return (F.when(n < large, F.floor(n / (small + 1))).otherwise(more + F.floor((n - large) / F.greatest(small, F.lit(1)))) + 1).cast("int")


def tiles(df: DataFrame, groups: list[str], k: int, name: str, *order: Column) -> DataFrame:
    """The rows with their tile among k in their group."""
    return numbered(df, groups, *order).select(*df.columns, tile(F.col("_number"), F.col("_total"), k).alias(name))


def percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Each group's exact percentiles of a column, between two values in proportion. Null values don't count.

    Gives groups that have a value.
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(*groups, value), groups, F.col(value))
    found = []
    for name, p in shares.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        low, at = F.floor(place), F.col("_number") - 1
        found.append((name, place, low, F.max(F.when(at == low, F.col(value).cast("double"))), F.max(F.when(at == F.ceil(place), F.col(value).cast("double")))))
    wanted = reduce(lambda a, b: a | b, ((F.col("_number") - 1).isin(low, F.ceil(place)) for _, place, low, *_ in found))
    per = rows.where(wanted).groupBy(*groups, "_total").agg(*(x for name, _, _, a, b in found for x in (a.alias(f"_a_{name}"), b.alias(f"_b_{name}"))))
    between = lambda name, place, low: F.when(F.col(f"_a_{name}") == F.col(f"_b_{name}"), F.col(f"_a_{name}")).otherwise((low + 1 - place) * F.col(f"_a_{name}") + (place - low) * F.col(f"_b_{name}"))
    return per.select(*groups, *(between(name, place, low).alias(name) for name, place, low, *_ in found))


def distinct_counts(df: DataFrame, sets: list[list[str]], counts: dict[str, Column]) -> DataFrame:
    """Distinct values other than null of several columns, over grouping sets of the first set's keys: `level`, keys, counts.

    Each value enters once for each group of the finest set, whatever the number of its rows; the other sets are counted
    from these. So rows are expanded by the columns, once, and only what is distinct by the sets. Work grows with the
    pairs of group and value, however sparse; sets of bits would take their full length in a group of a single value.
    A group without values has no row.
    """
    keys = sets[0]
    each = F.array(*(F.struct(F.lit(i).alias("_which"), c.cast("string").alias("_value")) for i, c in enumerate(counts.values())))
    finest = df.select(*keys, F.inline(each)).where(F.col("_value").isNotNull()).groupBy(*keys, "_which", "_value").agg(F.lit(1).alias("_one"))
    own = [F.col("_which"), F.col("_value")]
    found = finest.groupingSets([[*(F.col(k) for k in s), *own] for s in sets], *keys, *own).agg((F.shiftright(F.grouping_id(), 2)).alias("level"))
    return found.groupBy("level", *keys).agg(*(F.count_if(F.col("_which") == i).alias(n) for i, n in enumerate(counts)))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """The rows of `left` with columns of the row of `right`, named `r`, that has the same keys; nulls are equal."""
    same = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return left.alias("l").join(right.alias("r"), same, "left").select("l.*", *(c.alias(n) for n, c in columns.items()))


def grouped(df: DataFrame, sets: list[list[str]], measures: dict[str, Column], spread: dict[str, tuple[Column, float]], counted: DataFrame, distinct: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates over grouping sets of the first set's keys: `level` (as GROUPING_ID has it), keys, measures and percentiles.

    `spread` has a column and a share for each percentile; `counted` has at least as many rows as values of them can be.
    Where those fit one aggregation's buffer, all is done in one pass, otherwise values are numbered in parallel; both
    give the same numbers. `distinct` has columns whose distinct values are counted, in a pass of their own.
    """
    keys = sets[0]
    level = lambda own: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
    few = not spread or counted.limit(BUFFER + 1).count() <= BUFFER
    inline = {n: F.percentile(c, p) for n, (c, p) in spread.items()} if few else {}
    found = df.groupingSets([[F.col(k) for k in own] for own in sets], *keys).agg(F.grouping_id().alias("level"), *(c.alias(n) for n, c in (measures | inline).items()))
    if distinct:
        found = _beside(found, distinct_counts(df, sets, distinct), ["level", *keys], {n: F.coalesce(F.col(f"r.{n}"), F.lit(0)) for n in distinct})
    if few:
        return found
    by_value: dict[str, dict[str, float]] = {}
    for n, (c, p) in spread.items():
        by_value.setdefault(str(c), {})[n] = p
    columns = {str(c): c for c, _ in spread.values()}
    for text, shares in by_value.items():
        each = reduce(DataFrame.unionByName, (df.select(F.lit(level(own)).cast("long").alias("level"), *((F.col(k) if k in own else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys), columns[text].alias("_value")) for own in sets))
        per = percentiles(each, ["level", *keys], "_value", shares)
        found = _beside(found, per, ["level", *keys], {n: F.col(f"r.{n}") for n in shares})
    return found
