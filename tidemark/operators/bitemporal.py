"""Operators on facts with two dates: what a value describes and when it became known. No domain names here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import material

OPEN_END = "9999-12-31"
#: Places of `perhaps_in`, as a power of two: 32 MB of bits at most.
PLACES = 28


def pick_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def scd2(df: DataFrame, key: str, as_of: str, tracked: list[str], *pick: Column) -> DataFrame:
    """Type-2 versions: one row per (key, as_of) by `pick`, a version wherever a tracked column changes.

    Adds valid_from, valid_to (inclusive), version_number, is_current. All windows share the key's partitioning.
    """
    daily = pick_one(df, [key, as_of], *pick)
    line = Window.partitionBy(key).orderBy(as_of)
    changed = F.row_number().over(line) == 1
    for c in tracked:
        changed |= ~F.col(c).eqNullSafe(F.lag(c).over(line))
    starts = daily.withColumn("_new", changed).where("_new").drop("_new")
    after = F.lead(as_of).over(line)
    return starts.select(key, *tracked, F.col(as_of).alias("valid_from"), F.coalesce(F.date_sub(after, 1), F.lit(OPEN_END).cast("date")).alias("valid_to"), F.row_number().over(line).alias("version_number"), after.isNull().alias("is_current"))


def valid_at(df: DataFrame, versions: DataFrame, key: str, at: str, how: str = "inner") -> DataFrame:
    """Join each row with the version that holds on its date."""
    v = versions.withColumnRenamed(key, "_key")
    return df.join(v, (F.col(key) == F.col("_key")) & F.col(at).between(F.col("valid_from"), F.col("valid_to")), how).drop("_key")


def timelines(df: DataFrame, key: list[str], at: str, value: str, source: str) -> DataFrame:
    """The key and `line`: its reports (at, source, value) in order of time. Null values are no reports.

    The only shuffle of the facts: dates are collapsed inside of each key's array.
    """
    rows = df.where(F.col(value).isNotNull()).select(*key, at, value, source)
    every = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(source).alias("source"), F.col(value).alias("value"))))
    return rows.groupBy(*key).agg(every.alias("line")).withColumn("line", F.filter("line", _last_of_date))


def repeated_timelines(df: DataFrame, key: list[str], at: str, value: str, source: str) -> DataFrame:
    """`timelines` of the keys that were reported on several dates.

    Rows are shuffled as they are, sorted once and passed once; keys of a single date go before anything is collected,
    and most keys have one date only.
    """
    line = Window.partitionBy(*key).orderBy(at, source, value)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.where(F.col(value).isNotNull()).select(*key, at, value, source)
    last = F.lead(F.lit(True)).over(line).isNull() | (F.lead(at).over(line) != F.col(at))
    rows = rows.select("*", last.alias("_last"), (F.min(at).over(whole) != F.max(at).over(whole)).alias("_several")).where("_last and _several")
    every = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(source).alias("source"), F.col(value).alias("value"))))
    return rows.groupBy(*key).agg(every.alias("line"))


def _last_of_date(x: Column, i: Column) -> Column:
    return (i == F.size("line") - 1) | (F.get("line", i + 1)["at"] != x["at"])


def coarser_timelines(found: DataFrame, key: list[str], *measures: Column) -> DataFrame:
    """`timelines` of fewer key columns, merged from those of more, and measures over the merged ones.

    Equal to the timelines of the facts themselves: the last report of a date is the last of the finer keys' last ones.
    """
    merged = found.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("line"))).alias("line"), *measures)
    return merged.withColumn("line", F.filter("line", _last_of_date))


def is_revised(share: str) -> Column:
    """Whether the last report of `line` departs from the first one materially."""
    return (F.size("line") > 1) & material(F.col("line")[0]["value"], F.element_at("line", -1)["value"], share)


def split_lookup(df: DataFrame, dictionary: DataFrame, keys: list[str], common: Column, parts: int | None = None) -> DataFrame:
    """Left join with a dictionary whose `common` entries (a condition on the keys alone) are few, however many rows have them.

    Those are broadcast, so their rows aren't shuffled and no key is one task; only rows of the other keys meet by a
    shuffle, of `parts` partitions if given. `df` is read once for each part.
    """
    often = F.coalesce(common, F.lit(False))
    # both sides, since the planner gives one side's number to the other
    rest, entries = (x.repartition(parts, *keys) if parts else x for x in (df.where(~often), dictionary.where(~often)))
    return df.where(often).join(F.broadcast(dictionary.where(often)), keys, "left").unionByName(rest.join(entries, keys, "left"))


def perhaps_in(df: DataFrame, column: Column, keys: DataFrame, expected: int) -> DataFrame:
    """The rows whose `column` is among the keys (of one column, the same type), and few others; for rows that a later join would move for nothing.

    A hash gives each key its bit, eight bits or more for each `expected` one. Blocks of bits are broadcast, 32 MB at most
    whatever the number of keys; with very many keys more of the others stay. A null is a key.
    """
    power = min(max((8 * expected).bit_length(), 16), PLACES)
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << power) - 1))
    ones = keys.select(place(F.col(keys.columns[0])).alias("at"), F.lit(1).alias("one"))
    every = df.sparkSession.range(1 << (power - 6)).select(F.shiftleft("id", 6).alias("at"), F.lit(0).alias("one"))  # no word is missing
    dealt = ones.unionByName(every).withColumn("_block", F.shiftright("at", 16)).repartition("_block")
    words = dealt.groupBy("_block", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(cast(one as bigint), cast(at & 63 as int))")).alias("bits"))
    blocks = words.groupBy("_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("_bits"))
    met = df.withColumn("_at", place(column)).withColumn("_block", F.shiftright("_at", 16)).join(F.broadcast(blocks), "_block")
    bit = F.getbit(F.get("_bits", F.shiftright("_at", 6).bitwiseAND(F.lit(1023)).cast("int")), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))
    return met.where(bit == 1).select(*df.columns)


def salted_lookup(df: DataFrame, dictionary: DataFrame, keys: list[str], frequent: Column, spread: Column, salts: int) -> DataFrame:
    """Left join with a dictionary whose `frequent` entries (a condition on the keys alone) stand `salts` times in it.

    Rows of a frequent key are dealt by a hash of `spread`, so one key isn't one task; entries of other keys stand once.
    """
    often = F.coalesce(frequent, F.lit(False))
    salt = F.when(often, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    entries = dictionary.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return df.withColumn("_salt", salt).join(entries, [*keys, "_salt"], "left").drop("_salt")


def reports(df: DataFrame, key: list[str], at: str, value: str, source: str) -> DataFrame:
    """One report per key and date: the value of the greatest (source, value). Null values are no reports."""
    rows = timelines(df, key, at, value, source).select(*key, F.explode("line").alias("x"))
    return rows.select(*key, F.col("x.at").alias(at), F.col("x.value").alias(value), F.col("x.source").alias(source))


def revisable(df: DataFrame, key: list[str], at: str, value: str, source: str, share: str) -> DataFrame:
    """Keys reported on several dates: first and last report, number of reports and values, and `is_revised`.

    A key is revised if its last reported value departs from the first one materially; `first_revision_filed_date` and
    `revising_adsh` are those of the first report that departed. Reported and taken back is no revision.
    """
    found = repeated_timelines(df, key, at, value, source)
    found = found.withColumns({"first": F.col("line")[0], "last": F.element_at("line", -1)})
    departed = F.filter("line", lambda x: material(F.col("first.value"), x["value"], share))
    found = found.withColumns({"departed": F.get(departed, F.lit(0)), "is_revised": material(F.col("first.value"), F.col("last.value"), share)})
    return found.select(
        *key,
        *(F.col(f"{end}.{x}").alias(f"{name}_{label}") for end, name in (("first", "first"), ("last", "latest")) for x, label in (("value", "reported_value"), ("at", "filed_date"), ("source", "adsh"))),
        F.size("line").cast("long").alias("n_reports"),
        F.size(F.array_distinct("line.value")).cast("long").alias("n_distinct_values"),
        (F.col("last.value") - F.col("first.value")).alias("absolute_revision"),
        F.col("departed.at").alias("first_revision_filed_date"),
        F.col("departed.source").alias("revising_adsh"),
        "is_revised",
    )


def revisions(df: DataFrame, key: list[str], at: str, value: str, source: str, share: str) -> DataFrame:
    """Keys whose last reported value departs from the first one materially."""
    return revisable(df, key, at, value, source, share).where("is_revised").drop("is_revised")


def chains(df: DataFrame, key: list[str], at: str, value: str, source: str, share: str) -> DataFrame:
    """Material changes from one report to the next, walked in order inside each key's array.

    Gives the length, the first and last value, the dates of the first and last step, and the path of sources.
    """
    found = repeated_timelines(df, key, at, value, source)
    pairs = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("old"), F.slice("line", 2, F.size("line") - 1).alias("new"))
    walk = F.filter(pairs, lambda p: material(p["old"]["value"], p["new"]["value"], share))
    out = found.withColumn("walk", walk).where("size(walk) > 0")
    begin, end = F.col("walk")[0], F.element_at("walk", -1)
    path = F.concat(F.array(begin["old"]["source"]), F.transform("walk", lambda p: p["new"]["source"]))
    return out.select(*key, F.size("walk").alias("chain_length"), begin["old"]["value"].alias("first_value"), end["new"]["value"].alias("latest_value"), begin["old"]["at"].alias("first_step_from"), end["new"]["at"].alias("last_step_at"), path.alias("path"))


def islands(df: DataFrame, key: str, order: list[str], flag: str, at: str) -> DataFrame:
    """Runs of flagged rows in each key's own sequence: key, run_length, run_start, run_end."""
    line = Window.partitionBy(key).orderBy(*order)
    flagged = df.withColumn("_seq", F.row_number().over(line)).where(F.col(flag))
    flagged = flagged.withColumn("_island", F.col("_seq") - F.row_number().over(Window.partitionBy(key).orderBy("_seq")))
    return flagged.groupBy(key, "_island").agg(F.count("*").alias("run_length"), F.min(at).alias("run_start"), F.max(at).alias("run_end")).drop("_island")


def strictly_prior(queries: DataFrame, events: DataFrame, key: str, at: str, counts: dict[str, Column], few: bool = False) -> DataFrame:
    """For each query row, totals over the key's events on earlier dates. Null keys have none.

    Events are summed per key and day first, so a running sum sees days, not rows. With `few` keys (their days fit a
    broadcast) the query rows stay where they are.
    """
    known = events.where(F.col(key).isNotNull()).groupBy(key, at).agg(*(c.alias(n) for n, c in counts.items()))
    asked = queries.select(key, at).where(F.col(key).isNotNull())
    daily = asked.unionByName(known, allowMissingColumns=True).groupBy(key, at).agg(*(F.max(n).alias(n) for n in counts))  # `known` has a day once
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select(key, at, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in counts))
    out = queries.join(F.broadcast(running) if few else running, [key, at], "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counts})


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str, carry: list[str]) -> DataFrame:
    """For each left row the last right row of its keys on or before its date; ties by `tie` ascending. Left join.

    Both sides are merged in order of time, one shuffle by the keys, and each left row takes the right row that was met
    last: work grows with the rows, however many right rows a key has. Null keys and dates match nothing.
    """
    met = F.struct(F.col(tie).alias("tie"), *(F.col(c).alias(c) for c in carry))
    known = right.where(" and ".join(f"{k} is not null" for k in [*keys, at]))
    both = known.select(*keys, at, F.col(tie).alias("_tie"), met.alias("_met"), F.lit(None).alias("_row")).unionByName(left.select(*keys, at, F.lit(None).cast(left.schema[tie].dataType).alias("_tie"), F.lit(None).alias("_met"), F.struct(*left.columns).alias("_row")))
    # of a date, right rows come first and the least of them last
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_row").isNotNull(), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_met", F.last("_met", ignorenulls=True).over(order)).where("_row is not null")
    return found.select("_row.*", F.col("_met.tie").alias(f"matched_{tie}"), *(F.col(f"_met.{c}").alias(f"matched_{c}") for c in carry))


def trailing(value: Column, keys: list[str], order: str, size: int) -> Column:
    """Mean of the `size` rows before this one."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1))


def dense_quarters(df: DataFrame, keys: list[str], quarter: str) -> DataFrame:
    """Every quarter from each key's first to its last."""
    ends = df.groupBy(*keys).agg(F.min(quarter).alias("_a"), F.max(quarter).alias("_b"))
    return ends.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 3 months)")).alias(quarter))


def delete_insert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the target whose key isn't in the batch, and the batch. Keys may repeat; new columns are added."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def fingerprint(df: DataFrame, key: list[str], value: str, at: str) -> DataFrame:
    """Row count, distinct keys (nulls count), sum, nulls and last date: equal after a rerun that changed nothing."""
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(F.struct(*key)).alias("distinct_keys"), F.sum(value).alias("value_sum"), F.count_if(F.col(value).isNull()).alias("null_values"), F.max(at).alias("max_date"))
