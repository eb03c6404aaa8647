import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns
from tidemark.operators import bitemporal as ops
from tidemark.operators import expectations
from tidemark.sources import delimited

D = dt.date


def facts(spark, rows):
    return spark.createDataFrame([(k, D(2020, m, 1), Decimal(v) if v is not None else None, a) for k, m, v, a in rows], "k string, at date, value decimal(28,4), source string")


def revised(spark, *rows):
    return {r.k: r for r in ops.revisions(facts(spark, rows), ["k"], "at", "value", "source", "0.001").collect()}


def test_small_wobble_is_no_first_revision(spark):
    r = revised(spark, ("a", 1, "100", "x"), ("a", 2, "100.05", "y"), ("a", 3, "120", "z"))["a"]
    assert (r.first_revision_filed_date, r.revising_adsh, r.n_reports) == (D(2020, 3, 1), "z", 3)


def test_revised_and_restored_is_a_chain_only(spark):
    rows = [("a", 1, "100", "x"), ("a", 2, "120", "y"), ("a", 3, "100", "z")]
    assert revised(spark, *rows) == {}
    chain = ops.chains(facts(spark, rows), ["k"], "at", "value", "source", "0.001").first()
    assert (chain.chain_length, chain.path) == (2, ["x", "y", "z"])


def test_zero_nulls_and_one_date(spark):
    got = revised(spark, ("zero", 1, "0", "x"), ("zero", 2, "5", "y"), ("null", 1, None, "x"), ("null", 2, "5", "y"), ("day", 1, "1", "x"), ("day", 1, "2", "y"))
    assert list(got) == ["zero"] and got["zero"].absolute_revision == 5


def test_same_source_takes_the_higher_value(spark):
    got = ops.reports(facts(spark, [("a", 1, "3", "x"), ("a", 1, "7", "x"), ("a", 1, "9", "b")]), ["k"], "at", "value", "source").collect()
    assert [(r.value, r.source) for r in got] == [(7, "x")]


def test_versions(spark):
    rows = [(1, D(2020, 1, 1), "a", None), (1, D(2020, 1, 1), "b", "full"), (1, D(2020, 2, 1), "b", "full"), (1, D(2020, 3, 1), None, "full"), (2, D(2020, 5, 5), "c", None)]
    v = ops.scd2(spark.createDataFrame(rows, "k int, at date, name string, more string"), "k", "at", ["name"], F.col("more").isNotNull().desc(), F.asc_nulls_last("name"))
    got = [(r.k, r.name, r.valid_from, r.valid_to, r.is_current) for r in v.orderBy("k", "valid_from").collect()]
    assert got == [(1, "b", D(2020, 1, 1), D(2020, 2, 29), False), (1, None, D(2020, 3, 1), D(9999, 12, 31), True), (2, "c", D(2020, 5, 5), D(9999, 12, 31), True)]
    assert expectations.no_overlap(v, "k").count() == 0
    at = ops.valid_at(spark.createDataFrame([(1, D(2020, 2, 29)), (1, D(2020, 3, 1)), (1, D(2019, 1, 1))], "k int, d date"), v.withColumnRenamed("at", "x"), "k", "d")
    assert sorted((str(r.d), r.name) for r in at.collect()) == [("2020-02-29", "b"), ("2020-03-01", None)]


def test_islands(spark):
    rows = [(1, i, f) for i, f in enumerate([True, True, True, False, True])]
    got = ops.islands(spark.createDataFrame(rows, "k int, i int, f boolean"), "k", ["i"], "f", "i").collect()
    assert sorted((r.run_length, r.run_start, r.run_end) for r in got) == [(1, 4, 4), (3, 0, 2)]


def test_events_of_the_day_are_not_prior(spark):
    q = spark.createDataFrame([(1, D(2020, 1, 2)), (1, D(2020, 1, 3)), (None, D(2020, 1, 3)), (2, D(2020, 1, 3))], "k int, at date")
    e = spark.createDataFrame([(1, D(2020, 1, 2)), (1, D(2020, 1, 2)), (None, D(2020, 1, 1))], "k int, at date")
    got = ops.strictly_prior(q, e, "k", "at", {"n": F.count("*")}).collect()
    assert sorted((r.k or 0, r["at"].day, r.n) for r in got) == [(0, 3, 0), (1, 2, 0), (1, 3, 2), (2, 3, 0)]


def test_latest_before(spark):
    left = spark.createDataFrame([("l1", 1, D(2020, 5, 1)), ("l2", 2, D(2020, 5, 1))], "id string, k int, at date")
    right = spark.createDataFrame([("r1", 1, D(2020, 4, 1)), ("r3", 1, D(2020, 5, 1)), ("r2", 1, D(2020, 5, 1)), ("r4", 1, D(2020, 6, 1))], "id string, k int, at date")
    got = {r.id: r.matched_id for r in ops.latest_before(left, right, ["k"], "at", "id", ["at"]).collect()}
    assert got == {"l1": "r2", "l2": None}


def test_incremental_rerun_changes_nothing(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int").withColumn("at", F.lit("2020-01-01"))
    again = ops.delete_insert(t, t.where("k = 'b'"), "k")
    assert ops.fingerprint(again, ["k"], "v", "at").collect() == ops.fingerprint(t, ["k"], "v", "at").collect()
    wider = ops.delete_insert(t, t.where("k = 'b'").withColumn("new", F.lit(1)), "k")
    assert wider.columns[-1] == "new" and wider.where("new is null").count() == 1


def test_columns(spark):
    df = spark.createDataFrame([("1.5e3", "20230231"), (".5", "20240229"), ("+1", "2023-01-01"), ("1,000", ""), ("-2", None), ("7\n", "20230101\n")], "n string, d string")
    got = df.select(columns.safe_numeric(F.col("n")), columns.yyyymmdd(F.col("d"))).collect()
    assert [x[0] for x in got] == [1500, None, None, None, -2, None]
    assert [x[1] for x in got] == [None, D(2024, 2, 29), None, None, None, None]
    days = spark.createDataFrame([(D(2024, 3, 30),), (D(2024, 3, 31),), (D(2024, 4, 1),)], "d date").select(columns.next_weekday(F.col("d"))).collect()
    assert [x[0] for x in days] == [D(2024, 4, 1)] * 3


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    parent = spark.createDataFrame([(2,)], "id int")
    got = expectations.report(
        {"unique": (expectations.unique(df, "k"), 0, 200), "null": (expectations.not_null(df, "k"), 0, 0), "values": (expectations.accepted_values(df, "v", ["a", "b", "c"]), 0, 0), "parent": (expectations.relationship(df, "k", parent, "id"), 0, 1), "range": (expectations.accepted_range(df, "k", 0, 1), 0, 0)}
    )
    assert {r.name: (r.failures, r.severity) for r in got.collect()} == {"unique": (1, "warn"), "null": (1, "error"), "values": (0, "pass"), "parent": (2, "error"), "range": (0, "pass")}


def test_delimited(spark, tmp_path):
    for q, text in (("2020q4", 'a\tb\r\n1\t"x\r\n\r\n2\t\r\n3\ty\tz\r\n4\r\n'), ("2021q1", "a\tb\tc\n5\tv\tw\n")):
        (tmp_path / q).mkdir()
        (tmp_path / q / "NUM.txt").write_bytes(text.encode())
    assert delimited.quarters("2019q4", "2020q2") == ["2019q4", "2020q1", "2020q2"]
    rows, rejects = delimited.load(spark, str(tmp_path), ["2020q3", "2020q4", "2021q1"], "num")
    assert sorted(map(tuple, rows.select("a", "b", "c", "source_quarter").collect())) == [("1", '"x', None, "2020q4"), ("2", None, None, "2020q4"), ("5", "v", "w", "2021q1")]
    assert [tuple(r) for r in rejects.collect()] == [("2020q4", "num.txt", 2, 2)]
    with pytest.raises(FileNotFoundError):
        delimited.load(spark, str(tmp_path), ["2020q4"], "tag")
    delimited.land(rows, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).where("source_quarter = '2021q1'").count() == 1


def test_coarser_timelines(spark):
    """Merged timelines are those of the facts, ties and null keys included."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.randint(1, 4), rng.choice([None, 1, 2, 3]), rng.choice("pq")) for _ in range(200)]
    facts = spark.createDataFrame(rows, "k string, s string, at int, value int, source string")
    fine = ops.timelines(facts, ["k", "s"], "at", "value", "source")
    plain = lambda df: sorted(map(str, df.select("k", "line").collect()))
    assert plain(ops.coarser_timelines(fine, ["k"])) == plain(ops.timelines(facts, ["k"], "at", "value", "source"))
    empty = ops.coarser_timelines(ops.timelines(facts.limit(0), ["k", "s"], "at", "value", "source"), ["k"])
    assert empty.count() == 0


def test_salted_lookup(spark):
    """Equal to the plain left join, for frequent, rare, unknown and null keys."""
    rows = spark.createDataFrame([(i, ["hot", "rare", None, "unknown/1"][min(i % 9, 3)] if i % 2 else "hot/1") for i in range(300)], "id int, key string")
    words = spark.createDataFrame([("hot/1", 1), ("hot", 2), ("rare", 3), (None, 4), ("never/2", 5)], "key string, entry int")
    got = ops.salted_lookup(rows, words, ["key"], F.contains("key", F.lit("/")), F.col("id"), 5)
    assert got.columns == ["key", "id", "entry"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(words, "key", "left").collect()))


def test_repeated_timelines(spark):
    """The timelines of several dates, without collecting keys of one date: nulls in keys and dates, dates twice."""
    rows = [("a", D(2020, 1, 1), "x", 1), ("a", D(2020, 1, 1), "y", 2), ("a", D(2020, 2, 1), "x", 3), ("b", D(2020, 1, 1), "x", 1), ("b", D(2020, 1, 1), "y", 1), (None, D(2020, 1, 1), "x", 1), (None, D(2020, 3, 1), "x", None), (None, D(2020, 4, 1), "x", 5), ("c", None, "x", 1), ("c", D(2020, 1, 1), "x", 2), ("d", None, "x", 1), ("e", D(2020, 5, 1), "x", 1)]
    df = spark.createDataFrame(rows, "k string, at date, source string, value int")
    got = ops.repeated_timelines(df, ["k"], "at", "value", "source")
    want = ops.timelines(df, ["k"], "at", "value", "source").where("size(line) > 1")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text.rpartition("Exchange hashpartitioning")[2]  # none before the shuffle


def test_split_lookup(spark):
    rows = spark.createDataFrame([(1, "a/1"), (2, "a/1"), (3, "own"), (4, "a/2"), (5, "other"), (6, None)], "id int, key string")
    words = spark.createDataFrame([("a/1", 10), ("own", 20)], "key string, word int")
    got = ops.split_lookup(rows, words, ["key"], F.contains("key", F.lit("/")))
    assert {r.id: r.word for r in got.collect()} == {1: 10, 2: 10, 3: 20, 4: None, 5: None, 6: None}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_perhaps_in(spark):
    """No key is lost, few others stay, at one block of bits and at several; a null is a key."""
    rows = spark.range(200_000).select(F.when(F.col("id") > 0, F.concat(F.lit("f"), F.col("id"))).alias("k"), "id")
    for least, expected in ((199_000, 10), (150_000, 50_000)):
        keys = rows.where(f"id >= {least} or id = 0").select("k")
        got = ops.perhaps_in(rows, F.col("k"), keys, expected)
        assert got.columns == rows.columns and got.join(keys, got.k.eqNullSafe(keys.k), "left_semi").count() == 200_001 - least
        assert got.count() < 1.2 * (200_000 - least) + 4000
    assert ops.perhaps_in(rows, F.col("k"), rows.where("id < 0").select("k"), 0).count() == 0
