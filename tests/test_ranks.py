"""Places, tiles and percentiles against Spark's own one-task forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as ops
from tidemark.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    found = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, rng.random(), float(rng.randint(0, 5))])) for i in range(997)]
    return spark.createDataFrame([*found, (2000, "lone", 7.0), (2001, "none", None)], "id int, g string, v double").repartition(7).cache()


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_places_and_tiles(rows, groups):
    order = (F.desc_nulls_last("v"), F.asc("id"))
    w = Window.partitionBy(*groups).orderBy(*order)
    want = rows.select("id", F.row_number().over(w).alias("number"), F.count("*").over(Window.partitionBy(*groups)).alias("total"))
    assert sorted(ranks.numbered(rows, groups, *order).select("id", "_number", "_total").collect()) == sorted(want.collect())
    for k in (1, 7, 10, 2000):
        want = rows.select("id", F.ntile(k).over(w).alias("tile"))
        assert sorted(ranks.tiles(rows, groups, k, "tile", *order).select("id", "tile").collect()) == sorted(want.collect())


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_percentiles(rows, groups):
    shares = {"least": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}
    want = rows.where("v is not null").groupBy(*groups).agg(*(F.percentile("v", p).alias(n) for n, p in shares.items()))
    assert sorted(map(str, ranks.percentiles(rows, groups, "v", shares).collect())) == sorted(map(str, want.collect()))


def test_grouping_sets_with_and_without_a_buffer(rows, monkeypatch):
    df = rows.withColumn("h", F.col("id") % 3)
    sets, measures = [["g", "h"], ["g"], []], {"n": F.count("*")}
    spread = {"median": (F.col("v"), 0.5), "p90": (F.col("v"), 0.9), "low": (-F.col("v"), 0.25)}
    inline = sorted(map(str, ranks.grouped(df, sets, measures, spread, df).collect()))
    monkeypatch.setattr(ranks, "BUFFER", 10)
    assert sorted(map(str, ranks.grouped(df, sets, measures, spread, df).collect())) == inline
    assert len({x.split("level=")[1][0] for x in inline}) == 3


def test_distinct_counts(spark):
    """Distinct values at all levels, null keys and null values included; facts aren't expanded by sets and columns."""
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, *range(9)]), rng.choice([None, "p", "q"])) for _ in range(400)] + [("lone", "z", None, None)]
    df, sets = spark.createDataFrame(data, "g string, h string, v int, w string"), [["g", "h"], ["g"], []]
    got = ranks.grouped(df, sets, {"n": F.count("*")}, {}, df, {"vs": F.col("v"), "ws": F.when(F.col("v") > 3, F.col("w"))})
    want = {}
    for level, width in ((0, 2), (1, 1), (3, 0)):
        for r in data:
            n = want.setdefault((level, *(r[k] if k < width else None for k in range(2))), [0, set(), set()])
            n[0] += 1
            if r[2] is not None:
                n[1].add(r[2])
                if r[2] > 3 and r[3] is not None:
                    n[2].add(r[3])
    assert {(r.level, r.g, r.h): (r.n, r.vs, r.ws) for r in got.collect()} == {k: (n, len(v), len(w)) for k, (n, v, w) in want.items()}
    assert ranks.grouped(df.limit(0), sets[:2], {"n": F.count("*")}, {}, df, {"vs": F.col("v")}).collect() == []


def test_models_expand_rows_by_sets_only(spark, small):
    """An Expand makes a row for each grouping set, none for each distinct column as well."""
    from tidemark.plans import restated

    for model in (restated.m17_by_sector, restated.m18_by_statement, restated.m19_by_filer_size):
        text = model(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in text.splitlines() if "Expand [" in x):
            assert line.count("], [") <= 3 and "gid" not in line
        assert "count(distinct" not in text


def test_no_task_has_all_rows(rows):
    text = ranks.tiles(rows, [], 10, "tile", F.col("v"), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    one = [x for x in text.splitlines() if "SinglePartition" in x]
    assert len(one) <= 2  # counts by partition alone
    assert "rangepartitioning" not in text  # the sorted rows are read from where they were written


def test_latest_before_with_many_of_a_key(spark):
    rng = random.Random(3)
    some = lambda n, tag: [(f"{tag}{i:03d}", rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(1, 60)]), i) for i in range(n)]
    left, right = some(120, "l"), some(300, "r")
    frame = lambda x: spark.createDataFrame(x, "id string, k int, d int, v int").withColumn("at", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    got = ops.latest_before(frame(left), frame(right), ["k"], "at", "id", ["v"])
    want = {}
    for i, k, d, _ in left:
        near = [(-x[2], x[0], x[3]) for x in right if k is not None and d is not None and x[1] == k and x[2] is not None and x[2] <= d]
        want[i] = min(near)[1:] if near else (None, None)
    assert {r.id: (r.matched_id, r.matched_v) for r in got.collect()} == want
    text = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_models_are_the_same_without_a_buffer(spark, small, monkeypatch):
    from tidemark.plans import restated

    models = [restated.m17_by_sector, restated.m18_by_statement, restated.m19_by_filer_size, restated.m20_magnitude_distribution]
    whole = [sorted(map(str, m(spark, small).collect())) for m in models]
    monkeypatch.setattr(ranks, "BUFFER", 5)
    assert [sorted(map(str, m(spark, small).collect())) for m in models] == whole
