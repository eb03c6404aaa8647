"""Each query against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


def plain(rows):
    def value(v):
        if v is None or v != v:
            return None
        return float(v) if hasattr(v, "as_tuple") else str(v)[:10] if hasattr(v, "year") else v

    return sorted(str([value(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, small, duck):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == plain([r[i] for i in order] for r in result.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_of_the_facts(spark, small):
    """Reports, revisions and chains come from one grouping of the facts."""
    from tidemark.config import FACT_KEY
    from tidemark.operators import bitemporal as ops
    from tidemark.plans import tables

    rows = tables.numeric(spark, small).withColumn("cik", tables.F.xxhash64("adsh")).withColumn("filed_date", tables.F.date_add("period_end_date", tables.F.col("qtrs")))
    for operator in (ops.revisable, ops.revisions, ops.chains):
        text = plan(operator(rows, FACT_KEY, "filed_date", "value", "adsh", "0.001"))
        assert text.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in text
    assert plan(ops.reports(rows, FACT_KEY, "filed_date", "value", "adsh")).count("Exchange hashpartitioning") == 1


def test_key_lists_share_one_shuffle_of_the_facts(spark, small):
    """Narrower keys are grouped where the repartition by the narrowest put the facts; samples group what they show."""
    import re

    text = plan(catalog.QUERIES["d06_key_sensitivity"](spark, small))
    by_tag = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\), ", text.replace("#", "")) if "tag" in x]
    assert len(by_tag) == 1 and "segments" not in by_tag[0]
    assert text.count("lineitem") == 1
    assert "LeftSemi" in plan(catalog.QUERIES["d16_sampled_sequences"](spark, small))


def test_filers_meet_the_filings_twice(spark, small):
    """Conflicts and balances meet the filings together; the facts meet them for their company."""
    assert plan(catalog.QUERIES["m13_filer_concentration"](spark, small)).partition("Initial Plan")[0].count("orders.parquet") <= 2


def test_features_scan_what_is_stored(spark, small):
    """Models that several queries share are written once; the features read them, not the facts again and again."""
    from tidemark.plans import features

    text = plan(features.point_in_time(features.base(spark, small)))
    assert text.count("FileScan") <= 10
    assert plan(features.m28_feature_pit(spark, small)).count("FileScan") == 1


def test_stored_models_are_built_again_after_a_refresh(spark, small):
    from tidemark.plans import marts
    from tidemark.sources import store

    first = marts.company(spark, small)
    assert marts.company(spark, small) is first
    store.refresh()
    assert marts.company(spark, small) is not first


def test_incremental_facts(spark, small, tmp_path):
    """An update reads its cut off the target, leaves earlier months alone and keeps keys that the source lost."""
    from pyspark.sql import functions as F

    from tidemark.plans import marts
    from tidemark.sources import keyed

    path = str(tmp_path / "fact")
    whole = marts.fact_table(spark, small).persist()
    marts.merge_facts(whole.where("filed_date <= date '1998-06-30'").withColumn("value", F.when(F.col("filed_date") >= F.lit("1998-06-15").cast("date"), F.lit(1).cast("decimal(28,4)")).otherwise(F.col("value"))), path)
    lost = whole.where("filed_date between date '1998-06-01' and date '1998-06-29'").orderBy("fact_sk").limit(1).withColumn("fact_sk", F.lit("gone from the source"))
    marts.merge_facts(lost, path)
    before = {f: v for f, v in files(path) if "month=1998-03" in f}
    marts.update_facts(spark, small, path)
    got = keyed.read(spark, path)
    assert before and {f: v for f, v in files(path) if "month=1998-03" in f} == before
    assert got.where("fact_sk = 'gone from the source'").count() == 1
    assert got.where("fact_sk <> 'gone from the source'").exceptAll(whole.select(*got.columns)).count() == 0
    assert got.count() == whole.count() + 1


def files(path):
    return [(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_keys_of_facts_are_made_after_the_shuffles(spark, small):
    """Published tags are looked up by broadcast, and no shuffle or stored copy carries the fact table's md5 keys as text."""
    from tidemark.plans import suite

    spark.catalog.clearCache()
    text = catalog.QUERIES["m05_fact"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("strategy=broadcast") >= 2 and text.lstrip().splitlines()[0].count("md5(") == 4
    assert suite.facts(spark, small).columns == ["fact_sk", "qtrs", "unknown_tag"]
