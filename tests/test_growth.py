"""What a task holds, how often facts are read and what is made for nothing: plans of the models, and the same rows either way."""

import re

import pytest

from tidemark.plans import catalog, marts
from tidemark.plans import tables as t
from tidemark.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df):
    return sorted(str(r) for r in df.collect())


@pytest.fixture
def large(monkeypatch):
    """The smallest tables pass for large ones."""
    monkeypatch.setattr(t, "SHARE", 5000)
    store.refresh()
    yield
    store.refresh()


def test_partitions_follow_the_size_of_the_facts(spark, small, large):
    facts = plan(t.facts(spark, small))
    n = -(-store.size(spark, f"{small}/lineitem.parquet") // 5000)
    assert n > 4 and len(re.findall(rf"Exchange hashpartitioning\(adsh#\d+, {n}\)", facts)) == 2 and "SortMergeJoin" not in facts


def test_large_facts_give_the_same_changes(spark, small, large, monkeypatch):
    many = rows_of(marts._changes(spark, small))
    monkeypatch.setattr(t, "SHARE", 1 << 40)
    assert many and rows_of(marts._changes(spark, small)) == many


def test_patterns_need_no_deciles_and_no_names(spark, small):
    text = plan(catalog.QUERIES["d24_patterns"](spark, small))
    assert "numbered-" not in text and "company_name" not in text


def test_keys_of_one_date_are_told_in_one_window(spark, small):
    from tidemark.config import FACT_KEY
    from tidemark.operators import bitemporal as ops

    line = ops.repeated_timelines(t.facts(spark, small), FACT_KEY, "filed_date", "value", "adsh")
    assert len(re.findall(r"\bWindow \[", logical(line))) == 1


def test_versions_and_features_are_dealt_by_size(spark, small, large):
    """Filings go into as many partitions as their size asks for; versions come from one shuffle by company."""
    from tidemark.plans import features

    n = -(-store.size(spark, f"{small}/orders.parquet") // 5000)
    versions = plan(marts.company.__wrapped__(spark, small))
    assert n > 4 and versions.count("Exchange") - versions.count("BroadcastExchange") - versions.count("ReusedExchange") == 1 and f", {n}), REPARTITION_BY_NUM" in versions
    found = plan(features.periodic.__wrapped__(spark, small))
    assert re.search(rf"hashpartitioning\(adsh#\d+, {n}\), REPARTITION_BY_NUM", found) and re.search(rf"hashpartitioning\(cik#\d+L?, {n}\), REPARTITION_BY_NUM", found)
    m = -(-store.size(spark, f"{small}/lineitem.parquet") // 5000)
    assert len(re.findall(rf"hashpartitioning\(tag#\d+, taxonomy_version#\d+, {m}\), REPARTITION_BY_NUM", found)) == 2


def test_peers_read_the_facts_once(spark, small):
    """Both views, revenue, income and the year before come from one pass; the recheck needs none of its own."""
    from tidemark.plans import peers

    text = plan(peers.metrics.__wrapped__(spark, small))
    assert text.count("lineitem") == 1 and text.count("orders.parquet") == 1
    assert "lineitem" not in plan(catalog.QUERIES["d20_peer_rechecks"](spark, small))


def test_samples_move_no_facts(spark, small):
    """Facts of the sampled keys are found by broadcast; only their own reports are grouped."""
    text = plan(catalog.QUERIES["d16_sampled_sequences"](spark, small))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_chart_counts_only_what_it_shows(spark, small):
    """No distinct companies, no statuses of filings: counts by decile from one grouping."""
    text = logical(catalog.QUERIES["ch01_decile_rates"](spark, small))
    assert "Generate" not in text and "Expand" not in text and "orders" not in text and "filer_status" not in text


def moved(spark, run):
    """Rows that shuffles and writes of a run have moved."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {s.stageId() for s in stages()}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in stages() if s.stageId() not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.outputRecords() for s in new)


def test_an_incremental_fact_table_moves_a_fact_three_times(spark, small):
    """Once to its filing, once to its month and, in the second merge, its hash to the keys before; it is written once."""
    facts = t.numeric(spark, small).count()
    marts.company(spark, small)
    shuffled, wrote = moved(spark, lambda: catalog.QUERIES["snk03_incremental_fact"](spark, small))
    assert shuffled < 5 * facts and wrote < 1.2 * facts


def test_facts_are_dealt_to_months_before_their_keys_are_made(spark, small):
    """Shuffles carry no md5 text; facts of filings outside of the dates go before the shuffles."""
    located = marts._located(spark, small, until="1998-06-30")
    assert "md5(" not in plan(located).replace("company", "") and "getbit" in plan(located)
    assert located.select(*marts._fact_columns()).columns == marts.m05_fact(spark, small).columns
    assert "getbit" not in plan(marts.m05_fact(spark, small))
