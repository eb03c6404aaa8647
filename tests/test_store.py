"""Stored models follow their sources."""

import os
import shutil

from pyspark.sql import functions as F

from tidemark.plans import catalog, marts
from tidemark.plans import tables as t
from tidemark.sources import store


def copy_of(small, tmp_path):
    shutil.copytree(small, tmp_path / "tables")
    return str(tmp_path / "tables")


def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def replace(spark, sf, df):
    df.coalesce(1).write.parquet(f"{sf}/new")
    os.remove(f"{sf}/orders.parquet")
    os.rename(f"{sf}/new", f"{sf}/orders.parquet")


def folders(spark, name):
    return sorted(x for x in os.listdir(store.folder(spark).removeprefix("file:")) if x.startswith(f"{name}-"))


def test_a_changed_source_is_noticed(spark, small, tmp_path):
    sf = copy_of(small, tmp_path)
    before = folders(spark, "company")
    assert catalog.QUERIES["m06_company"](spark, sf).count() > 1000
    own = set(folders(spark, "company")) - set(before)
    assert catalog.QUERIES["m06_company"](spark, sf).count() > 1000 and set(folders(spark, "company")) - set(before) == own
    few = orders(spark, sf).orderBy("o_orderkey").limit(100)
    n = few.select("o_custkey").distinct().count()
    replace(spark, sf, few)
    assert catalog.QUERIES["m06_company"](spark, sf).select("cik").distinct().count() == n
    now = set(folders(spark, "company")) - set(before)
    assert len(now) == 1 and now != own  # the old files are gone


def test_only_what_reads_a_source_is_built_again(spark, small, tmp_path):
    sf, built = copy_of(small, tmp_path), []

    @store.stored
    def sizes(spark, sf):
        built.append("sizes")
        return t.table(spark, sf, "orders").agg(F.count("*").alias("n"))

    @store.stored
    def names(spark, sf):
        built.append("names")
        return t.table(spark, sf, "region").select("r_name")

    @store.stored
    def both(spark, sf):
        built.append("both")
        return names(spark, sf).crossJoin(F.broadcast(sizes(spark, sf)))  # one row

    first = both(spark, sf).first().n
    both(spark, sf), names(spark, sf)
    assert sorted(built) == ["both", "names", "sizes"]
    replace(spark, sf, orders(spark, sf).limit(7))
    assert both(spark, sf).first().n == 7 != first
    assert sorted(built) == ["both", "both", "names", "sizes", "sizes"]


def test_refresh_deletes_files(spark, small):
    marts.company(spark, small).count()
    assert folders(spark, "company")
    store.refresh()
    assert not folders(spark, "company")
