"""A stream of facts against a full build."""

import os

from pyspark.sql import functions as F

from tidemark.plans import marts
from tidemark.sources import keyed, store
from tidemark.streaming import facts as stream


def test_stream_of_facts(spark, small, tmp_path):
    """From nothing, with keys that arrive twice, a restart, a late fact and a batch that is run again."""
    path, source, check = str(tmp_path / "fact"), str(tmp_path / "arriving"), str(tmp_path / "check")
    whole = marts.fact_table(spark, small).persist()
    late = whole.where("filed_date between date '1998-06-10' and date '1998-06-20'")
    run = lambda: stream.follow(stream.arriving(spark, whole, source, 1), path, check, once=True).awaitTermination()
    shared = store.folder(spark).removeprefix("file:")
    folders = lambda: len([x for x in os.listdir(shared) if x.startswith("merge-batch")])
    before = folders()
    for low, high in (("1990-01-01", "1998-01-01"), ("1997-12-15", "2002-01-01")):  # overlapping
        whole.where(f"filed_date between date '{low}' and date '{high}'").exceptAll(late).coalesce(2).write.mode("append").parquet(source)
        run()
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    got = keyed.read(spark, path).select(*whole.columns)
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    last = keyed.current(spark, path)
    (number,) = last.batches.values()
    assert not marts.merge_facts(whole.limit(1).withColumn("value", F.lit(0).cast("decimal(28,4)")), path, check, number)
    assert keyed.current(spark, path) == last
    assert folders() == before and len(os.listdir(f"{path}/manifests")) <= 2 * (1 + keyed.KEPT)  # with their checksums
    whole.unpersist()
