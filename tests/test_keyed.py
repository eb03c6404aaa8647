"""Merges by key: moved keys, lost writers, and what is left on disk."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import keyed

D = dt.date


def rows(spark, *found):
    return spark.createDataFrame([(k, D(2020, m, 1) if m else None, v) for k, m, v in found], "k string, at date, v int")


def merge(spark, path, *found, **more):
    return keyed.merge(rows(spark, *found), path, "k", "at", **more)


def table(spark, path):
    return sorted((r.k or "", r["at"].month if r["at"] else 0, r.v) for r in keyed.read(spark, path).collect())


def months(path):
    return sorted(x for v in os.listdir(f"{path}/data") for x in os.listdir(f"{path}/data/{v}") if x.startswith("month="))


def test_a_key_that_moves_leaves_its_month(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merge(spark, path, ("a", 1, 1), ("b", 1, 2), ("b", 1, 3), ("c", 5, 4), (None, 5, 5))
    assert merge(spark, path, ("a", 4, 10), ("d", None, 6))
    assert table(spark, path) == [("", 5, 5), ("a", 4, 10), ("b", 1, 2), ("b", 1, 3), ("c", 5, 4), ("d", 0, 6)]
    merge(spark, path, ("c", 1, 7), (None, 4, 8), ("d", 2, 9))
    assert table(spark, path) == [("", 4, 8), ("a", 4, 10), ("b", 1, 2), ("b", 1, 3), ("c", 1, 7), ("d", 2, 9)]
    assert sorted(keyed.current(spark, path).months) == ["2020-01", "2020-02", "2020-04"]
    assert [r.k for r in keyed.read(spark, path, since="2020-04").orderBy("k").collect()] == [None, "a"]
    assert not merge(spark, path)  # nothing to merge


def test_months_that_no_key_of_the_batch_lies_in_are_not_touched(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, ("a", 1, 1), ("b", 2, 2), ("c", 3, 3))
    was = keyed.current(spark, path).months
    merge(spark, path, ("c", 2, 4))
    now = keyed.current(spark, path).months
    assert now["2020-01"] == was["2020-01"] and now["2020-02"] != was["2020-02"] and "2020-03" not in now


@pytest.mark.parametrize("at", ["_publish", "_write"])
def test_a_lost_writer_leaves_the_table_whole(spark, tmp_path, monkeypatch, at):
    path, calls, write = str(tmp_path / "t"), [], keyed._write
    merge(spark, path, ("a", 1, 1), ("b", 2, 2))
    before = table(spark, path)

    def lost(*args):
        calls.append(args)
        if at == "_write" and len(calls) == 1:
            return write(*args)  # the months are written, the index isn't
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, at, lost)
        with pytest.raises(OSError):
            merge(spark, path, ("a", 2, 9), ("c", 3, 3))
    assert table(spark, path) == before
    (tmp_path / "t/manifests/2").write_text('{"number": 2, "mon')  # one that was never finished
    assert table(spark, path) == before
    assert merge(spark, path, ("c", 3, 4)) and table(spark, path) == [*before, ("c", 3, 4)]
    assert months(path) == ["month=2020-01", "month=2020-02", "month=2020-03"]  # what the lost writer left is gone


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    path, publish = str(tmp_path / "t"), keyed._publish
    merge(spark, path, ("a", 1, 1))

    def late(*args):
        monkeypatch.setattr(keyed, "_publish", publish)
        merge(spark, path, ("b", 1, 2))
        publish(*args)

    monkeypatch.setattr(keyed, "_publish", late)
    with pytest.raises(RuntimeError):
        merge(spark, path, ("c", 1, 3))
    assert table(spark, path) == [("a", 1, 1), ("b", 1, 2)]


def test_columns_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merge(spark, path, ("a", 1, 1), ("b", 1, 2), stream="s", number=0)
    assert not merge(spark, path, ("a", 1, 5), stream="s", number=0)
    assert merge(spark, path, ("a", 1, 6), stream="other", number=0)
    keyed.merge(rows(spark, ("c", 2, 3)).withColumn("new", F.lit("x")), path, "k", "at", "s", 1)
    assert {(r.k, r.v, r.new) for r in keyed.read(spark, path).collect()} == {("a", 6, None), ("b", 2, None), ("c", 3, "x")}
    with pytest.raises(ValueError):
        keyed.merge(rows(spark, ("a", 1, 1)), path, "v", "at")
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"))
    for n in range(2, 6):
        merge(spark, path, ("a", n, n), stream="s", number=n)
    assert len(months(path)) <= 5 and len([x for x in os.listdir(f"{path}/manifests") if x.isdigit()]) == 1 + keyed.KEPT


def test_a_batch_is_written_once(spark, tmp_path, monkeypatch):
    """Straight to its months, with what stays of them beside it; no copy and no index."""
    path, wrote, write = str(tmp_path / "t"), [], keyed._write
    monkeypatch.setattr(keyed, "_write", lambda rows, *args: wrote.append(rows.count()) or write(rows, *args))
    merge(spark, path, ("a", 1, 1), ("b", 2, 2), ("c", 3, 3))
    assert wrote == [3] and sorted(os.listdir(path)) == ["data", "manifests"]
    merge(spark, path, ("a", 2, 4), ("d", 5, 5))
    assert wrote == [3, 2, 1]  # b stays in the month that a has come to
    assert table(spark, path) == [("a", 2, 4), ("b", 2, 2), ("c", 3, 3), ("d", 5, 5)]


def test_columns_made_after_dealing(spark, tmp_path):
    path = str(tmp_path / "t")
    columns = [F.concat("k", F.lit("!")).alias("key"), "k", "at", "v"]
    keyed.merge(rows(spark, ("a", 1, 1), ("b", 2, 2)), path, "key", "at", near="k", columns=columns, parts=3)
    keyed.merge(rows(spark, ("a", 2, 3), ("c", None, 4)), path, "key", "at", near="k", columns=columns)
    assert sorted((r.key, r.v) for r in keyed.read(spark, path).collect()) == [("a!", 3), ("b!", 2), ("c!", 4)]
    assert keyed.read(spark, path).columns == ["key", "k", "at", "v"]


def test_wider_types_and_fewer_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, ("a", 1, 1), ("b", 1, 2))
    keyed.merge(rows(spark, ("c", 1, 3)).withColumn("v", F.lit(1 << 40)), path, "k", "at")
    keyed.merge(rows(spark, ("d", 1, 3)).drop("v"), path, "k", "at")
    assert sorted((r.k, r.v) for r in keyed.read(spark, path).collect()) == [("a", 1), ("b", 2), ("c", 1 << 40), ("d", None)]


def test_a_table_with_an_index_of_former_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, ("a", 1, 1), ("b", 2, 2))
    (tmp_path / "t/keys/x/bucket=1").mkdir(parents=True)
    (tmp_path / "t/manifests/1").write_text((tmp_path / "t/manifests/1").read_text()[:-1] + ', "buckets": {"1": "keys/x/bucket=1"}}')
    (tmp_path / "t/manifests/.1.crc").unlink()
    merge(spark, path, ("a", 3, 3))
    assert table(spark, path) == [("a", 3, 3), ("b", 2, 2)]


def test_a_small_rest_against_a_large_batch(spark, tmp_path):
    """Few rows stay: the batch's keys are thinned out before they meet them. Null keys and keys that repeat among them."""
    path = str(tmp_path / "t")
    merge(spark, path, ("a", 1, 1), ("b", 1, 2), (None, 1, 3), ("e", 7, 4))
    merge(spark, path, *((f"x{i}", 1, i) for i in range(300)), ("a", 1, 5), ("a", 1, 6), (None, 1, 7))
    got = [x for x in table(spark, path) if not x[0].startswith("x")]
    assert got == [("", 1, 7), ("a", 1, 5), ("a", 1, 6), ("b", 1, 2), ("e", 7, 4)]
    assert keyed.read(spark, path).count() == 305
