"""The refresh store: what a batch writes, replays, broken stores, equality with one merge of everything."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ingest
from tidewater.streaming import refresh

DAY = dt.date(2015, 1, 1)


def batch(spark, rows, at):
    arrived = dt.datetime(2024, 1, at)
    return spark.createDataFrame([(s, d, v, arrived) for s, d, v in rows], refresh.SCHEMA)


def files(store):
    out = {}
    for folder, _, names in os.walk(f"{store}/observations"):
        out |= {f"{folder}/{n}": os.path.getmtime(f"{folder}/{n}") for n in names if n.endswith(".parquet")}
    return out


def held(spark, store):
    return {(r.series_id, r.date): r.value for r in refresh.stored(spark, store, "observations").collect()}


def test_batch_writes_what_it_touches(spark, tmp_path):
    store = str(tmp_path / "store")
    first = [(f"s{i:03d}", DAY + dt.timedelta(days=30 * k), float(i + k)) for i in range(100) for k in range(60)]
    refresh.merge_batch(batch(spark, first, 1), 0, store, "M", buckets=20)
    before = files(store)
    revised = [("s007", DAY + dt.timedelta(days=30 * 59), -1.0), ("s007", DAY + dt.timedelta(days=30 * 60), 5.0), ("new", DAY, 1.0)]
    refresh.merge_batch(batch(spark, revised, 2), 1, store, "M", buckets=20)
    after = files(store)
    assert len(after.keys() - before.keys()) <= 2 and len(before.keys() - after.keys()) <= 2
    want = {(s, d): v for s, d, v in first + revised}
    assert held(spark, store) == want
    commits = {r.batch: r for r in refresh.stored(spark, store, "commits").collect()}
    assert (commits[1].rows_added, commits[1].rows_changed, commits[1].series, commits[1].partitions) == (2, 1, 2, 2)
    # a replay changes no file; the same rows as another batch no row
    refresh.merge_batch(batch(spark, revised, 2), 1, store, "M", buckets=20)
    assert files(store) == after
    refresh.merge_batch(batch(spark, revised, 3), 2, store, "M", buckets=20)
    assert held(spark, store) == want and refresh.stored(spark, store, "commits").filter("batch = 2 AND rows_added + rows_changed = 0").count() == 1
    # log and metadata: only what came is stamped; hashes are those of whole series
    log = {r.series_id: r for r in refresh.update_log(spark, store).collect()}
    hashes = {r.series_id: (r.n, r.content_hash) for r in ingest.content_hash(refresh.stored(spark, store, "observations")).collect()}
    assert {s: (r.n, r.last_value_hash) for s, r in log.items()} == hashes
    assert log["s007"].last_observation_date == DAY + dt.timedelta(days=1800)
    stamps = {r.series_id: r.last_refreshed.day for r in refresh.stored(spark, store, "metadata").collect()}
    assert stamps == {**{f"s{i:03d}": 1 for i in range(100)}, "s007": 3, "new": 3} and {s: r.last_fetched_at.day for s, r in log.items()} == stamps


def test_broken_off_batch_is_run_again(spark, tmp_path, monkeypatch):
    """A batch that failed after its observations were written gives, run again, the same store as at first."""
    store, other = str(tmp_path / "a"), str(tmp_path / "b")
    one = batch(spark, [("s", DAY, 1.0), ("t", DAY, 2.0)], 1)
    two = batch(spark, [("s", DAY, 3.0), ("s", DAY + dt.timedelta(1), 4.0), ("s", DAY + dt.timedelta(1), None)], 2)
    plain = refresh._overwrite

    def breaks(df, place, table):
        if table == "log":
            raise RuntimeError("lost")
        plain(df, place, table)

    refresh.merge_batch(one, 0, store)
    monkeypatch.setattr(refresh, "_overwrite", breaks)
    with pytest.raises(RuntimeError):
        refresh.merge_batch(two, 1, store)
    monkeypatch.setattr(refresh, "_overwrite", plain)
    refresh.merge_batch(two, 1, store)
    for n, b in enumerate((one, two)):
        refresh.merge_batch(b, n, other)
    assert held(spark, store) == held(spark, other) == {("s", DAY): 3.0, ("t", DAY): 2.0, ("s", DAY + dt.timedelta(1)): 4.0}
    for table in ("log", "metadata", "late", "commits"):
        assert sorted(refresh.stored(spark, store, table).collect()) == sorted(refresh.stored(spark, other, table).collect()), table


def test_missing_table_of_a_store_fails(spark, tmp_path):
    store = str(tmp_path / "store")
    refresh.merge_batch(batch(spark, [("s", DAY, 1.0)], 1), 0, store)
    os.rename(f"{store}/observations", f"{store}/gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        refresh.stored(spark, store, "observations").count()
    assert refresh.stored(spark, str(tmp_path / "none"), "observations").count() == 0


def test_late_rows_merged_or_aside(spark, tmp_path):
    for late, value in (("merge", 9.0), ("aside", 1.0)):
        store = str(tmp_path / late)
        refresh.merge_batch(batch(spark, [("s", DAY, 1.0), ("s", DAY + dt.timedelta(400), 2.0)], 1), 0, store, late=late)
        refresh.merge_batch(batch(spark, [("s", DAY, 9.0)], 2), 1, store, late=late)
        assert held(spark, store)[("s", DAY)] == value
        assert refresh.stored(spark, store, "late").select(F.sum("value")).first()[0] == 9.0


def test_sweeping_leaves_other_threads_tables(spark, tmp_path):
    """A block clears what its own thread wrote, nested blocks included; a table of another thread stays."""
    from threading import Thread

    from tidewater.functions.stored import swept, written

    made = {}
    with swept(spark):
        made["own"] = written(spark.range(3), "own")
        thread = Thread(target=lambda: made.update(other=written(spark.range(4), "other")))
        thread.start()
        thread.join()
        with swept(spark):
            made["inner"] = written(spark.range(5), "inner")
        assert made["own"].count() == 3
        paths = {k: v.inputFiles()[0].removeprefix("file://") for k, v in made.items() if k != "inner"}
    assert made["other"].count() == 4 and os.path.exists(paths["other"]) and not os.path.exists(paths["own"])
