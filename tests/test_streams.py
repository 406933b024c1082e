"""Streams of files: late rows, a restart, and the same windows as on tables."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import alerts, tables
from tidewell.streaming.months import MonthSums
from tidewell.streaming.tables import KeyedTable

ROWS = "id long, version long, value string"


def test_upserts_keep_the_newest_version_over_late_rows_and_a_restart(spark, tmp_path):
    source, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def load(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        alerts.start_upserts(spark.readStream.schema(ROWS).parquet(source), target, ["id"], "version", checkpoint).awaitTermination()
        return sorted(tuple(r) for r in alerts.latest(spark, target).collect())

    assert load([(1, 1, "a"), (2, 5, "b"), (2, 4, "older")]) == [(1, 1, "a"), (2, 5, "b")]
    assert load([(2, 3, "late"), (1, 2, "c"), (3, 1, "d")]) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "d")]


def test_windows_of_a_stream_are_those_of_a_table(spark, tmp_path):
    start = datetime(2024, 1, 1)
    errors = spark.createDataFrame([("f" if k % 3 else "g", start + timedelta(seconds=47 * k)) for k in range(60)], "fingerprint string, occurred_at timestamp")
    errors.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(errors.schema).parquet(f"file://{tmp_path}/in")
    run = alerts.error_windows(stream).writeStream.format("memory").queryName("windows_").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("fingerprint", F.col("window_start").cast("string"), "n").collect()))
    assert rows(spark.table("windows_")) == rows(alerts.error_windows(errors)) != []


def stored_files(path):
    return {p.parent.name.split("=")[1]: p for p in sorted((path / "data").rglob("*.parquet"))}


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table = KeyedTable(f"file://{tmp_path}/t", ("id",), "version", buckets=16)
    table.apply(spark.range(200).selectExpr("id", "1L as version", "'a' as value"))
    before = set((tmp_path / "t/data").iterdir())
    assert len(stored_files(tmp_path / "t")) == 16
    table.apply(spark.createDataFrame([(7, 2, "b"), (9, 0, "late")], ROWS))
    (made,) = set((tmp_path / "t/data").iterdir()) - before
    files = [p for p in made.rglob("*.parquet")]
    want = {r[0] for r in spark.createDataFrame([(7,), (9,)], "id long").selectExpr("pmod(xxhash64(id), 16)").collect()}
    assert {int(p.parent.name.split("=")[1]) for p in files} == want and len(files) == len(want)
    rows = {r["id"]: (r["version"], r["value"]) for r in table.read(spark).collect()}
    assert len(rows) == 200 and rows.pop(7) == (2, "b") and set(rows.values()) == {(1, "a")}
    assert {tuple(r) for r in table.read(spark, 0).collect()} == {(k, 1, "a") for k in range(200)}  # the version before is whole


def test_a_crash_before_the_manifest_changes_nothing_and_the_batch_runs_again(spark, tmp_path, monkeypatch):
    table = KeyedTable(f"file://{tmp_path}/t", ("id",), "version", buckets=4)
    table.apply(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROWS), "w", 0)
    batch = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], ROWS)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", broken)
        with pytest.raises(OSError):
            table.apply(batch, "w", 1)
    rows = lambda: sorted(tuple(r) for r in table.read(spark).collect())
    assert rows() == [(1, 1, "a"), (2, 1, "b")]
    assert table.apply(batch, "w", 1) and not table.apply(batch, "w", 1) and not table.apply(batch, "w", 0)
    assert rows() == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert table.apply(batch, "other", 0)  # another writer has numbers of its own
    folders = {p.name for p in (tmp_path / "t/data").iterdir()}
    assert len(folders) == 3  # what the crash left is gone


def test_two_writers_of_one_version_do_not_overwrite_each_other(spark, tmp_path):
    table = KeyedTable(f"file://{tmp_path}/t", ("id",), "version", buckets=2)
    table.apply(spark.createDataFrame([(1, 1, "a")], ROWS))
    files = tables._Files(spark, table.path)
    with pytest.raises(RuntimeError):
        table._commit(files, table._manifest(files) | {"parts": {}})
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 1, "a")]


def test_random_batches_with_deletions_are_a_fold_row_by_row(spark, tmp_path):
    r = random.Random(3)
    table = KeyedTable(f"file://{tmp_path}/t", ("k", "part"), "version", deleted="gone", buckets=3, generations=2, keep=2)
    want, serial = {}, 0
    for _ in range(8):
        batch = []
        for _ in range(r.randint(0, 12)):
            serial += 1
            row = (r.choice([None, 1, 2, 3, 4]), r.choice("xy"), r.randint(1, 30) * 1000 + serial, serial, r.random() < 0.3)
            batch.append(row)
            if row[:2] not in want or want[row[:2]][2] < row[2]:
                want[row[:2]] = row
        table.apply(spark.createDataFrame(batch, "k long, part string, version long, serial long, gone boolean"))
        found = sorted(map(str, map(tuple, table.read(spark).collect())))
        assert found == sorted(str(row) for row in want.values() if not row[4])
    kept = [p.name for p in (tmp_path / "t/manifests").iterdir() if p.name.isdigit()]
    assert len(kept) == 2 and len(list((tmp_path / "t/data").iterdir())) <= 6


def test_equal_versions_go_to_the_later_batch_and_an_empty_table_reads_as_none(spark, tmp_path):
    table = KeyedTable(f"file://{tmp_path}/t", ("id",), "version")
    assert table.read(spark) is None and table.number(spark) == -1
    table.apply(spark.createDataFrame([(1, 5, "first")], ROWS))
    table.apply(spark.createDataFrame([(1, 5, "second")], ROWS))
    assert [r["value"] for r in table.read(spark).collect()] == ["second"] and table.number(spark) == 1


def test_month_sums_after_random_changes_are_a_full_recount(spark, tmp_path):
    """Rows come, go and change over six batches of a stream; each batch reads the months that it touches only."""
    r = random.Random(8)
    schema = "hospital string, day date, value decimal(18,2), visit string, change int"
    sums = MonthSums(f"file://{tmp_path}/months", ("hospital",), "day", "value", "visit", buckets=8)
    there = []
    new = lambda: (r.choice(["a", "b", None]), date(2024, r.randint(1, 6), r.randint(1, 28)), Decimal(r.randint(-500, 900)) / 100, r.choice([None, "v1", "v2", "v3", "v4"]))
    for n in range(6):
        changes = []
        for _ in range(25):
            if there and r.random() < 0.45:
                old = there.pop(r.randrange(len(there)))
                changes.append((*old, -1))
                if r.random() < 0.5:
                    continue
            there.append(new())
            changes.append((*there[-1], 1))
        if n == 5:  # the last batch empties a hospital
            changes += [(*x, -1) for x in there if x[0] == "b"]
            there = [x for x in there if x[0] != "b"]
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        sums.start(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint").awaitTermination()
        want = {}
        for h, d, v, visit in there:
            w = want.setdefault((h, d.replace(day=1)), [Decimal(0), 0, set()])
            w[0], w[1] = w[0] + v, w[1] + 1
            w[2] |= {visit} - {None}
        found = {(x["hospital"], x["month"]): (x["value"], x["n_rows"], x["visits"]) for x in sums.read(spark).collect()}
        assert found == {k: (v, c, len(s)) for k, (v, c, s) in want.items()}


def test_a_months_batch_that_broke_off_between_its_tables_is_finished(spark, tmp_path, monkeypatch):
    schema = "hospital string, day date, value decimal(18,2), visit string, change int"
    sums = MonthSums(f"file://{tmp_path}/months", ("hospital",), "day", "value", "visit", buckets=2)
    sums.apply(spark.createDataFrame([("a", date(2024, 1, 1), Decimal(5), "v", 1)], schema), "w", 0)
    batch = spark.createDataFrame([("a", date(2024, 1, 2), Decimal(7), "v", 1), ("a", date(2024, 1, 3), Decimal(1), "u", 1)], schema)
    whole = KeyedTable.apply

    def broken(self, *args):
        if self.path.endswith("visits"):
            raise OSError("lost")
        return whole(self, *args)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "apply", broken)
        with pytest.raises(OSError):
            sums.apply(batch, "w", 1)
    sums.apply(batch, "w", 1)
    sums.apply(spark.createDataFrame([("a", date(2024, 1, 2), Decimal(7), "v", -1), ("a", date(2024, 1, 1), Decimal(5), "v", -1)], schema), "w", 2)
    assert [tuple(x) for x in sums.read(spark).collect()] == [("a", date(2024, 1, 1), Decimal(1), 1, 1)]


def test_a_lookup_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    table = KeyedTable(f"file://{tmp_path}/t", ("k", "sub"), "version", buckets=16, bucket_by=1)
    table.apply(spark.range(400).selectExpr("id % 40 as k", "id as sub", "1L as version"))
    found = table.lookup(spark.createDataFrame([(3,)], "k int"))
    assert sorted(r["sub"] for r in found.collect()) == list(range(3, 400, 40))
    assert {p.split("bucket_=")[1].split("/")[0] for p in found.inputFiles()} == {str(spark.sql("select pmod(xxhash64(3L), 16)").first()[0])}
