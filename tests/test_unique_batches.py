"""Batches of which the caller knows that no key comes twice."""

from tidewell.streaming.tables import KeyedTable


def test_unique_batches_give_the_same_table(spark, tmp_path):
    tables = [KeyedTable(f"file://{tmp_path}/{u}", ("k",), "version", buckets=4) for u in (False, True)]
    for version in range(3):
        batch = spark.range(10 * version, 30).selectExpr("id as k", f"cast({version} as long) as version", f"id * {version} as v")
        for table, unique in zip(tables, (False, True)):
            assert table.apply(batch, unique=unique)
    one, other = (sorted(map(tuple, t.read(spark).select("k", "version", "v").collect())) for t in tables)
    assert one == other and len(one) == 30 and one[-1] == (29, 2, 58)
