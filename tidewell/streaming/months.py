"""STM-07: a ledger's months, kept up to date by what changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.storage import written
from tidewell.streaming.tables import KeyedTable

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class MonthSums:
    """For each key and month the sum of a value, the number of rows and the number of distinct visits, below a path.

    Changes are rows with change +1 (inserted) or -1 (deleted; an update is one of each). Sums take the signed values; a counter
    a visit tells when it appears and when its last row goes. A batch reads its changes and the stored rows of the months in
    which they lie, nothing else. Visits that are null are not counted, rows without a day belong to no month."""

    path: str
    keys: tuple[str, ...]
    day: str
    value: str
    visit: str
    buckets: int = 64

    def _table(self, name: str, *more: str, deleted: str) -> KeyedTable:
        return KeyedTable(f"{self.path.rstrip('/')}/{name}", (*self.keys, "month", *more), "serial", deleted=deleted, buckets=self.buckets, bucket_by=len(self.keys) + 1)

    @property
    def sums(self) -> KeyedTable:
        return self._table("sums", deleted="gone")

    @property
    def visits(self) -> KeyedTable:
        return self._table("visits", self.visit, deleted="gone")

    def _added(self, table: KeyedTable, changes: DataFrame, counts: dict[str, str]) -> DataFrame:
        """changes (the key of table, and what to add to its counts, with their types) with before_ and the counts after."""
        old = table.lookup(changes)
        key = list(table.key)
        if old is None:
            old = changes.limit(0)
        old = old.select(*(F.col(k).alias(f"old_{k}") for k in key), *(F.col(c).alias(f"was_{c}") for c in counts))
        both = changes.join(old, [changes[k].eqNullSafe(old[f"old_{k}"]) for k in key], "left")
        zero = lambda c: F.coalesce(F.col(f"was_{c}"), F.lit(0))
        return both.select(*key, *(zero(c).alias(f"before_{c}") for c in counts), *((zero(c) + F.col(c)).cast(t).alias(c) for c, t in counts.items()))

    def apply(self, changes: DataFrame, writer: str = "", number: int | None = None) -> None:
        """Bring in a batch of changes. A batch that broke off between the two tables is finished when it is run again: what has
        its number is not brought in twice, and visits, which the other needs, are changed last."""
        spark = changes.sparkSession
        sign = F.col("change")
        month = F.trunc(self.day, "month").alias("month")
        rows = written(changes.where(F.col(self.day).isNotNull()).select(*self.keys, month, self.visit, F.col(self.value).cast(MONEY).alias("value_"), sign.alias("change")))
        months = [*self.keys, "month"]
        each = written(rows.where(F.col(self.visit).isNotNull()).groupBy(*months, self.visit).agg(F.sum("change").alias("n")).where("n <> 0"))
        seen = written(self._added(self.visits, each, {"n": "long"}))
        turned = (F.col("n") > 0).cast("int") - (F.col("before_n") > 0).cast("int")
        steps = seen.groupBy(*months).agg(F.sum(turned).alias("visits")).where("visits <> 0")
        plain = rows.groupBy(*months).agg(F.sum(F.coalesce("value_", F.lit(0)) * F.col("change")).cast(MONEY).alias("value"), F.sum("change").alias("n_rows"))
        none = F.lit(0).cast("long")
        delta = plain.withColumn("visits", none).unionByName(steps.select(*months, F.lit(0).cast(MONEY).alias("value"), none.alias("n_rows"), "visits"))
        delta = delta.groupBy(*months).agg(F.sum("value").cast(MONEY).alias("value"), F.sum("n_rows").alias("n_rows"), F.sum("visits").alias("visits"))
        made = self._added(self.sums, delta, {"value": MONEY, "n_rows": "long", "visits": "long"}).select(*months, "value", "n_rows", "visits")
        serial = lambda t: F.lit(t.number(spark) + 1).cast("long").alias("serial")
        self.sums.apply(made.select("*", serial(self.sums), (F.col("n_rows") == 0).alias("gone")), writer, number, True)
        self.visits.apply(seen.select(*months, self.visit, "n", serial(self.visits), (F.col("n") == 0).alias("gone")), writer, number, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """keys, month, value, n_rows and visits of the months that have rows."""
        return self.sums.read(spark).drop("serial", "gone")

    def start(self, stream: DataFrame, checkpoint: str):
        """Bring in a stream of changes until all that is there has been read."""
        merge = lambda batch, number: self.apply(batch, checkpoint, number)
        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
