"""A clinic's sales ledger: duplicates, receipts that net to zero, daily figures, masters and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numbers import set_key
from tidewell.functions.text import UNKNOWN_CUSTOMER, UNKNOWN_PATIENT
from tidewell.operators.similarity import similar_sets

MONEY = "decimal(18,2)"
RECEIPT = ("hospital_id", "service_date", "customer")


def _receipt_key() -> Column:
    return F.lower(F.trim("receipt"))


def known(ledger: DataFrame) -> DataFrame:
    """FLT-12: lines of customers and patients that are known; nulls go too."""
    return ledger.where((F.col("customer") != UNKNOWN_CUSTOMER) & (F.col("patient") != UNKNOWN_PATIENT))


def net_zero_receipts(ledger: DataFrame) -> DataFrame:
    """AGG-06: receipts whose lines add up to exactly zero; only one chart system reverses receipts that way."""
    rows = ledger.where("chart_type = 'intovet' and trim(receipt) <> ''")
    return rows.groupBy(*RECEIPT, _receipt_key().alias("receipt_key")).agg(F.sum("amount").alias("total"), F.count("*").alias("n_lines")).where("total = 0").drop("total")


def without_net_zero(ledger: DataFrame) -> DataFrame:
    """JN-05: the ledger without lines of receipts that net to zero."""
    keyed = ledger.withColumn("receipt_key", _receipt_key()).withColumn("nets", F.col("chart_type") == "intovet")
    zero = net_zero_receipts(ledger).select(*RECEIPT, "receipt_key", F.lit(True).alias("nets"))
    return keyed.join(zero, [*RECEIPT, "receipt_key", "nets"], "left_anti").select(*ledger.columns)


def net_receipts(ledger: DataFrame) -> DataFrame:
    """AGG-07: one row a receipt that does not net to zero."""
    rows = ledger.where("chart_type = 'intovet'").groupBy(*RECEIPT, _receipt_key().alias("receipt_key"))
    return rows.agg(F.min("patient").alias("patient"), F.count("*").alias("n_lines"), F.sum("amount").cast(MONEY).alias("amount")).where("amount <> 0")


def visit_key() -> Column:
    """What makes a visit in each chart system; null for unknown customers or patients."""
    key = F.when((F.col("chart_type") == "intovet") & (F.trim("receipt") != ""), F.concat_ws("|", "customer", F.lit("receipt"), _receipt_key()))
    key = key.when(F.col("chart_type") == "efriends", F.concat_ws("|", "customer", F.lit("visit"))).otherwise(F.concat_ws("|", "customer", "patient"))
    return F.when((F.col("customer") != UNKNOWN_CUSTOMER) & (F.col("patient") != UNKNOWN_PATIENT), key)


def daily_kpis(ledger: DataFrame) -> DataFrame:
    """AGG-08: sales and visits of each day, without receipts that net to zero."""
    return without_net_zero(ledger).groupBy("hospital_id", "chart_type", "service_date").agg(F.sum("amount").cast(MONEY).alias("sales_amount"), F.countDistinct(visit_key()).alias("visit_count"))


def first_visits(ledger: DataFrame) -> DataFrame:
    """The first day of each known customer."""
    return known(ledger).groupBy("hospital_id", "chart_type", "customer").agg(F.min("service_date").alias("first_visit_date"))


def new_customers(ledger: DataFrame) -> DataFrame:
    """AGG-09: customers whose first day it is."""
    return first_visits(without_net_zero(ledger)).groupBy("hospital_id", "chart_type", F.col("first_visit_date").alias("service_date")).agg(F.count("*").alias("new_customer_count"))


def recounted(kpis: DataFrame, masters: DataFrame) -> DataFrame:
    """AGG-12: days with new customers counted from the masters; 0 where nobody started."""
    started = masters.groupBy("hospital_id", "chart_type", F.col("first_visit_date").alias("service_date")).agg(F.count("*").alias("n"))
    return kpis.join(started, ["hospital_id", "chart_type", "service_date"], "left").withColumn("new_customer_count", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def customer_master(ledger: DataFrame) -> DataFrame:
    """AGG-10."""
    return known(ledger).groupBy("hospital_id", "chart_type", "customer").agg(
        F.max(F.when(F.trim("receipt") != "", F.col("receipt"))).alias("latest_no"), F.min("service_date").alias("first_visit_date"), F.max("service_date").alias("last_seen_date")
    )


def customer_patients(ledger: DataFrame) -> DataFrame:
    """AGG-11."""
    return known(ledger).groupBy("hospital_id", "chart_type", "customer", "patient").agg(F.min("service_date").alias("first_seen_date"), F.max("service_date").alias("last_seen_date"))


def merged_master(existing: DataFrame, new: DataFrame, key: list[str], least: list[str], greatest: list[str], latest: list[str] = ()) -> DataFrame:
    """SNK-03: masters after an upload: least and greatest of dates, and for `latest` columns the new value if it has one."""
    both = existing.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)))
    kept = [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in greatest]
    kept += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("age_"))).alias(c) for c in latest]
    return both.groupBy(*key).agg(*kept)


def upserted(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-01: rows of new replace those of existing with the same key; keys with nulls never match."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def inserted(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-02: rows of new are added only where existing has no such key."""
    return existing.unionByName(new.join(existing.select(*key).distinct(), key, "left_anti"))


def newest_rows(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """WIN-02, WIN-05 and WIN-06: the first row of each key in an order, which should be total."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def collapsed(rows: DataFrame, key: str, row_no: str) -> DataFrame:
    """WIN-03: of rows with one key the last in the file; rows without a key all pass."""
    blank = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    return newest_rows(rows.where(~blank), [key], F.col(row_no).desc()).unionByName(rows.where(blank))


def numbered_keys(rows: DataFrame, key: str, row_no: str) -> DataFrame:
    """WIN-04: the second and later rows of a key in a file get a number after it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(row_no))
    return rows.withColumn("n_", n).withColumn("numbered_key", F.when(F.col("n_") > 1, F.concat(F.col(key), F.lit("|#"), F.col("n_").cast("string"))).otherwise(F.col(key))).drop("n_")


def resolved_owners(owners: DataFrame, identities: DataFrame, least: float = 0.3) -> DataFrame:
    """WIN-01 and JN-26: the customer with the most alike set of patients among those of the same owner's name, if they are
    alike enough; of equals the one with the smaller key.  owners and identities have owner and patients (an array).

    Sets are compared once each, whoever has them, and only those that share a rare patient."""
    first = identities.groupBy("owner", set_key("patients").alias("r_set")).agg(F.min("customer").alias("customer"))
    pairs = similar_sets(owners, identities, "patients", ["owner"], least).join(first, ["owner", "r_set"])
    best = pairs.groupBy("owner", "l_set").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "customer")).alias("best"))
    asked = owners.select("owner", "patients", set_key("patients").alias("l_set")).distinct()
    return asked.join(best, ["owner", "l_set"]).select("owner", "patients", F.col("best.customer").alias("customer"), (-F.col("best.far")).alias("similarity"))


def updated_from(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """JN-15: rows with the columns' values of the row of changes with their key, where there is one with a value."""
    new = changes.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns))
    both = rows.join(new, key, "left")
    return both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in rows.columns))


def without_failed_run(rows: DataFrame, run_id: int) -> DataFrame:
    """SNK-06: rows without those of a failed run that have no key to be found by again."""
    return rows.where(~((F.col("run_id") == run_id) & F.col("dedupe_key").isNull()))


def first_days(visits: DataFrame, key: str, day: str) -> DataFrame:
    """STM-02: each customer's first day."""
    return visits.groupBy(key).agg(F.min(day).alias(day))


def recounted_days(known: DataFrame, late: DataFrame, key: str, day: str) -> DataFrame:
    """STM-02: first days after late rows came, from the first days known so far and the late rows alone."""
    return first_days(known.select(key, day).unionByName(late.select(key, day)), key, day)
