"""Queries on the token ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import billing as B
from tidewell.plans.fixtures import USAGE, table, usage
from tidewell.plans.registry import query

CHARGES = """
ops as (select hospital_id, operation_id, sum(cost_usd)::decimal(18,6) as cost_usd, min(feature) as feature, max(ts) as created_at from usage where hospital_id is not null group by all),
plain as (select *, ceil(cost_usd * 100)::bigint as p from ops),
charges as (select hospital_id, operation_id, cost_usd, feature, created_at,
    -(case when feature in ('blog-write', 'blog-rewrite', 'blog-draft', 'blog-outline') then p * 30 when feature = 'health_report' then (p * 8 + 9) // 10 else p end)::bigint as tokens,
    case when feature like 'blog%' then 'blog' when feature like '%alimtalk%' then 'alimtalk' when feature = 'health_report' then 'report' else 'other' end as product
  from plain where p > 0)"""
SUBS = """
subs as (select 'h' || c_custkey % 300 as hospital_id, 'prod' || (c_custkey // 300) as product_code, (c_custkey % 7 * 10)::bigint as price_tokens,
  date '2024-01-01' + (c_custkey % 40)::int as ends_at, c_custkey % 5 <> 0 as auto_renew, (c_custkey % 300 % 90)::bigint as balance from customer)"""


@query("BIL-01", f"with {USAGE}, {CHARGES} select * from charges")
def charges(spark, sf):
    return B.charges(usage(spark, sf))


@query("WIN-14", f"""with {USAGE}, {CHARGES}, rows as (select hospital_id, operation_id, 'charge' as kind, tokens, created_at from charges
  union all select distinct hospital_id, 'grant', 'grant', 1000::bigint, timestamp '2023-12-31' from usage where hospital_id is not null)
  select *, sum(tokens) over (partition by hospital_id order by created_at, operation_id rows between unbounded preceding and current row)::decimal(18,2) as balance_after from rows""")  # fmt: skip
def balances(spark, sf):
    rows = usage(spark, sf)
    grants = rows.where("hospital_id is not null").select("hospital_id").distinct().selectExpr("hospital_id", "'grant' as operation_id", "1000L as tokens", "timestamp_ntz'2023-12-31 00:00:00' as created_at")
    return B.ledger(B.charges(rows), grants)


@query("BIL-05", f"""with recursive {SUBS}, due as (select *, row_number() over (partition by hospital_id order by ends_at, product_code) as n from subs where ends_at <= date '2024-02-01'),
  f as (select hospital_id, product_code, n, auto_renew and balance >= price_tokens as paid, (balance - case when auto_renew and balance >= price_tokens then price_tokens else 0 end)::bigint as left_ from due where n = 1
    union all select d.hospital_id, d.product_code, d.n, d.auto_renew and f.left_ >= d.price_tokens, (f.left_ - case when d.auto_renew and f.left_ >= d.price_tokens then d.price_tokens else 0 end)::bigint from f join due d on d.hospital_id = f.hospital_id and d.n = f.n + 1)
  select hospital_id, product_code, case when paid then 'renewed' else 'lapsed' end as outcome, left_ as balance_after from f""")  # fmt: skip
def renewals(spark, sf):
    return B.renewals(subscriptions(spark, sf), "2024-02-01")


def subscriptions(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('h', c_custkey % 300) as hospital_id", "concat('prod', c_custkey div 300) as product_code", "c_custkey % 7 * 10 as price_tokens",
        "date_add(date'2024-01-01', cast(c_custkey % 40 as int)) as ends_at", "c_custkey % 5 <> 0 as auto_renew", "c_custkey % 300 % 90 as balance")


@query("BIL-04", f"with {SUBS} select distinct hospital_id from subs where (auto_renew and ends_at > date '2024-01-20' and product_code in ('prod1', 'prod3')) or balance > 80")
def has_feature(spark, sf):
    return subscriptions(spark, sf).where("(auto_renew and ends_at > date'2024-01-20' and product_code in ('prod1', 'prod3')) or balance > 80").select("hospital_id").distinct()


@query("BIL-08", """with recursive r as (select user_id, event_id as seq, (case when event_type = 'purchase' then 50 else -(event_id % 20) end)::bigint as amount, row_number() over (partition by user_id order by event_id) as n from events),
  f as (select user_id, seq, n, amount > 0 as accepted, greatest(amount, 0)::bigint as balance_after from r where n = 1
    union all select r.user_id, r.seq, r.n, r.amount <> 0 and f.balance_after + r.amount >= 0, (f.balance_after + case when f.balance_after + r.amount >= 0 then r.amount else 0 end)::bigint from f join r on r.user_id = f.user_id and r.n = f.n + 1)
  select user_id, seq, accepted, balance_after from f""")  # fmt: skip
def deductions(spark, sf):
    return B.deducted(table(spark, sf, "events").selectExpr("user_id", "event_id as seq", "case when event_type = 'purchase' then 50L else -(event_id % 20) end as amount"))


@query("BIL-09", f"""with {USAGE}, {CHARGES} select hospital_id, operation_id, -tokens as refund, created_at from charges c where created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-10'
  and not exists (select 1 from usage u where u.event_type = 'click' and u.operation_id = c.operation_id)""")  # fmt: skip
def refunds(spark, sf):
    rows = usage(spark, sf)
    window = B.charges(rows).where("created_at >= timestamp_ntz'2024-01-05 00:00:00' and created_at < timestamp_ntz'2024-01-10 00:00:00'")
    return window.join(rows.where("event_type = 'click'").select("operation_id"), "operation_id", "left_anti").select("hospital_id", "operation_id", (-F.col("tokens")).alias("refund"), "created_at")
