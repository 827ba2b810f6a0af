"""Views that present star-schema tables as invoices, bank lines, decisions and sales. One text for Spark SQL and for other engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from billstream.config import POLICY, RULES, Rule

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")
AS_OF = "1999-01-01"
#: From this arrival on, invoices are repeats; the month whose entries are exported twice.
LATER, AGAIN = 100_000_000, "1996-03"

#: The words of part names and of the labels in the fixture's line descriptions.
PART_WORDS = (("blue", "cold", "green", "hot", "large", "red", "small", "tiny"), ("anchor", "bolt", "gadget", "gear", "gizmo", "ring", "sprocket", "widget"))
LINE_LABELS = ("abonnement internet", "assurance flotte", "honoraires", "commission bancaire", "papeterie", "location bureau", "marketing", "ordinateur", "divers")
MANY_RULES = 5000


def many_rules() -> tuple[Rule, ...]:
    """So many rules, of which every ninth or so can match a line of the fixture."""
    lines = [f"{a} {b} {x}" for x in LINE_LABELS for a in PART_WORDS[0] for b in PART_WORDS[1]]
    keys = [lines[i // 9] if i % 9 == 8 and i // 9 < len(lines) else f"mot {i}" for i in range(MANY_RULES)]
    return tuple(Rule((k, f"autre {i}"), f"6{i:04d}", POLICY.accounting_confidence if i % 2 else RULES[0].confidence) for i, k in enumerate(keys))

VIEWS = {
    "fx_line": """
select l_orderkey as k, l_suppkey, p_name || ' ' || case p_partkey % 9 when 0 then 'Abonnement INTERNET' when 1 then 'assurance flotte' when 2 then 'honoraires' when 3 then 'commission bancaire' when 4 then 'papeterie' when 5 then 'location bureau' when 6 then 'marketing' when 7 then 'ordinateur' else 'divers' end as description,
  round(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as net,
  cast(l_tax as decimal(4,2)) as tax
from lineitem join part on l_partkey = p_partkey""",
    "fx_base": """
select k, min(l_suppkey) as suppkey, sum(net) as net_amount, sum(round(net * tax, 2)) as vat_amount
from fx_line group by k""",
    "fx_invoice0": """
select b.k as arrival, b.k as k,
  case when b.k % 29 = 0 then null else s_name end as supplier_name,
  case when b.suppkey % 2 = 0 then cast(100000000 + b.suppkey as varchar(20)) end as supplier_siren,
  case when b.k % 3 = 0 then 'FR76' || cast(b.suppkey + b.k % 2 as varchar(20)) end as supplier_iban,
  c_name as customer_name,
  case when b.k % 31 = 0 then null else 'F' || cast(year(o_orderdate) as varchar(4)) || '-' || lpad(cast(b.k as varchar(10)), 7, '0') end as invoice_number,
  cast(o_orderdate as date) as issue_date,
  cast(net_amount as decimal(18,2)) as net_amount, cast(vat_amount as decimal(18,2)) as vat_amount,
  cast(net_amount + vat_amount + case when b.k % 11 = 0 then cast('0.03' as decimal(4,2)) when b.k % 13 = 0 then cast('0.02' as decimal(4,2)) else cast('0.00' as decimal(4,2)) end as decimal(18,2)) as gross_amount,
  b.k % 37 = 0 as bank_changed, b.k % 41 = 0 as vat_uncertain
from fx_base b join orders on o_orderkey = b.k join customer on c_custkey = o_custkey join supplier on s_suppkey = b.suppkey""",
    "fx_invoice": """
select * from fx_invoice0
union all
select arrival + 100000000, k, supplier_name, supplier_siren, supplier_iban, customer_name, invoice_number, issue_date, net_amount, vat_amount, gross_amount, bank_changed, vat_uncertain
from fx_invoice0 where k % 17 = 0""",
    "fx_bank": """
select k * 2 as tx_id,
  -(gross_amount + cast(case k % 4 when 0 then '0.02' when 1 then '-0.02' when 2 then '0.00' else '0.05' end as decimal(4,2))) as amount,
  case when k % 2 = 0 then 'VIR ' || coalesce(invoice_number, '') else '' end as reference
from fx_invoice0 where k % 5 = 0
union all
select event_id * 2 + 1, cast(value as decimal(18,2)), '' from events where event_type = 'purchase'""",
    "fx_decision": """
select k as invoice_id, k * 10 as seq, 'approve' as action, case when k % 7 = 0 then '6064' end as account, 'u' || cast(k % 5 as varchar(2)) as username, cast(null as varchar(20)) as reason
from fx_invoice0 where k % 2 = 0
union all
select k, k * 10 + 5, 'reject', null, 'u9', 'montant' from fx_invoice0 where k % 6 = 0""",
    "fx_outbound": """
select o_orderkey as id, o_custkey as customer_id, cast(o_orderdate as date) as issue_date, cast(cast(o_orderdate as date) + interval 30 day as date) as due_date,
  cast(o_totalprice as decimal(18,2)) as net_amount, case o_orderstatus when 'F' then 'PAID' when 'P' then 'CANCELLED' else 'DRAFT' end as status,
  c_name as customer_name, case when c_custkey % 10 = 0 then null else 'c' || cast(c_custkey as varchar(10)) || '@example.com' end as customer_email
from orders join customer on c_custkey = o_custkey""",
    "fx_text": """
select k, 'FACTURE n° ' || coalesce(invoice_number, '') || ' du client. Total TTC : ' || case k % 3 when 0 then replace(cast(gross_amount as varchar(30)), '.', ',') else cast(gross_amount as varchar(30)) end || ' EUR' as text
from fx_invoice0""",
}


#: The same for Spark, in one pass over the lines: with each invoice's line descriptions, and repeats made of the first arrival's row. Amounts are made before the lines are dealt out, lines are dealt out as they are and not as partial lists, and orders meet their customers before the wide rows.
SPARK_VIEWS = {
    "fx_line": VIEWS["fx_line"].split("  round(")[0] + f"""  net, vat
from (select l_orderkey, l_suppkey, l_partkey, cast(net as decimal(18,2)) as net, cast(round(net * tax, 2) as decimal(18,2)) as vat
  from (select l_orderkey, l_suppkey, l_partkey, {VIEWS["fx_line"].split("description,")[1].split("from lineitem")[0].strip()} from lineitem))
join part on l_partkey = p_partkey""",
    "fx_base": """
select k, min(l_suppkey) as suppkey, sum(net) as net_amount, sum(vat) as vat_amount, sort_array(collect_list(named_struct('description', description))) as lines
from (select /*+ repartition(k) */ * from fx_line) group by k""",
    "fx_invoice0": VIEWS["fx_invoice0"].replace("as vat_uncertain", "as vat_uncertain, b.lines").replace("join orders on o_orderkey = b.k join customer on c_custkey = o_custkey", "join (select o_orderkey, o_orderdate, c_name from orders join customer on c_custkey = o_custkey) on o_orderkey = b.k"),
    "fx_invoice": """
select arrival + n * 100000000 as arrival, k, supplier_name, supplier_siren, supplier_iban, customer_name, invoice_number, issue_date, net_amount, vat_amount, gross_amount, bank_changed, vat_uncertain, lines
from fx_invoice0 lateral view explode(if(k % 17 = 0, array(0, 1), array(0))) as n""",
    # All arrivals from LATER on, and others of the same invoices: a filter that reaches the tables.
    "fx_invoice_later": f"select * from fx_invoice where k % 17 = 0 or k >= {LATER}",
}

#: Both decisions on an invoice from one pass over the invoices, of which the odd ones are left out where the tables are read.
SPARK_DECISIONS = {
    "fx_decision": """
select k as invoice_id, k * 10 + n * 5 as seq, if(n = 0, 'approve', 'reject') as action, if(n = 0 and k % 7 = 0, '6064', null) as account, if(n = 0, 'u' || cast(k % 5 as varchar(2)), 'u9') as username, if(n = 1, 'montant', null) as reason
from fx_invoice0 lateral view explode(if(k % 6 = 0, array(0, 1), if(k % 2 = 0, array(0), array()))) as n where k % 2 = 0""",
}


def decisions_on(invoices: DataFrame) -> DataFrame:
    """fx_decision, of the invoices of fx_invoice0 (k, and others) that are there already."""
    return invoices.sparkSession.sql(SPARK_DECISIONS["fx_decision"].replace("fx_invoice0", "{invoices}"), invoices=invoices)


def with_views(query: str, more: dict[str, str] | None = None) -> str:
    """query below the views, and more views, that it needs."""
    known = VIEWS | (more or {})
    needed: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(known[name])
                needed.append(name)

    need(query)
    chain = ",\n".join(f"{n} as ({known[n]})" for n in needed)
    return f"with {chain}\n{query}" if needed else query


def fixture(spark: SparkSession, sf_dir: str, name: str, lines: bool = False) -> DataFrame:
    """A view over the tables in sf_dir. lines: fx_invoice and fx_invoice0 have the column lines too."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(with_views(f"select * from {name}", SPARK_DECISIONS | (SPARK_VIEWS if lines else {})))
