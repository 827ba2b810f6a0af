"""SQL counterparts of the registered queries, for any engine that has the tables."""

from __future__ import annotations

from billstream.config import RULES, SCORES
from billstream.operators.reminders import BODY, SUBJECT
from billstream.plans.fixtures import AGAIN, AS_OF, LATER, many_rules, with_views


def _rules(rules=RULES) -> str:
    hit = lambda r: " or ".join(f"contains(txt, '{k}')" for k in r.keywords)
    case = lambda value, other: "case " + " ".join(f"when {hit(r)} then {value(r)}" for r in rules) + f" else {other} end"
    return f"select k, {case(lambda r: repr(r.account), 'null')} as account, {case(lambda r: r.confidence, '0.25')}::decimal(4,2) as confidence, n_lines from fx_txt"


def _findings(source: str, confidence: str = "0.85", tolerance: str = "0.02") -> str:
    """Findings in long form over a decided source, with learned accounts left out."""
    parts = [
        ("FOURNISSEURS", "supplier", "error", "coalesce(supplier_name, '') <> ''", "case when coalesce(supplier_name, '') <> '' then 'Fournisseur identifié' else 'Fournisseur à compléter' end", "true"),
        ("FACTURATION", "invoice_number", "error", "coalesce(invoice_number, '') <> ''", "case when coalesce(invoice_number, '') <> '' then 'Numéro présent' else 'Numéro à compléter' end", "true"),
        ("TVA", "totals", "error", f"abs(net_amount + vat_amount - gross_amount) <= {tolerance}", "'HT+TVA=' || cast(net_amount + vat_amount as varchar) || '; TTC=' || cast(gross_amount as varchar)", "net_amount <> 0 or vat_amount <> 0"),
        ("FRAUDE", "duplicate", "critical", "false", "'Doublon détecté'", "duplicate"),
        ("TRESORERIE", "bank_change", "critical", "false", "'RIB modifié : blocage'", "bank_changed"),
        ("TVA", "vat", "critical", "false", "'TVA incertaine'", "vat_uncertain"),
        ("COMPTABILITE", "account", "warning", f"confidence >= {confidence}", "'Compte ' || coalesce(account, 'None') || ' — confiance ' || cast(cast(confidence * 100 as int) as varchar) || '%'", "true"),
    ]
    return " union all ".join(f"select arrival, duplicate, '{a}' as agent, '{c}' as code, '{s}' as severity, {ok} as ok, {m} as message, {SCORES[c]} as score from {source} where {w}" for a, c, s, ok, m, w in parts)


def _decided(source: str) -> str:
    return f"""select *, row_number() over (partition by fingerprint order by arrival) > 1 as duplicate from (
  select v.*, r.account, r.confidence, r.n_lines, sha256(concat_ws('|', upper(coalesce(nullif(supplier_siren, ''), supplier_name, '')), upper(coalesce(invoice_number, '')), cast(issue_date as varchar), cast(gross_amount as varchar), 'EUR')) as fingerprint
  from {source} v join fx_rule r on v.k = r.k)"""


def _status(decided: str, findings: str) -> str:
    return f"""select d.*, case when d.duplicate then 'DUPLICATE' when f.failed > 0 then 'REVIEW_REQUIRED' else 'VALIDATED' end as status, least(100, f.risk)::int as risk_score
from {decided} d join (select arrival, count(*) filter (where not ok) as failed, coalesce(sum(score) filter (where not ok), 0) as risk from {findings} group by arrival) f on d.arrival = f.arrival"""


MORE = {
    "fx_txt": "select k, string_agg(lower(description), ' ' order by description) || ' ' as txt, count(*)::int as n_lines from fx_line group by k",
    "fx_rule": _rules(),
    "all_marked": _decided("fx_invoice"),
    "all_findings": _findings("all_marked"),
    "all_decided": _status("all_marked", "all_findings"),
    "strict_findings": _findings("all_marked", "0.92", "0.01"),
    "strict_decided": _status("all_marked", "strict_findings"),
    "fx_reversed": _rules(RULES[::-1]),
    "one_marked": _decided("fx_invoice0"),
    "one_findings": _findings("one_marked"),
    "stored_rows": "select *, arrival as id from (" + _status("one_marked", "one_findings") + ") where status <> 'DUPLICATE'",
    "approved_rows": "select d.invoice_id, d.seq, d.username, s.supplier_name, coalesce(nullif(d.account, ''), s.account) as account from fx_decision d join stored_rows s on s.id = d.invoice_id where action = 'approve'",
    "mapping_rows": "select supplier_name, account, count(*)::bigint as validations from approved_rows where coalesce(supplier_name, '') <> '' and coalesce(account, '') <> '' group by all",
    "top_rows": "select supplier_name, account, validations, least(0.99, 0.80 + 0.03 * validations)::decimal(4,2) as confidence from (select *, row_number() over (partition by supplier_name order by validations desc, account) as rn from mapping_rows) where rn = 1",
    "last_decision": "select invoice_id, action from (select *, row_number() over (partition by invoice_id order by seq desc) as rn from fx_decision) where rn = 1",
    "first_decision": "select invoice_id, action, username from (select *, row_number() over (partition by invoice_id order by seq) as rn from fx_decision) where rn = 1",
    "last_approval": "select invoice_id, account, username from (select *, row_number() over (partition by invoice_id order by seq desc) as rn from fx_decision where action = 'approve') where rn = 1",
    "last_rejection": "select invoice_id, reason, username from (select *, row_number() over (partition by invoice_id order by seq desc) as rn from fx_decision where action = 'reject') where rn = 1",
    "after_rows": """select s.* exclude (status), case l.action when 'approve' then 'APPROVED' when 'reject' then 'REJECTED' else s.status end as status,
  case when a.invoice_id is not null then coalesce(nullif(a.account, ''), s.account) end as approved_account, a.username as approved_by, r.username as rejected_by, r.reason as rejection_reason
from stored_rows s left join last_decision l on l.invoice_id = s.id left join last_approval a on a.invoice_id = s.id left join last_rejection r on r.invoice_id = s.id""",
    "sale_rows": "select *, round(net_amount * 1.2, 2)::decimal(18,2) as gross_amount, year(issue_date) as y, row_number() over (partition by year(issue_date) order by id) as n from fx_outbound",
    "numbered_rows": "select *, 'F' || y || '-' || case when n < 100000 then lpad(n::varchar, 5, '0') else n::varchar end as invoice_number from sale_rows",
    "late_rows": f"select * from numbered_rows where status not in ('PAID', 'CANCELLED') and due_date < date '{AS_OF}'",
}

NUMBER = r"(?i)(?:facture|invoice)\s*(?:n[°oº]?|no|#)?\s*[:\-]?\s*([A-Z0-9_./-]+)"
AMOUNT = r"(?i)(?:total\s*ttc|net\s*à\s*payer|amount\s*due)\s*:?\s*([0-9][0-9 .,''’]*)"
_NUMBER = f"nullif(trim(regexp_extract(text, '{NUMBER}', 1)), '')"


def _amount(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9,.\\-]', '', 'g')"
    commas, points = (f"(length({d}) - length(replace({d}, '{c}', '')))" for c in ",.")
    return f"coalesce(try_cast(case when {commas} = 1 and {points} = 0 then replace({d}, ',', '.') when {commas} = 1 then replace(replace({d}, '.', ''), ',', '.') else {d} end as double), 0.0)"


def _text(template: str, *values: str) -> str:
    """A %-template as a concatenation."""
    out, rest = [], template.replace("'", "''")
    for v in values:
        head, _, rest = rest.partition("%s")
        out += [f"'{head}'", v]
    return " || ".join([*out, f"'{rest}'"])


_SALE = "select f.id, f.customer_id, f.issue_date, f.due_date, f.net_amount, round(f.net_amount * 0.2, 2)::decimal(18,2) as vat, n.invoice_number, f.customer_name from fx_outbound f join numbered_rows n on n.id = f.id"
_LAST = lambda c: f"(max_by({c}, arrival) filter (where {c} is not null))"

_SQL = {
    "fingerprints": "select arrival, fingerprint from all_marked",
    "duplicates": "select arrival, fingerprint from all_marked where duplicate",
    "account_rules": "select arrival, account, confidence::double as confidence, case when account is null then 'none' else 'rules' end as source from all_marked",
    "findings": "select arrival, agent, code, severity, ok, message from all_findings",
    "risk_scores": "select arrival, risk_score from all_decided",
    "invoice_decisions": "select arrival, fingerprint, status, risk_score, account, confidence::double as confidence, false as payment_authorized, status <> 'VALIDATED' as human_review_required from all_decided",
    "invoices_accepted": """select arrival as id, fingerprint, 'UBL' as format, 'purchase' as direction, invoice_number, supplier_name, customer_name, cast(issue_date as varchar) as issue_date, net_amount::double as net_amount, vat_amount::double as vat_amount,
  gross_amount::double as gross_amount, 'EUR' as currency, status, 'UNPAID' as payment_status, risk_score, account as proposed_account, confidence::double as accounting_confidence, invoice_number as raw_number, n_lines as raw_lines from all_decided where status <> 'DUPLICATE'""",
    "audit_events": """select arrival as invoice_id, 'system' as username, agent, code as event, '{"agent":"' || agent || '","code":"' || code || '","severity":"' || severity || '","ok":' || ok || ',"message":"' || message || '"}' as details from all_findings where not duplicate
union all select invoice_id, username, 'WORKFLOW', 'approved', '{"account":' || coalesce('"' || account || '"', 'null') || '}' from approved_rows""",
    "reviews_open": "select arrival as invoice_id, message as reason, severity, false as resolved from all_findings where not ok and not duplicate",
    "dashboard_kpis": "select count(*) as total, count(*) filter (where status = 'APPROVED') as approved, count(*) filter (where status = 'REVIEW_REQUIRED') as review, count(*) as unpaid from after_rows",
    "latest_invoices": "select id, invoice_number, supplier_name, cast(gross_amount as varchar) as gross, status, coalesce(nullif(approved_account, ''), account, '—') as account from after_rows order by id desc limit 15",
    "learned_mappings": "select * from mapping_rows",
    "learned_top_account": "select supplier_name, account, validations, confidence::double as confidence from top_rows",
    "account_proposals": "select m.arrival, coalesce(t.account, m.account) as account, coalesce(t.confidence, m.confidence)::double as confidence, case when t.account is not null then 'learning' when m.account is null then 'none' else 'rules' end as source from all_marked m left join top_rows t on t.supplier_name = m.supplier_name",
    "account_proposals_asof": """select arrival, account, n::bigint as validations from (
  select i.arrival, a.account, count(*) as n, row_number() over (partition by i.arrival order by count(*) desc, a.account) as rn
  from fx_invoice0 i join approved_rows a on a.supplier_name = i.supplier_name and a.seq < i.arrival * 10 - 5 where a.account <> '' group by i.arrival, a.account) where rn = 1""",
    "invoices_after_decisions": "select id, status, approved_account, approved_by, rejected_by, rejection_reason from after_rows",
    "reviews_resolved": "select f.arrival as invoice_id, message as reason, severity, d.invoice_id is not null as resolved, case d.action when 'approve' then 'APPROVED' when 'reject' then 'REJECTED' end as resolution, d.username as resolved_by from one_findings f left join first_decision d on d.invoice_id = f.arrival where not ok and not duplicate",
    "ledger_entries": """select id, pos::int as pos, cast(issue_date as varchar) as "Date", 'ACH' as "Journal", case pos when 0 then coalesce(nullif(approved_account, ''), nullif(account, ''), 'A_VERIFIER') when 1 then '44566' else '401' end as "Compte",
  case pos when 1 then 'TVA déductible' else supplier_name end as "Libelle", (case pos when 0 then net_amount when 1 then vat_amount else 0 end)::double as "Debit", (case pos when 2 then gross_amount else 0 end)::double as "Credit", invoice_number as "Piece"
from after_rows, range(3) t(pos) where status = 'APPROVED'""",
    "ledger_balance": "select id, (net_amount + vat_amount)::double as debit, gross_amount::double as credit from after_rows where status = 'APPROVED' and net_amount + vat_amount <> gross_amount",
    "suppliers_merged": f"select supplier_name as name, {_LAST('supplier_siren')} as siren, cast(null as varchar) as vat_number, cast(null as varchar) as email, max(case when rn = 1 then supplier_iban end) as iban, 'normal' as risk_level from (select *, row_number() over (partition by supplier_name order by arrival) as rn from fx_invoice) where supplier_name <> '' group by supplier_name",
    "customers_merged": "select distinct customer_name as name, cast(null as varchar) as siren, cast(null as varchar) as vat_number, cast(null as varchar) as email, cast(null as varchar) as address from fx_invoice where customer_name <> ''",
    "bank_detail_changes": "select * from (select arrival, supplier_name, supplier_iban as iban, lag(supplier_iban) over (partition by supplier_name order by arrival) as previous_iban from fx_invoice where supplier_name <> '' and supplier_iban is not null) where previous_iban <> iban",
    "customers_sorted": "select c_custkey as id, c_name as name from customer order by name, id",
    "bank_matches": "select tx_id as transaction_id, s.id as invoice_id, s.invoice_number, amount::double as amount, case when s.invoice_number <> '' and contains(reference, s.invoice_number) then 0.97 else 0.82 end::double as confidence from fx_bank join stored_rows s on abs(abs(amount) - gross_amount) <= 0.02 where status in ('APPROVED', 'VALIDATED')",
    "outbound_invoices": f"select id, customer_id, invoice_number, issue_date, due_date, net_amount::double as net_amount, vat::double as vat_amount, (net_amount + vat)::double as gross_amount, 'EUR' as currency, 'DRAFT' as status from ({_SALE})",
    "outbound_numbers": "select id, n, invoice_number from numbered_rows",
    "sequences_next": "select 'SALES-' || y as name, max(n) as current_value from sale_rows group by y",
    "overdue_outbound": "select id, invoice_number, due_date, customer_name, customer_email from late_rows order by due_date, id",
    "reminder_drafts": f"select id as outbound_invoice_id, customer_email, 1 as reminder_level, {_text(SUBJECT, 'invoice_number')} as subject, {_text(BODY, 'invoice_number', 'cast(gross_amount as varchar)', 'cast(due_date as varchar)')} as body, 'DRAFT' as status from late_rows where coalesce(customer_email, '') <> ''",
    "reminder_levels": f"select id, late::int as days_late, ((late >= 1)::int + (late >= 8)::int + (late >= 15)::int + (late >= 30)::int)::int as reminder_level from (select id, date '{AS_OF}' - due_date as late from late_rows)",
    "due_schedule": f"""select case when late <= 0 then 'not due' when late <= 30 then '1-30' when late <= 60 then '31-60' when late <= 90 then '61-90' else 'over 90' end as bucket, count(*) as n, sum(net_amount)::double as amount
from (select *, date '{AS_OF}' - due_date as late from fx_outbound where status not in ('PAID', 'CANCELLED')) group by 1""",
    "amount_bands": "select case when gross_amount >= 25000 then 'critical' when gross_amount >= 5000 then 'high' else 'normal' end as band, count(*) as n, sum(gross_amount)::double as amount from fx_invoice group by 1",
    "retention_filter": "select arrival, issue_date from fx_invoice where issue_date >= date '1994-01-01'",
    "text_invoice_number": f"select k, {_NUMBER} as invoice_number from fx_text",
    "text_gross_amount": f"select k, {_amount(f"trim(regexp_extract(text, '{AMOUNT}', 1))")} as gross_amount from fx_text",
    "normalize_amount": f"select k, {_amount("regexp_extract(text, ': ([0-9,.]+) EUR$', 1)")} as amount from fx_text",
    "src_invoice_text": f"select k, {_NUMBER} as invoice_number, {_amount(f"trim(regexp_extract(text, '{AMOUNT}', 1))")} as gross_amount, substr(text, 1, 30000) as raw_text, 'PDF_TEXT' as format, false as needs_manual_extraction from fx_text where text is not null",
    "src_invoice_json": "select invoice_number, cast(issue_date as varchar) as issue_date, 'EUR' as currency, supplier_name, net_amount::double as net_amount, vat_amount::double as vat_amount, gross_amount::double as gross_amount, n_lines from fx_invoice v join fx_txt t on t.k = v.k",
    "src_invoice_xml": """select k, case when cii then 'CII' else 'UBL' end as format, invoice_number, case when cii then strftime(issue_date, '%Y%m%d') else cast(issue_date as varchar) end as issue_date, 'EUR' as currency, coalesce(supplier_name, '') as supplier_name, customer_name,
  net_amount::double as net_amount, vat_amount::double as vat_amount, gross_amount::double as gross_amount from (select *, k % 3 = 0 and invoice_number is not null as cii from fx_invoice0)""",
    "invoice_format_tag": "select case when k % 3 = 0 and invoice_number is not null then 'CII' else 'UBL' end as format, count(*) as n from fx_invoice0 group by 1",
    "src_bank_csv": "select '2026-08-20' as booking_date, cast(tx_id as varchar) as label, amount::double as amount, 'EUR' as currency, reference from fx_bank",
    "route_by_extension": """select k, 'doc' || k || ext as source_file, lower(ext) as extension, case lower(ext) when '.pdf' then 'pdf' when '.xml' then 'xml' when '.ubl' then 'xml' when '.cii' then 'xml' else 'rejected' end as route
from (select k, case k % 6 when 0 then '.pdf' when 1 then '.XML' when 2 then '.ubl' when 3 then '.Cii' when 4 then '.txt' else '' end as ext from fx_invoice0)""",
    "write_outbound_xml": f"select id, invoice_number as number, cast(due_date as varchar) as due, customer_name as buyer, cast(net_amount + vat as varchar) as payable from ({_SALE})",
    "stream_intake": "select arrival, fingerprint, status, risk_score from all_decided",
    "stream_dedup": "select distinct fingerprint from all_marked",
}
_NAMED = "trim(coalesce(supplier_name, '') || case when k % 4 = 3 then ' é€' else ' é' end)"
_FILES = "(select *, 'doc' || k || ext as source_file from (select *, case k // 4 % 6 when 0 then '.pdf' when 1 then '.XML' when 2 then '.ubl' when 3 then '.Cii' when 4 then '.txt' else '' end as ext from fx_invoice0))"
_SQL |= {
    "account_rules_from_file": "select arrival, r.account, r.confidence::double as confidence, case when r.account is null then 'none' else 'rules' end as source from fx_invoice v join fx_reversed r on v.k = r.k",
    "decisions_by_policy_file": "select arrival, status, risk_score from strict_decided",
    "decisions_unknown": "select x.invoice_id, seq, action, username from (select * exclude (invoice_id), case when invoice_id % 4 = 0 then invoice_id * 2 else invoice_id end as invoice_id from fx_decision) x where x.invoice_id not in (select id from stored_rows)",
    "bank_rows_rejected": "select '2026-08-20' as booking_date, cast(tx_id as varchar) as label, 'EUR' as currency, reference, 'n/a' as amount from fx_bank where tx_id % 7 = 0",
    "bank_transactions_stored": "select '2026-08-20' as booking_date, cast(tx_id as varchar) as label, amount::double as amount, 'EUR' as currency, reference, batch::int as batch from fx_bank, range(1, 3) t(batch) where tx_id % 7 <> 0",
    "outbound_invoices_stored": """select id, customer_id, 'F' || y || '-' || case when n < 100000 then lpad(n::varchar, 5, '0') else n::varchar end as invoice_number, gross::double as gross_amount, issue_date, batch
from (select *, (id % 2)::int as batch, year(issue_date) as y, row_number() over (partition by year(issue_date) order by id % 2, id) as n, (net_amount + round(net_amount * 0.2, 2))::decimal(18,2) as gross from fx_outbound)""",
    "reminders_stored": _SQL["reminder_drafts"],
    "reminders_without_address": "select id, invoice_number, due_date from late_rows where coalesce(customer_email, '') = ''",
    "xml_rejected": "select k from fx_invoice0 where k % 5 = 0 or k % 7 = 0",
    "stream_intake_learned": _SQL["account_proposals"],
    "stream_intake_suppliers": _SQL["suppliers_merged"],
    "stream_dedup": """select k, case when arrival <> k then 'far' when k % 3 = 0 then 'later' else 'first' end as wave, fingerprint from all_marked
where arrival = k or (k % 3 <> 0 and k % 2 <> 0 and k % 5 <> 0)""",
}
_MANY = ", ".join(f"({i}, {r.keywords[0]!r}, {r.keywords[1]!r}, '{r.account}', {r.confidence})" for i, r in enumerate(many_rules()))
_SQL |= {
    "bank_csv_quoted": """select '2026-08-20' as booking_date, case tx_id % 4 when 0 then 'VIR "client", n ' || tx_id when 1 then 'ligne 1' || chr(10) || 'ligne 2, ' || tx_id else '"' || tx_id || '"' end as label, amount::double as amount, 'EUR' as currency, reference from fx_bank""",
    "bank_csv_mixed": "select case tx_id % 2 when 0 then '2026-08-20' else '2026-08-21' end as booking_date, cast(tx_id as varchar) as label, amount::double as amount, case tx_id % 2 when 0 then 'EUR' else 'CHF' end as currency, reference from fx_bank",
    "account_rules_many": f"""select m.arrival, r.account, coalesce(r.confidence, 0.25)::double as confidence, case when r.account is null then 'none' else 'rules' end as source from all_marked m
left join (select k, min(i) as i from (select distinct k, lower(description) as txt from fx_line) join (values {_MANY}) v(i, one, two, account, confidence) on contains(txt, one) or contains(txt, two) group by k) f on f.k = m.k
left join (values {_MANY}) r(i, one, two, account, confidence) on r.i = f.i""",
    "fingerprints_known": "select distinct fingerprint from all_marked where fingerprint in (select fingerprint from all_marked where k % 3 < 2)",
    "ledger_months": f"""select cast(issue_date as varchar) as "Date", case when strftime(issue_date, '%Y-%m') = '{AGAIN}' then 'AC2' else 'ACH' end as "Journal", case pos when 0 then coalesce(nullif(approved_account, ''), nullif(account, ''), 'A_VERIFIER') when 1 then '44566' else '401' end as "Compte",
  case pos when 1 then 'TVA déductible' else supplier_name end as "Libelle", (case pos when 0 then net_amount when 1 then vat_amount else 0 end)::double as "Debit", (case pos when 2 then gross_amount else 0 end)::double as "Credit", invoice_number as "Piece", strftime(issue_date, '%Y-%m') as month
from after_rows, range(3) t(pos) where status = 'APPROVED'""",
    "suppliers_snapshot": _SQL["suppliers_merged"],
    "src_xml_encodings": f"select k, {_NAMED} as supplier_name, gross_amount::double as gross_amount from fx_invoice0 where k % 7 <> 0 and k % 11 <> 0",
    "ingest_records": f"""select k, source_file, 'file:/in/' || source_file as source_path, case when k % 3 = 0 and invoice_number is not null then 'CII' else 'UBL' end as format, invoice_number, {_NAMED} as supplier_name, gross_amount::double as gross_amount
from {_FILES} where ext in ('.XML', '.ubl', '.Cii') and k % 7 <> 0 and k % 11 <> 0""",
    "ingest_rejects": f"""select k, source_file, 'file:/in/' || source_file as source_path, case when ext in ('.txt', '') then 'unsupported format' when k % 7 = 0 then 'cannot be decoded' else 'not one XML document' end as reason
from {_FILES} where ext in ('.txt', '') or (ext <> '.pdf' and (k % 7 = 0 or k % 11 = 0))""",
    "ingest_waiting": f"select k, source_file, 'file:/in/' || source_file as source_path from {_FILES} where ext = '.pdf'",
    "stream_decisions_invoices": _SQL["invoices_after_decisions"],
    "stream_decisions_reviews": _SQL["reviews_resolved"],
    "stream_decisions_learned": f"""select m.arrival, case when m.arrival >= {LATER} and t.account is not null then t.account else m.account end as account, case when m.arrival >= {LATER} and t.account is not null then t.confidence else m.confidence end::double as confidence,
  case when m.arrival >= {LATER} and t.account is not null then 'learning' when m.account is null then 'none' else 'rules' end as source from all_marked m left join top_rows t on t.supplier_name = m.supplier_name""",
}
_SQL["stream_bank_match"] = _SQL["bank_matches"]

ORACLE = {name: with_views(sql, MORE) for name, sql in _SQL.items()}
