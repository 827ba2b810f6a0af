"""Schemas of the stored tables and of the invoice record."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, D, B, TS = T.StringType(), T.LongType(), T.DateType(), T.BooleanType(), T.TimestampType()

SUPPLIER_PARTY = _struct(name=S, siren=S, vat_number=S, email=S, iban=S)
CUSTOMER_PARTY = _struct(name=S, siren=S, vat_number=S, email=S, address=S)
INVOICE = _struct(
    format=S, direction=S, invoice_number=S, issue_date=S, due_date=S, currency=S, supplier=SUPPLIER_PARTY, customer=CUSTOMER_PARTY,
    lines=T.ArrayType(_struct(description=S)), raw_text=S, net_amount=MONEY, vat_amount=MONEY, gross_amount=MONEY,
    needs_manual_extraction=B, supplier_bank_details_changed=B, vat_treatment=S, source_file=S, source_path=S,
)

SUPPLIERS = _struct(id=L, name=S, siren=S, vat_number=S, iban=S, email=S, risk_level=S, created_at=TS, updated_at=TS)
CUSTOMERS = _struct(id=L, name=S, siren=S, vat_number=S, email=S, address=S, created_at=TS, updated_at=TS)
INVOICES = _struct(
    id=L, fingerprint=S, source_file=S, source_path=S, format=S, direction=S, invoice_number=S, supplier_name=S, customer_name=S, issue_date=S, due_date=S,
    net_amount=MONEY, vat_amount=MONEY, gross_amount=MONEY, currency=S, status=S, payment_status=S, risk_score=T.IntegerType(), proposed_account=S,
    accounting_confidence=T.DecimalType(4, 2), raw_json=S,
)
REVIEWS = _struct(invoice_id=L, reason=S, severity=S, resolved=B, resolution=S, resolved_by=S)
AUDIT_EVENTS = _struct(invoice_id=L, username=S, agent=S, event=S, details=S)
LEARNED_MAPPINGS = _struct(supplier_name=S, account=S, validations=L)
BANK_TRANSACTIONS = _struct(booking_date=S, label=S, amount=MONEY, currency=S, reference=S, matched_invoice_id=L)
OUTBOUND_INVOICES = _struct(id=L, customer_id=L, invoice_number=S, issue_date=D, due_date=D, net_amount=MONEY, vat_amount=MONEY, gross_amount=MONEY, currency=S, description=S, status=S)
REMINDERS = _struct(outbound_invoice_id=L, customer_email=S, reminder_level=T.IntegerType(), subject=S, body=S, status=S)
SEQUENCES = _struct(name=S, current_value=L)
FINDING = _struct(agent=S, code=S, severity=S, ok=B, message=S)
DECISIONS = _struct(invoice_id=L, seq=L, action=S, account=S, username=S, reason=S)
