"""Policy and keyword rules: the fixed defaults, and readers of JSON files that replace them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Policy:
    rounding_tolerance: Decimal = Decimal("0.02")
    accounting_confidence: Decimal = Decimal("0.85")
    match_tolerance: Decimal = Decimal("0.02")
    reminder_days: tuple[int, ...] = (1, 8, 15, 30)
    high_amount: int = 5000
    critical_amount: int = 25000
    retention_years: int = 10


@dataclass(frozen=True)
class Rule:
    keywords: tuple[str, ...]
    account: str
    confidence: Decimal


POLICY = Policy()

#: Keyword rules, the first that matches wins.
RULES = (
    Rule(("internet", "téléphone", "telecom"), "626", Decimal("0.94")),
    Rule(("assurance",), "616", Decimal("0.94")),
    Rule(("honoraires", "avocat", "consultant", "conseil"), "6226", Decimal("0.88")),
    Rule(("banque", "commission bancaire"), "627", Decimal("0.94")),
    Rule(("fournitures", "papeterie"), "6064", Decimal("0.90")),
    Rule(("loyer", "location bureau"), "6132", Decimal("0.90")),
    Rule(("publicité", "marketing"), "623", Decimal("0.87")),
    Rule(("ordinateur", "machine", "équipement", "materiel"), "IMMOBILISATION_A_VERIFIER", Decimal("0.60")),
)
NO_RULE_CONFIDENCE = Decimal("0.25")
LEARNED_BASE, LEARNED_STEP, LEARNED_MOST = Decimal("0.80"), Decimal("0.03"), Decimal("0.99")
MATCH_CONFIDENCE, REFERENCE_CONFIDENCE = Decimal("0.82"), Decimal("0.97")

#: What a failed finding adds to the risk.
SCORES = {"supplier": 20, "invoice_number": 20, "manual": 25, "totals": 30, "duplicate": 50, "bank_change": 50, "vat": 40, "account": 10}
RISK_LIMIT = 100
EXTENSIONS = (".pdf", ".xml", ".ubl", ".cii")


def _json(spark: SparkSession, path: str):
    """A small JSON file from whatever store Spark reads; decimals exactly as written."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0], parse_float=Decimal)


def load_policy(spark: SparkSession, path: str) -> Policy:
    """A policy from a JSON object: thresholds (rounding_tolerance, accounting_confidence, bank_match_amount_tolerance, high_amount_eur, critical_amount_eur, reminder_days) and retention_years. What isn't given stays as it is by default; other entries are passed over."""
    given = _json(spark, path)
    names = {"rounding_tolerance": "rounding_tolerance", "accounting_confidence": "accounting_confidence", "bank_match_amount_tolerance": "match_tolerance", "high_amount_eur": "high_amount", "critical_amount_eur": "critical_amount", "reminder_days": "reminder_days"}
    found = {names[k]: v for k, v in given.get("thresholds", {}).items() if k in names}
    found |= {k: Decimal(found[k]) for k in ("rounding_tolerance", "accounting_confidence", "match_tolerance") if k in found}
    found |= {k: int(found[k]) for k in ("high_amount", "critical_amount") if k in found}
    if "reminder_days" in found:
        found["reminder_days"] = tuple(sorted(map(int, found["reminder_days"])))
    if "retention_years" in given:
        found["retention_years"] = int(given["retention_years"])
    return Policy(**found)


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Keyword rules from a JSON list of objects (keywords, account, confidence), in their order."""
    return tuple(Rule(tuple(r["keywords"]), r["account"], Decimal(r["confidence"])) for r in _json(spark, path))
