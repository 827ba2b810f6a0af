"""Fingerprints, duplicates, account proposals, findings, risk and status of invoices.

An invoice row has ``arrival`` (a long that orders arrivals) and the fields of
schemas.INVOICE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from billstream.config import LEARNED_BASE, LEARNED_MOST, LEARNED_STEP, NO_RULE_CONFIDENCE, POLICY, RISK_LIMIT, RULES, SCORES, Policy, Rule
from billstream.functions.expressions import filled, fingerprint, money, percent, two_decimals

#: Parts that the arrivals of one invoice are dealt out to.
PARTS = 200
#: So many keywords are a chain of conditions; more of them go to an automaton.
CHAIN_KEYWORDS = 64


def fingerprinted(invoices: DataFrame) -> DataFrame:
    """Adds ``fingerprint``."""
    of = lambda c: F.col(c)
    return invoices.withColumn("fingerprint", fingerprint(of("supplier.siren"), of("supplier.name"), of("invoice_number"), of("issue_date"), of("gross_amount"), of("currency")))


def duplicates_marked(invoices: DataFrame, history: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """Adds ``fingerprint`` and ``duplicate``: an earlier arrival, or a stored invoice (history: fingerprint), has the same fingerprint.

    One pass over the invoices: the rows of a fingerprint are dealt out to parts
    by their arrival, where all but the first of each part are known to be
    repeats. Only these firsts, a row for each part at most, then meet; the
    others are dealt out as before. So an invoice that was sent very often is
    split over tasks, and what the invoices are made from is read once. Rows are
    dealt out by the fingerprint's bytes, half as long as its digits.
    """
    return _marked(fingerprinted(invoices), history, parts)


def _marked(invoices: DataFrame, history: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """duplicates_marked(), of invoices with fingerprint."""
    part, first = F.col("__part"), F.min("arrival")
    marked = invoices.withColumn("__key", F.unhex("fingerprint")).drop("fingerprint").withColumn("__part", F.pmod(F.xxhash64("arrival"), F.lit(parts)))
    marked = marked.withColumn("__first", first.over(W.partitionBy("__key", "__part")))
    marked = marked.withColumn("__part", F.when(F.col("arrival").eqNullSafe(F.col("__first")), F.lit(-1)).otherwise(part))
    least = first.over(W.partitionBy("__key", "__part"))
    later = F.coalesce(F.col("arrival") > least, least.isNotNull())  # no arrival comes last
    marked = marked.withColumn("fingerprint", F.lower(F.hex("__key"))).withColumn("duplicate", (part >= 0) | later).drop("__key", "__part", "__first")
    if history is not None:
        stored = history.select("fingerprint").distinct().withColumn("__stored", F.lit(True))
        marked = marked.join(stored, "fingerprint", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("__stored", F.lit(False))).drop("__stored")
    return marked


def repeated(invoices: DataFrame) -> DataFrame:
    """hash: of the fingerprints that are there more than once, and of next to no others. Only these eight bytes and a count are dealt out, of a fingerprint that is there very often once a task."""
    return invoices.groupBy(F.xxhash64("fingerprint").alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("hash")


def duplicates_found(invoices: DataFrame, history: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """fingerprint, arrival of the duplicates among invoices with fingerprint: duplicates_marked() on narrow rows. again: the result of repeated(), so that only what may be there more than once is dealt out."""
    names = invoices.select("fingerprint", "arrival")
    several = names if again is None else names.withColumn("hash", F.xxhash64("fingerprint")).join(again, "hash", "left_semi").drop("hash")
    found = _marked(several).where("duplicate").select("fingerprint", "arrival")
    if history is not None:
        found = found.unionByName(names.join(history.select("fingerprint"), "fingerprint", "left_semi"))
    return found.distinct()


def _joined(invoices: DataFrame, found: DataFrame) -> DataFrame:
    """invoices with fingerprint, and duplicate for those in duplicates_found()."""
    names = found.select(F.col("fingerprint").alias("__f"), F.col("arrival").alias("__a"), F.lit(True).alias("__found"))
    out = invoices.join(names, (F.col("fingerprint") == F.col("__f")) & F.col("arrival").eqNullSafe(F.col("__a")), "left")
    return out.withColumn("duplicate", F.coalesce("__found", F.lit(False))).drop("__f", "__a", "__found")


def searched_text() -> Column:
    """The text that keyword rules look at: line descriptions and document text, in small letters. No lambda: Spark takes copies of one for different expressions and would make the text anew for each keyword."""
    lines = F.coalesce(F.array_join(F.col("lines").getField("description"), " ", ""), F.lit(""))
    return F.lower(F.concat(lines, F.lit(" "), F.coalesce("raw_text", F.lit(""))))


def _proposal(account: str | None, confidence, source: str) -> Column:
    return F.struct(F.lit(account).cast("string").alias("account"), F.lit(confidence).cast("decimal(4,2)").alias("confidence"), F.lit(source).alias("source"))


def first_rule(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The place of the first rule with a keyword in the text, null if there is none: all keywords are looked for at once, by an automaton that each task builds; texts pass through it in Arrow batches."""
    import ahocorasick

    place: dict[str, int] = {}
    for i, rule in enumerate(rules):
        for k in rule.keywords:
            place.setdefault(k.lower(), i)
    always = place.pop("", len(rules))  # the empty keyword is in every text

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for k, i in place.items():
            automaton.add_word(k, i)
        automaton.make_automaton()
        found = automaton.iter if place else lambda _: ()
        for batch in batches:
            least = [min((i for _, i in found(t)), default=always) for t in batch]
            yield pd.Series([min(i, always) if min(i, always) < len(rules) else None for i in least], dtype="Int32")

    return run(text)


def rule_proposal(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(account, confidence, source) of the first rule with a keyword in the text.

    Few rules are a chain of conditions, evaluated in the scan's stage. The plan
    of such a chain, and the time a text takes, grow with the keywords; those of
    many rules are found by first_rule().
    """
    none = _proposal(None, NO_RULE_CONFIDENCE, "none")
    if not rules:
        return none
    if sum(len(r.keywords) for r in rules) > CHAIN_KEYWORDS:
        of = F.lit([f"{r.confidence} {r.account}" for r in rules])
        pair = F.get(of, first_rule(text, rules))
        known = F.struct(F.substring_index(pair, " ", 1).cast("decimal(4,2)").alias("confidence"), F.regexp_replace(pair, "^[^ ]* ", "").alias("account"))
        return F.when(pair.isNull(), none).otherwise(F.struct(known["account"].alias("account"), known["confidence"].alias("confidence"), F.lit("rules").alias("source")))
    out = None
    for rule in rules:
        hit = F.lit(False)
        for k in rule.keywords:
            hit = hit | F.contains(text, F.lit(k.lower()))
        out = (F if out is None else out).when(hit, _proposal(rule.account, rule.confidence, "rules"))
    return out.otherwise(none)


def learned_confidence(validations: Column) -> Column:
    return F.least(F.lit(LEARNED_MOST), F.lit(LEARNED_BASE) + F.lit(LEARNED_STEP) * validations.cast("int")).cast("decimal(4,2)")


def proposed(invoices: DataFrame, learned_top: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``proposal``: the supplier's learned account (learned_top: supplier_name, account, validations, one row a supplier), else a rule's."""
    return _learned_first(invoices.withColumn("proposal", rule_proposal(searched_text(), rules)), learned_top)


def _learned_first(out: DataFrame, learned_top: DataFrame | None) -> DataFrame:
    if learned_top is None:
        return out
    top = learned_top.select(F.col("supplier_name").alias("__supplier"), F.struct("account", learned_confidence(F.col("validations")).alias("confidence"), F.lit("learning").alias("source")).alias("__learned"))
    out = out.withColumn("__name", F.coalesce("supplier.name", F.lit("")))
    return out.join(top, F.col("__name") == F.col("__supplier"), "left").withColumn("proposal", F.coalesce("__learned", "proposal")).drop("__name", "__supplier", "__learned")


def findings(policy: Policy = POLICY) -> Column:
    """The findings of a row with ``duplicate`` and ``proposal``, in their fixed order."""

    def finding(agent: str, code: str, severity: str, ok: Column, message: Column) -> Column:
        return F.struct(F.lit(agent).alias("agent"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), ok.alias("ok"), message.alias("message"))

    def either(ok: Column, yes: str, no: str) -> Column:
        return F.when(ok, F.lit(yes)).otherwise(F.lit(no))

    no, zero = F.lit(False), F.lit(0).cast("decimal(18,2)")
    net, vat, gross = (F.coalesce(money(F.col(c)), zero) for c in ("net_amount", "vat_amount", "gross_amount"))
    supplier, number = filled(F.col("supplier.name")), filled(F.col("invoice_number"))
    sums = F.concat(F.lit("HT+TVA="), two_decimals(net + vat), F.lit("; TTC="), two_decimals(gross))
    account = F.concat(F.lit("Compte "), F.coalesce("proposal.account", F.lit("None")), F.lit(" — confiance "), percent(F.col("proposal.confidence")), F.lit("%"))
    # Agents, codes, severities and messages.
    return F.array_compact(
        F.array(
            finding("FOURNISSEURS", "supplier", "error", supplier, either(supplier, "Fournisseur identifié", "Fournisseur à compléter")),
            finding("FACTURATION", "invoice_number", "error", number, either(number, "Numéro présent", "Numéro à compléter")),
            F.when(F.coalesce("needs_manual_extraction", no), finding("OCR", "manual", "error", no, F.lit("Lecture automatique insuffisante"))),
            F.when((net != 0) | (vat != 0), finding("TVA", "totals", "error", F.abs(net + vat - gross) <= F.lit(policy.rounding_tolerance), sums)),
            F.when(F.col("duplicate"), finding("FRAUDE", "duplicate", "critical", no, F.lit("Doublon détecté"))),
            F.when(F.coalesce("supplier_bank_details_changed", no), finding("TRESORERIE", "bank_change", "critical", no, F.lit("RIB modifié : blocage"))),
            F.when(F.coalesce("vat_treatment", F.lit("")) == "uncertain", finding("TVA", "vat", "critical", no, F.lit("TVA incertaine"))),
            finding("COMPTABILITE", "account", "warning", F.col("proposal.confidence") >= F.lit(policy.accounting_confidence), account),
        )
    )


def risk() -> Column:
    """The scores of the failed findings, up to the limit."""
    failed = lambda code: F.exists("findings", lambda x: (x.code == code) & ~x.ok)
    score = F.lit(0)
    for code, s in SCORES.items():
        score = score + F.when(failed(code), s).otherwise(0)
    return F.least(F.lit(RISK_LIMIT), score).cast("int")


def status() -> Column:
    return F.when(F.col("duplicate"), "DUPLICATE").when(F.exists("findings", lambda x: ~x.ok), "REVIEW_REQUIRED").otherwise("VALIDATED")


def decided(invoices: DataFrame, history: DataFrame | None = None, learned_top: DataFrame | None = None, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES, found: DataFrame | None = None) -> DataFrame:
    """invoices with fingerprint, duplicate, proposal, findings, risk_score, status, payment_authorized and human_review_required. Rules come before the shuffles of duplicates_marked(), so that line descriptions and texts are not dealt out unless they are asked for; the rest is a projection. found: the result of duplicates_found(), for invoices that are cheap to read twice; then whole rows meet it in a join, for which they need no shuffle if it is sent to them."""
    ruled = proposed(invoices, rules=rules)
    out = _learned_first(duplicates_marked(ruled, history) if found is None else _joined(ruled, found), learned_top)
    out = out.withColumn("findings", findings(policy)).withColumn("risk_score", risk()).withColumn("status", status())
    return out.withColumn("payment_authorized", F.lit(False)).withColumn("human_review_required", F.col("status") != "VALIDATED")


def first_arrivals(decisions: DataFrame) -> DataFrame:
    """What isn't a duplicate. By that flag, not by the status, whose expression has all findings in it: Spark would copy them into the filter."""
    return decisions.where(~F.col("duplicate"))


def accepted(decisions: DataFrame) -> DataFrame:
    """Rows of the invoices table for what isn't a duplicate; the id is the arrival."""
    raw = [c for c in ("format", "direction", "invoice_number", "issue_date", "due_date", "currency", "supplier", "customer", "lines", "raw_text", "net_amount", "vat_amount", "gross_amount") if c in decisions.columns]
    return first_arrivals(decisions).select(
        F.col("arrival").alias("id"), "fingerprint", "source_file", "source_path", "format", F.coalesce("direction", F.lit("purchase")).alias("direction"), "invoice_number",
        F.col("supplier.name").alias("supplier_name"), F.col("customer.name").alias("customer_name"), "issue_date", "due_date", "net_amount", "vat_amount", "gross_amount",
        F.coalesce("currency", F.lit("EUR")).alias("currency"), "status", F.lit("UNPAID").alias("payment_status"), "risk_score",
        F.col("proposal.account").alias("proposed_account"), F.col("proposal.confidence").alias("accounting_confidence"), F.to_json(F.struct(*raw)).alias("raw_json"),
    )


def _each_finding(decisions: DataFrame, kept: Column) -> DataFrame:
    """invoice_id and f, a row for each finding of what isn't a duplicate. The outer explode, as Spark has a filter on its argument before an inner one, which makes all findings once more."""
    return first_arrivals(decisions).select(F.col("arrival").alias("invoice_id"), F.explode_outer(kept).alias("f")).where("f is not null")


def audit_events(decisions: DataFrame, username: str = "system") -> DataFrame:
    """An event for each finding of what isn't a duplicate."""
    each = _each_finding(decisions, F.col("findings"))
    return each.select("invoice_id", F.lit(username).alias("username"), F.col("f.agent").alias("agent"), F.col("f.code").alias("event"), F.to_json("f").alias("details"))


def reviews(decisions: DataFrame) -> DataFrame:
    """An open review for each failed finding of what isn't a duplicate."""
    each = _each_finding(decisions, F.filter("findings", lambda x: ~x.ok))
    return each.select("invoice_id", F.col("f.message").alias("reason"), F.col("f.severity").alias("severity"), F.lit(False).alias("resolved"))
