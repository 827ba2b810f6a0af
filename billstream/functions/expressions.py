"""Column expressions on invoice text, numbers and dates. All are built-in functions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of an invoice number and of a total in a text.
NUMBER_PATTERN = r"(?iuUm)(?:facture|invoice)\s*(?:n[°oº]?|no|#)?\s*[:\-]?\s*([A-Z0-9_./-]+)"
AMOUNT_PATTERN = r"(?iuUm)(?:total\s*ttc|net\s*à\s*payer|amount\s*due)\s*:?\s*([0-9][0-9 .,'’]*)"
TEXT_KEPT = 30_000


def filled(x: Column) -> Column:
    """False for null and for the empty string."""
    return F.coalesce(x, F.lit("")) != ""


def if_filled(x: Column) -> Column:
    return F.when(x != "", x)


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def two_decimals(x: Column) -> Column:
    """An amount as text with two decimals."""
    return money(x).cast("string")


def blank(x: Column) -> Column:
    """Whether a text is white space only."""
    return ~F.rlike(x, F.lit(r"(?U)\S"))


def parsed_date(x: Column) -> Column:
    """A date from ISO text or from eight digits."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(x, F.lit("yyyyMMdd"))).cast("date")


def invoice_number_in(text: Column) -> Column:
    return if_filled(F.trim(F.regexp_extract(text, NUMBER_PATTERN, 1)))


def normalized_amount(x: Column) -> Column:
    """A number written the French or the English way; 0 where there is none.

    One comma without points is a decimal comma; with points, these separate
    thousands. Anything else must be a number as it stands.
    """
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9,.\-]", "")
    commas, points = F.regexp_count(digits, F.lit(",")), F.regexp_count(digits, F.lit("[.]"))
    plain = F.when((commas == 1) & (points == 0), F.replace(digits, F.lit(","), F.lit("."))).when((commas == 1) & (points >= 1), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(digits)
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def gross_amount_in(text: Column) -> Column:
    return normalized_amount(F.trim(F.regexp_extract(text, AMOUNT_PATTERN, 1)))


def fingerprint(siren: Column, name: Column, number: Column, issue_date: Column, gross: Column, currency: Column) -> Column:
    """What makes an invoice the same invoice: party, number, date, gross amount to the cent and currency. Null and missing are the empty text; the currency is EUR unless given."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    parts = (F.upper(F.coalesce(if_filled(siren), name, F.lit(""))), F.upper(blank(number)), blank(issue_date), blank(money(gross)), F.coalesce(currency, F.lit("EUR")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def percent(confidence: Column) -> Column:
    return F.round(confidence * 100, 0).cast("int").cast("string")
