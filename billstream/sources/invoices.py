"""Invoice documents as records of schemas.INVOICE: XML, JSON and extracted text."""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billstream.config import EXTENSIONS
from billstream.functions.expressions import TEXT_KEPT, blank, gross_amount_in, invoice_number_in
from billstream.schemas import INVOICE, MONEY


MARK = "\ufeff"
DECLARATION = re.compile(r"^\s*<\?xml[^>]*\?>", re.ASCII)


class Place(NamedTuple):
    """Where a value stands: the text of an element of that local name; if within is given, of one below such an element, or (child) right below it."""

    name: str
    within: str | None = None
    child: bool = False


#: Where each field stands in the two kinds of XML invoice, the first that is there wins.
PLACES = {
    "invoice_number": [Place("ID"), Place("ID", "ExchangedDocument", child=True)],
    "issue_date": [Place("IssueDate"), Place("DateTimeString", "IssueDateTime")],
    "due_date": [Place("DueDate"), Place("DateTimeString", "SpecifiedTradePaymentTerms")],
    "supplier_name": [Place("RegistrationName", "AccountingSupplierParty"), Place("Name", "SellerTradeParty")],
    "customer_name": [Place("RegistrationName", "AccountingCustomerParty"), Place("Name", "BuyerTradeParty")],
    "net_amount": [Place("TaxExclusiveAmount"), Place("TaxBasisTotalAmount")],
    "vat_amount": [Place("TaxAmount"), Place("TaxTotalAmount")],
    "gross_amount": [Place("PayableAmount"), Place("GrandTotalAmount")],
    "currency": [Place("DocumentCurrencyCode"), Place("InvoiceCurrencyCode")],
}


def first_texts(xml: str, places: dict[str, list[tuple[int, Place]]], n: int) -> tuple[str, list[str | None]] | None:
    """The local name of the document's element, and the first text at each of n places (numbered, by name) without white space around it; None for what isn't one well-formed element.

    One pass over the document, below one more element, without byte order mark
    and XML declaration. A text ends at any tag, comment or instruction; CDATA
    belongs to the text around it.
    """
    parser, values = expat.ParserCreate(), [None] * n
    names, wanted, run, roots, beside = [], [], [], [], []

    def close(*_) -> None:
        if run:
            text = "".join(run).strip()
            run.clear()
            if len(names) == 1:
                beside.append(text)
            for i in wanted[-1]:
                if values[i] is None:
                    values[i] = text

    def start(name: str, _) -> None:
        close()
        name = name[name.find(":") + 1 :]
        if len(names) == 1:
            roots.append(name)
        wanted.append([i for i, p in places.get(name, ()) if p.within is None or (names[-1] == p.within if p.child else p.within in names)])
        names.append(name)

    def end(_) -> None:
        close()
        names.pop()
        wanted.pop()

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, run.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = close
    try:
        parser.Parse(f"<w>{DECLARATION.sub('', xml.removeprefix(MARK), count=1)}</w>", True)
    except expat.ExpatError:
        return None
    return (roots[0], values) if len(roots) == 1 and not any(beside) else None


def xml_fields(xml: Column, legacy_id_order: bool = False) -> Column:
    """struct(format and the fields of PLACES, as text) of an XML document; null for what isn't one well-formed element, and for document types. Each document is parsed once, in Arrow batches; not evaluated again by a filter on it."""
    fields = ["format", *PLACES]
    flat = [(f, p) for f, ps in PLACES.items() for p in ps]
    places: dict[str, list[tuple[int, Place]]] = {}
    for i, (_, p) in enumerate(flat):
        places.setdefault(p.name, []).append((i, p))
    at = {f: [i for i, (g, _) in enumerate(flat) if g == f] for f in PLACES}

    def record(text: str | None) -> list[str | None] | None:
        found = None if text is None or "<!DOCTYPE" in text else first_texts(text, places, len(flat))
        if found is None:
            return None
        root, values = found
        cii = "CrossIndustryInvoice" in root
        order = at | {"invoice_number": at["invoice_number"][::-1]} if cii and not legacy_id_order else at
        return ["CII" if cii else "UBL", *(next((values[i] for i in order[f] if values[i] is not None), None) for f in PLACES)]

    @F.arrow_udf(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    def run(xml: pa.Array) -> pa.Array:
        rows = [record(x) for x in xml.to_pylist()]
        columns = [pa.array([None if r is None else r[i] for r in rows], pa.string()) for i in range(len(fields))]
        return pa.StructArray.from_arrays(columns, names=fields, mask=pa.array([r is None for r in rows], pa.bool_()))

    return run.asNondeterministic()(xml)


def invoice_xml(documents: DataFrame, legacy_id_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of documents (xml, source_file, source_path, and others, which stay).

    Rejected is what isn't one well-formed element: broken or trailing markup,
    several roots, text, document types. For CII the document's own id is read
    before other ids, or after them if legacy_id_order is set.
    """
    rows, f = documents.withColumn("__f", xml_fields(F.col("xml"), legacy_id_order)), F.col("__f")
    amount = lambda c: F.coalesce(f[c].try_cast(MONEY), F.lit(0).cast(MONEY)).alias(c)
    name = lambda c: F.coalesce(f[c], F.lit("")).alias("name")
    null = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    fields = (
        f["format"].alias("format"), F.lit("purchase").alias("direction"), *(f[c].alias(c) for c in ("invoice_number", "issue_date", "due_date")), F.coalesce(f["currency"], F.lit("EUR")).alias("currency"),
        F.struct(name("supplier_name"), *map(null, ("siren", "vat_number", "email", "iban"))).alias("supplier"), F.struct(name("customer_name"), *map(null, ("siren", "vat_number", "email", "address"))).alias("customer"),
        F.array().cast(INVOICE["lines"].dataType).alias("lines"), null("raw_text"), amount("net_amount"), amount("vat_amount"), amount("gross_amount"),
        null("needs_manual_extraction", "boolean"), null("supplier_bank_details_changed", "boolean"), null("vat_treatment"),
    )
    rest = [c for c in documents.columns if c != "xml"]
    return rows.where(f.isNotNull()).select(*rest, *fields), rows.where(f.isNull()).select(*documents.columns)


#: Byte order marks, and how a document begins that has none of them, in hexadecimal; the longest first.
BEGINNINGS = {"EFBBBF": "utf-8-sig", "0000FEFF": "utf-32", "FFFE0000": "utf-32", "FEFF": "utf-16", "FFFE": "utf-16", "003C003F": "utf-16-be", "3C003F00": "utf-16-le"}
DECLARED = r"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']"""


def encoding_of(content: Column) -> Column:
    """The encoding of an XML document: by its first bytes, else as declared, else UTF-8. A declared 16- or 32-bit encoding that the first bytes rule out is UTF-8."""
    head = F.hex(F.substring(content, 1, 4))
    declared = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 400), "ISO-8859-1"), DECLARED, 1))
    out = None
    for mark, name in BEGINNINGS.items():
        out = (F if out is None else out).when(head.startswith(mark), F.lit(name))
    return out.when((declared == "") | declared.rlike("^(utf-?(8|16|32)|ucs-?[24])"), F.lit("utf-8")).otherwise(declared)


def decoded(content: Column, encoding: Column) -> Column:
    """The text of documents in any encoding that Python knows; null for unknown names and for bytes that can't be decoded. UTF-8 doesn't leave the JVM."""
    @F.pandas_udf("string")
    def other(content: pd.Series, encoding: pd.Series) -> pd.Series:
        def text(data: bytes | None, name: str) -> str | None:
            try:
                return None if data is None else data.decode(name)
            except (UnicodeError, LookupError):
                return None

        return pd.Series([text(d, n) for d, n in zip(content, encoding, strict=True)], dtype=object)

    plain = encoding.isin("utf-8", "utf-8-sig")
    text = content.cast("string")
    return F.when(plain, F.when(F.is_valid_utf8(text), text)).otherwise(other(F.when(~plain, content), encoding))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """content, source_file, source_path of the files below path, in whatever folder. Spark reads the bytes only where a query asks for them; it passes over files without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def decoded_xml(files: DataFrame) -> DataFrame:
    """files (content, and others) with xml, the text in their encoding, instead of content; null if it can't be decoded."""
    known = files.select(F.struct(*files.columns).alias("of"), encoding_of(F.col("content")).alias("encoding"))
    read = known.select("of", decoded(F.col("of.content"), F.col("encoding")).alias("xml"))
    return read.select(*(F.col("of")[c].alias(c) for c in files.columns if c not in ("content", "xml")), "xml")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """xml, source_file, source_path of the files below path, in the encoding that each declares."""
    return decoded_xml(read_files(spark, path)).select("xml", "source_file", "source_path")


class Ingested(NamedTuple):
    """What files became: records (schemas.INVOICE and the files' other columns), rejects (with reason), and PDF files that wait for text extraction."""

    records: DataFrame
    rejects: DataFrame
    waiting: DataFrame


#: Why a file was rejected.
UNKNOWN_FORMAT, UNREADABLE, BROKEN = "unsupported format", "cannot be decoded", "not one XML document"


def ingested(files: DataFrame, legacy_id_order: bool = False) -> Ingested:
    """files (content, source_file, source_path, and others, which stay) by their extension: XML documents become records with their file's name and path, or are rejected; so are files of other kinds.

    Each part reads what it needs only: the bytes of XML files, none of others.
    An empty document is a broken one, null content can't be decoded, and a file
    without a name has no extension.
    """
    rest = [c for c in files.columns if c != "content"]
    route = route_of(F.col("source_file"))
    records, broken = invoice_xml(decoded_xml(files.where(route == "xml")), legacy_id_order)
    reason = F.when(F.col("xml").isNull(), UNREADABLE).otherwise(BROKEN)
    rejects = files.where(route == "rejected").select(*rest, F.lit(UNKNOWN_FORMAT).alias("reason")).unionByName(broken.select(*rest, reason.alias("reason")))
    return Ingested(records, rejects, files.where(route == "pdf").select(*rest))


def ingest(spark: SparkSession, folder: str, legacy_id_order: bool = False) -> Ingested:
    """Records, rejects and waiting PDF files of a folder of mixed files."""
    return ingested(read_files(spark, folder), legacy_id_order)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents, one a line, with the name and path of the file that each is in; what can't be read is in _corrupt_record."""
    schema = T.StructType([*INVOICE.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.withColumns({"source_file": F.col("_metadata.file_name"), "source_path": F.col("_metadata.file_path")})


def from_raw_json(raw: Column) -> Column:
    return F.from_json(raw, INVOICE)


def invoice_text(texts: DataFrame) -> DataFrame:
    """texts (text, and others, which stay) with invoice_number, gross_amount (double), raw_text, format and needs_manual_extraction."""
    text = F.coalesce("text", F.lit(""))
    nothing = blank(text)
    return (
        texts.withColumn("invoice_number", invoice_number_in(text))
        .withColumn("gross_amount", gross_amount_in(text))
        .withColumn("raw_text", F.substring(text, 1, TEXT_KEPT))
        .withColumn("format", F.when(nothing, "PDF_IMAGE").otherwise("PDF_TEXT"))
        .withColumn("needs_manual_extraction", nothing)
        .drop("text")
    )


def _extension(source_file: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(source_file, F.lit("")), r"(\.[^.]+)$", 1))


def route_of(source_file: Column) -> Column:
    """xml, pdf (kept for extraction elsewhere) or rejected, by the file's extension."""
    extension = _extension(source_file)
    return F.when(extension == ".pdf", "pdf").when(extension.isin(*EXTENSIONS), "xml").otherwise("rejected")


def routed(files: DataFrame) -> DataFrame:
    """files (source_file, and others) with extension (small letters) and route, by route_of()."""
    return files.withColumn("extension", _extension(F.col("source_file"))).withColumn("route", route_of(F.col("source_file")))
