"""Invoices to a ledger: decoding of a model's answer, routing, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip_fences

# Types of invoice and the fields of an answer.
TYPES = ("sales", "expense", "unrecognized")
TEXT_FIELDS = ("party_name", "invoice_number", "date", "currency")


def decode(invoices: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ("invoice_id", "filename")) -> DataFrame:
    """Typed invoice from JSON; what doesn't parse, or isn't an object, gives the default record.

    ``amount`` and ``vat`` stay VARIANT, as their type decides whether they count.
    """
    answer = F.try_parse_json(strip_fences(F.col(raw)))
    base = invoices.select(*keep, answer.alias("__a"))
    ok = F.coalesce(F.schema_of_variant("__a").startswith("OBJECT"), F.lit(False))

    def text(field: str) -> Column:
        return F.coalesce(F.try_variant_get("__a", f"$.{field}", "string"), F.lit(""))

    kind = F.try_variant_get("__a", "$.document_type", "string")
    return base.withColumn("__a", F.when(ok, F.col("__a"))).select(
        *keep,
        F.when(kind.isin(*TYPES), kind).otherwise("unrecognized").alias("document_type"),
        *(text(f).alias(f) for f in TEXT_FIELDS),
        F.try_variant_get("__a", "$.amount", "variant").alias("amount"),
        F.try_variant_get("__a", "$.vat", "variant").alias("vat"),
    )


def number(value: str) -> Column:
    """A5: the number in a VARIANT whose type is a number or a truth value; null for strings, nulls and others."""
    kind = F.schema_of_variant(value)
    counts = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    return F.when(F.col(value).isNotNull(), counts)


def totals(ledger: DataFrame, *by: str) -> DataFrame:
    """A4, A5: rows and sums of amount and vat per ``by`` (document_type, and currency if wanted)."""
    return ledger.select(*by, number("amount").alias("a"), number("vat").alias("v")).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 2).alias("amount"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("vat")
    )


def summary_line(sums: DataFrame) -> DataFrame:
    """One row (summary) of the batch: counts, and totals of sales and expenses. Built from a row per type."""
    pick = lambda kind, c: F.coalesce(F.sum(F.when(F.col("document_type") == kind, F.col(c))), F.lit(0))
    money = lambda kind, c: F.format_string("%.2f", pick(kind, c).cast("double"))
    count = lambda kind: pick(kind, "n").cast("string")
    return sums.agg(
        F.concat(
            F.lit("Processed "), F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" page(s)/file(s): "), count("sales"), F.lit(" sales, "), count("expense"), F.lit(" expenses, "),
            count("unrecognized"), F.lit(" unrecognized.\nTotal sales: "), money("sales", "amount"), F.lit(" (VAT: "), money("sales", "vat"), F.lit(") | Total expenses: "),
            money("expense", "amount"), F.lit(" (VAT: "), money("expense", "vat"), F.lit(")"),
        ).alias("summary")
    )


def batch_report(ledger: DataFrame, name: str = "filename") -> DataFrame:
    """(part, place, line): the summary's two lines as part 0, then, where there are any, a heading (1) and a line per
    unrecognized name (2, in order of the names). Rows, since the names have no bound; joined by line feeds in order of (part,
    place) they are the text. Null names read as empty."""
    first = summary_line(totals(ledger, "document_type")).select(F.lit(0).alias("part"), F.lit("").alias("place"), F.col("summary").alias("line"))
    names = ledger.where("document_type = 'unrecognized'").select(F.coalesce(name, F.lit("")).alias("n"))
    heading = names.limit(1).select(F.lit(1), F.lit(""), F.lit("\nNot recognized (check these manually):"))
    return first.union(heading).union(names.select(F.lit(2), "n", F.concat(F.lit("- "), "n")))


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """Rows with the sheet they belong to and their seven cells as text."""
    sheet = F.when(F.col("document_type") == "sales", "Sales").when(F.col("document_type") == "expense", "Expenses").otherwise("Unrecognized")
    return ledger.select(sheet.alias("sheet"), "invoice_id", "date", "invoice_number", "party_name", number("amount").alias("amount"), number("vat").alias("vat"), "currency", "filename")
