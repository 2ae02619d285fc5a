"""Rows to documents: ordered string aggregation, tables, quote blocks, marked regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_cell

SEPARATOR = "\n---\n\n"


def joined(line: Column, order: Column, separator: str = "\n") -> Column:
    """Aggregate: the lines in the order of the sort key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), separator)


def table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_cell(c.cast("string")) for c in cells]), F.lit(" |"))


def table(rows: DataFrame, keys: list[str], header: list[str], cells: list[Column], order: Column) -> DataFrame:
    """(keys, body): one table per key, its rows in order."""
    head = "| " + " | ".join(header) + " |\n" + "|" + "|".join(["---"] * len(header)) + "|\n"
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), joined(table_row(cells), order)).alias("body"))


def sections(parts: list[Column]) -> Column:
    """Sections with the separator between them, the empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), SEPARATOR)


def quote_block(text: Column, speaker: Column, date: Column, context: Column) -> Column:
    """A quotation and its attribution; the date is added unless the context has it."""
    dated = F.when(date.isNotNull() & ~F.coalesce(F.contains(context, date), F.lit(False)), F.concat(F.lit(", "), date)).otherwise(F.lit(""))
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n— "), F.coalesce(speaker, F.lit("unattributed")), dated)


def splice(document: Column, start: str, end: str, block: Column) -> Column:
    """The document with the region between two markers replaced."""
    head, tail = F.substring_index(document, start, 1), F.substring_index(document, end, -1)
    whole = F.contains(document, F.lit(start)) & F.contains(document, F.lit(end))
    return F.when(whole, F.concat(head, F.lit(start), F.lit("\n"), block, F.lit("\n"), F.lit(end), tail)).otherwise(document)


def split_flagged(rows: DataFrame, keys: list[str], flagged: Column, line: Column, order: Column) -> DataFrame:
    """(keys, confirmed, flagged): the lines of each side in order."""
    one = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct(order.alias("o"), line.alias("l"))))), lambda x: x["l"]), "\n")
    return rows.groupBy(*keys).agg(one(~flagged).alias("confirmed"), one(flagged).alias("flagged"))
