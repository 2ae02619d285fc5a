"""Contributor tools as table operators: quote positions, generated link sections, empty artifacts."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .rules import rule_matches

#: The headings of linked nodes by folder, in order.
GROUPS = ("people", "organizations", "events", "documents", "transcripts", "media", "locations", "findings")
_PLAIN = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", " ": " "})
_SPAN = T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])


def _squeezed(text: str) -> tuple[str, list[int], list[int]]:
    """The words of a text with single spaces, where each word begins in it, and where it begins in the text."""
    words, at, origin, n = [], [], [], 0
    for m in re.finditer(r"\S+", text.translate(_PLAIN)):
        at.append(n)
        origin.append(m.start())
        words.append(m[0])
        n += len(m[0]) + 1
    return " ".join(words), at, origin


def lines_of_quote(quote: str | None, source: str | None) -> tuple[int, int] | None:
    """First and last line of a quote in its source, by its first 80 (else 30) and its last 80 characters, whatever the white space."""
    if not quote or not source:
        return None
    bare = re.sub(r"(?m)^>\s?", "", re.sub(r"^\[\d+:\d+(?::\d+)?\]\s*", "", quote.strip())).strip()
    wanted, (flat, at, origin) = _squeezed(bare)[0], _squeezed(source)
    start = flat.find(wanted[:80].strip()) if wanted else -1
    if wanted and start < 0 and len(wanted) > 30:
        start = flat.find(wanted[:30].strip())
    if start < 0:
        return None

    def line(place: int) -> int:
        k = bisect_right(at, place) - 1
        return source.count("\n", 0, origin[k] + place - at[k]) + 1

    tail = wanted[-80:].strip()
    end = flat.find(tail, start)
    return line(start), line(end + len(tail) - 1) if end >= 0 else line(start) + bare.count("\n")


@F.pandas_udf(_SPAN)
def quote_lines(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    found = [lines_of_quote(q, s) for q, s in zip(quote, source)]
    return pd.DataFrame({"start_line": pd.array([f and f[0] for f in found], "Int32"), "end_line": pd.array([f and f[1] for f in found], "Int32")})


def canonical_locations(quotes: DataFrame) -> DataFrame:
    """Quotes whose location is a bare line number, with ``proposed``. quotes: location, quote, source_text."""
    span = quote_lines(F.col("quote"), F.col("source_text"))
    rows = quotes.where(X.classify_location(F.col("location")) == "deprecated").withColumn("_s", span)
    return rows.withColumn("proposed", F.format_string("lines %d-%d of the extract", "_s.start_line", "_s.end_line")).withColumn("proposed", F.when(F.col("_s.start_line").isNotNull(), F.col("proposed"))).drop("_s")


def _by_kind(links: Column, kind: str) -> Column:
    """The lines of one kind's links; null where there are none."""
    lines = F.array_join(F.filter(links, lambda l: l.startswith(f"/{kind}/")), "`]\n- [`")
    return F.concat(F.lit(f"### {kind.capitalize()}\n\n- [`"), F.nullif(lines, F.lit("")), F.lit("`]"))


def with_associated(nodes: DataFrame) -> DataFrame:
    """Nodes with the section regenerated, of their links by kind without themselves, at the end where there was none, and whether that changed the body. nodes: path, body."""
    old = F.regexp_replace("body", r"(?ms)^## Associated Nodes\s*\n.*?(?=^## |\z)", "")
    rows = nodes.withColumn("_bare", F.rtrim(F.when(F.contains("body", F.lit("## Associated Nodes")), old).otherwise(F.col("body")), F.lit(" \n")))
    own = F.regexp_replace("path", r"\.md$", "")
    # columns of their own, as each is named again: inside one expression the links would be found anew for each kind
    rows = rows.withColumn("_links", F.array_except(X.links(F.col("_bare")), F.array(F.concat(F.lit("/"), own), own)))
    section = F.concat(F.lit("## Associated Nodes\n\n<!-- generated from the links of the body -->\n\n"), F.array_join(F.array(*[_by_kind(F.col("_links"), g) for g in GROUPS]), "\n\n"), F.lit("\n"))
    rows = rows.withColumn("_new", F.concat("_bare", F.lit("\n\n"), section))
    return rows.withColumn("changed", F.col("_new") != F.col("body")).withColumn("body", F.col("_new")).drop("_new", "_links", "_bare")


def scaffold(targets: DataFrame, rules: dict[str, list[dict[str, list[str]]]], sources: DataFrame) -> DataFrame:
    """(path, json): an empty artifact for each target, with the sections its rules ask for. targets: path, type, archetype, kind; sources: path, source_path, format."""
    given = sources.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("source_path").alias("path"), "format"))).alias("_s"))
    due = F.array_compact(F.array(*[F.when(rule_matches(r), F.lit(s)) for s, r in rules.items()]))
    lists = F.array_join(F.transform(due, lambda s: F.concat(F.lit('"'), s, F.lit('": []'))), ", ")
    head = F.to_json(F.struct(F.lit("research-artifact").alias("type"), F.col("path").alias("target_node"), F.coalesce("_s", F.array().cast("array<struct<path:string,format:string>>")).alias("primary_sources")))
    rest = '"document_intrinsic": {}, "context_extrinsic": {}, "quotes": [], "entities_referenced": [], "naming_quirks": []'
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(f", {rest}"), F.when(F.size(due) > 0, F.concat(F.lit(", "), lists)).otherwise(""), F.lit("}"))
    return targets.join(given, "path", "left").select("path", body.alias("json"))
