"""Checks of Markdown nodes: frontmatter, sections, tables, links. nodes: path, node_type, fm (VARIANT), body.

The specification of the node types is data: a dict by type, as loaded from a
schema file, with the keys used below. Its rules become small literals inside
one expression per check.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .issues import Check, each_told, issues
from .integrity import registry
from .rules import absent, falsy

#: Headers of columns that hold dates.
DATE_HEADERS = ("date", "date / time", "date/time", "period", "start", "start date", "dates", "date captured", "date released")


def get(body: str, key: str) -> Column:
    """A field as text; null where it is absent or null."""
    return F.try_variant_get(F.col(body), f"$.{key}", "string")


def sections(nodes: DataFrame) -> DataFrame:
    """(path, node_type, fm, ord, title, text): the second-level sections, of equal titles the first."""
    parts = F.filter(F.split("body", r"(?m)^(?=## )"), lambda p: p.startswith("## "))
    rows = nodes.select("path", "node_type", "fm", parts.alias("_parts")).withColumn("_titles", F.transform("_parts", lambda p: F.trim(F.regexp_extract(p, r"\A## ([^\n]*)", 1))))
    rows = rows.select("path", "node_type", "fm", "_titles", F.posexplode_outer("_parts").alias("ord", "raw")).where("raw is not null")
    # a path is one row, so an earlier section of the title is told from the row itself
    rows = rows.withColumn("title", F.element_at("_titles", F.col("ord") + 1)).where(F.array_position("_titles", F.col("title")) == F.col("ord") + 1)
    return rows.select("path", "node_type", "fm", "ord", "title", F.regexp_replace("raw", r"\A## [^\n]*\n?", "").alias("text"))


def _by_type(spec: dict, pick) -> dict[str, list[str]]:
    return {t: list(v) for t, s in spec.items() if (v := pick(s))}


def _listed(table: dict[str, list[str]], key: Column) -> Column:
    """The list of a key as an array; null where the key has none."""
    if not table:
        return F.lit(None).cast("array<string>")
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))]
    return F.try_element_at(F.create_map(*entries), key)


def frontmatter_parse(nodes: DataFrame, spec: dict) -> DataFrame:
    message = F.when(F.col("fm").isNull(), "no frontmatter").when(get("fm", "type").isNull(), "no type").when(~get("fm", "type").isin(*spec), F.concat(F.lit("unknown type: "), get("fm", "type")))
    return issues(nodes.withColumn("_m", message).where("_m is not null"), F.col("path"), F.col("_m"), "frontmatter_parse", fatal=True)


def frontmatter_required(nodes: DataFrame, spec: dict) -> DataFrame:
    fields = sorted({f for s in spec.values() for f in s.get("required", ())})
    there = F.array_compact(F.array(*[F.when(~absent(F.col("fm"), f), F.lit(f)) for f in fields]))
    missing = F.array_except(_listed(_by_type(spec, lambda s: s.get("required")), F.col("node_type")), there)
    return issues(nodes.withColumn("_f", F.explode(missing)), F.col("path"), F.concat(F.lit("missing field: "), F.col("_f")), "frontmatter_required")


def schema_version_compat(rows: DataFrame, compatible: list[int], body: str = "fm") -> DataFrame:
    kind = F.schema_of_variant(F.try_variant_get(F.col(body), "$.schema_version", "variant"))
    value = F.try_variant_get(F.col(body), "$.schema_version", "long")
    message = F.when(absent(F.col(body), "schema_version"), "schema_version missing").when(kind != "BIGINT", "schema_version must be an integer").when(~value.isin(*compatible), F.concat(F.lit("schema_version not supported: "), value.cast("string")))
    return issues(rows.withColumn("_m", message).where("_m is not null"), F.col("path"), F.col("_m"), "schema_version_compat")


def id_path_match(nodes: DataFrame) -> DataFrame:
    bad = nodes.where(~falsy(F.col("fm"), "id") & (get("fm", "id") != F.regexp_replace("path", r"\.md$", "")))
    return issues(bad, F.col("path"), F.concat(F.lit("id does not match the path: "), get("fm", "id")), "id_path_match")


def vocabularies(nodes: DataFrame, spec: dict) -> DataFrame:
    """status, archetype and kind by type, where the type declares values for them; document forms only warn."""
    out = None
    for name, level, pick in (("status", "error", lambda s: s.get("status_values")), ("archetype", "error", lambda s: s.get("archetypes")), ("kind", "error", lambda s: s.get("kinds")), ("doc_form", "warn", lambda s: s.get("doc_form_values")), ("archival_status", "error", lambda s: s.get("archival_status_values"))):
        allowed = _listed(_by_type(spec, pick), F.col("node_type"))
        bad = nodes.where(~falsy(F.col("fm"), name) & allowed.isNotNull() & ~F.array_contains(allowed, get("fm", name)))
        part = issues(bad, F.col("path"), F.concat(F.lit(f"invalid {name}: "), get("fm", name)), "vocabularies", level)
        out = part if out is None else out.unionByName(part)
    return out


_EQUAL, _SET = re.compile(r"^(\w+) == (.+)$"), re.compile(r"^(\w+) is set$")


def condition(text: str, body: str = "fm") -> Column:
    """``<field> == <literal>`` or ``<field> is set``; anything else is an error of the schema."""
    if m := _SET.match(text):
        return ~falsy(F.col(body), m[1])
    if m := _EQUAL.match(text):
        return F.coalesce(get(body, m[1]) == m[2], F.lit(False))
    raise ValueError(f"unsupported condition: {text!r}")


def conditionally_required(nodes: DataFrame, spec: dict) -> DataFrame:
    """Lower-case keys are fields that must be set and, if they have values, hold one; others are sections that must be there."""
    titles = X.h2_titles(F.col("body"))
    found = []
    for kind, s in spec.items():
        for key, text in s.get("conditionally_required", {}).items():
            due = (F.col("node_type") == kind) & condition(text)
            if re.match(r"^[a-z_]+$", key):
                found.append(F.when(due & falsy(F.col("fm"), key), f"missing {key} (required when {text})"))
                if values := s.get(f"{key}_values"):
                    found.append(F.when(due & ~falsy(F.col("fm"), key) & ~get("fm", key).isin(*values), F.concat(F.lit(f"invalid {key}: "), get("fm", key))))
            else:
                found.append(F.when(due & ~F.array_contains(titles, key), f"missing section {key} (required when {text})"))
    rows = nodes.withColumn("_m", each_told(found)).where("_m is not null")
    return issues(rows, F.col("path"), F.col("_m"), "conditionally_required")


def required_sections(nodes: DataFrame, spec: dict, addenda: dict[str, list[str]] | None = None, topic: str = "") -> DataFrame:
    """The sections of the archetype, else of the kind, else of the type, and those of the corpus; an unknown archetype or kind asks for none."""
    named = lambda v: [x.replace("{topic_display_name}", topic) for x in v]
    wanted = F.lit(None).cast("array<string>")
    for kind, s in spec.items():
        own = F.array(*[F.lit(x) for x in named(s.get("required_sections", ()))]).cast("array<string>")
        for level in ("kinds", "archetypes"):
            if isinstance(s.get(level), dict):
                field = level[:-1]
                table = {k: named((v or {}).get("required_sections", s.get("required_sections", ()))) for k, v in s[level].items()}
                own = F.when(falsy(F.col("fm"), field), own).otherwise(F.coalesce(_listed(table, get("fm", field)), F.array().cast("array<string>")))
        wanted = F.when(F.col("node_type") == kind, own).otherwise(wanted)
    extra = _listed({k: named(v) for k, v in (addenda or {}).items()}, get("fm", "corpus"))
    wanted = F.concat(wanted, F.coalesce(extra, F.array().cast("array<string>")))
    titles = X.h2_titles(F.col("body"))
    missing = F.filter(wanted, lambda r: ~F.exists(titles, lambda t: (t == r) | t.startswith(F.concat(r, F.lit(" ("))) | t.startswith(F.concat(r, F.lit(" —")))))
    return issues(nodes.withColumn("_s", F.explode(missing)), F.col("path"), F.concat(F.lit("missing section: "), F.col("_s")), "required_sections")


def section_rules(nodes: DataFrame, spec: dict) -> DataFrame:
    """No tables in prose, the parts of split sections, an attribution for every block quote."""
    lines = F.transform(F.split("text", "\n"), lambda l: F.trim(l))
    quoted = F.transform(lines, lambda l: l.startswith(">"))
    blocks = F.size(F.filter(F.transform(quoted, lambda q, i: q & ((i == 0) | ~F.coalesce(F.get(quoted, i - 1), F.lit(False)))), lambda b: b))
    shown = F.size(F.filter(lines, lambda l: l.startswith("| Source |") | ((F.length(l) > 2) & l.startswith("_") & l.endswith("_"))))
    parts = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^### ([^\n]+)"), F.lit(1)), lambda t: F.trim(t))
    found = []
    for kind, s in spec.items():
        for title, r in s.get("section_rules", {}).items():
            own = (F.col("node_type") == kind) & (F.col("title") == title)
            if r.get("prose_only"):
                found.append(F.when(own & F.col("text").rlike(r"(?m)^\|[^\n]*\|\s*\n\|[\s:|-]+\|"), F.lit("prose only, no tables")))
            found += [F.when(own & ~F.array_contains(parts, sub), F.lit(f"missing ### {sub}")) for sub in r.get("split", ()) if sub != "Flagged"]
            if r.get("requires_quote_attribution"):
                found.append(F.when(own & (blocks > shown), F.lit("block quotes without attribution")))
    rows = sections(nodes).withColumn("_m", each_told(found)).where("_m is not null")
    return issues(rows, F.col("path"), F.concat(F.col("title"), F.lit(": "), F.col("_m")), "section_rules")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(path, title, table, row, col, header, cell) of the tables in sections; cells part at every bar."""
    lines = sections(nodes).select("path", "title", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    w = W.partitionBy("path", "title").orderBy("line")
    bar = F.trim("raw").startswith("|") & F.trim("raw").endswith("|") & (F.length(F.trim("raw")) > 1)
    lines = lines.withColumn("bar", bar).withColumn("table", F.sum((~F.col("bar")).cast("int")).over(w)).where("bar")
    inner = F.regexp_replace(F.trim("raw"), r"^\||\|$", "")
    t = W.partitionBy("path", "title", "table").orderBy("line")
    lines = lines.select("path", "title", "table", "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"), F.trim("raw").rlike(r"^\|[\s:|-]+\|$").alias("rule"))
    lines = lines.withColumn("header", F.first("cells").over(t)).withColumn("row", F.row_number().over(t) - 1).withColumn("ruled", F.max(F.col("rule").cast("int")).over(W.partitionBy("path", "title", "table")))
    data = lines.where("not rule and ruled = 1 and row > 0")
    return data.select("path", "title", "table", "row", F.posexplode("cells").alias("col", "cell"), "header").withColumn("header", F.lower(F.get("header", F.col("col"))))


def chronological_tables(nodes: DataFrame) -> DataFrame:
    """An error at the first row of a table that lies before its nearest dated predecessor; a warning for every cell that is no date."""
    cells = table_cells(nodes).where(F.col("header").isin(*DATE_HEADERS)).withColumn("first", F.min("col").over(W.partitionBy("path", "title", "table"))).where("col = first")
    cells = cells.withColumn("d", X.partial_date(F.col("cell")))
    warn = issues(cells.where("d is null and cell <> ''"), F.col("path"), F.concat(F.col("title"), F.lit(": unparseable date: "), F.col("cell")), "chronological_tables", "warn")
    before = W.partitionBy("path", "title", "table").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    late = cells.withColumn("p", F.last("d", True).over(before)).where("d < p").groupBy("path", "title", "table").agg(F.min(F.struct("row", "cell")).alias("f"))
    return warn.unionByName(issues(late, F.col("path"), F.concat(F.col("title"), F.lit(": out of order at "), F.col("f.cell")), "chronological_tables"))


def table_cell_word_budget(nodes: DataFrame, most: int = 55) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("cell", r"\[`[^`]+`\]", ""), r"[*_`]", "")
    cells = table_cells(nodes).where("header <> 'note' or header is null").withColumn("n", F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")))
    return issues(cells.where(F.col("n") > most), F.col("path"), F.concat(F.col("title"), F.lit(": cell of "), F.col("n").cast("string"), F.lit(" words")), "table_cell_word_budget", "warn")


def link_resolution(nodes: DataFrame) -> DataFrame:
    """The registry of links to nodes that do not exist: (dst, referrers, n)."""
    edges = nodes.select(F.col("path").alias("src"), F.explode(X.links(F.col("body"))).alias("dst"))
    return registry(edges, nodes.select(F.concat(F.lit("/"), F.regexp_replace("path", r"\.md$", "")).alias("dst")))


def node_checks(spec: dict, compatible: list[int]) -> list[Check]:
    """The ordered registry of node checks over the table ``nodes``."""
    one = lambda fn, *a: lambda t: fn(t["nodes"], *a)
    fns = [
        ("frontmatter_parse", one(frontmatter_parse, spec)), ("frontmatter_required", one(frontmatter_required, spec)), ("schema_version_compat", one(schema_version_compat, compatible)),
        ("id_path_match", one(id_path_match)), ("vocabularies", one(vocabularies, spec)), ("conditionally_required", one(conditionally_required, spec)), ("required_sections", one(required_sections, spec)),
        ("section_rules", one(section_rules, spec)), ("chronological_tables", one(chronological_tables)), ("table_cell_word_budget", one(table_cell_word_budget)),
    ]
    return [Check(name, k, fn) for k, (name, fn) in enumerate(fns)]


# -- governance files
#: What their headers must have, where templates and notes are, and the record of the topic.
META_FIELDS = ("id", "type", "schema_version", "created")
TEMPLATES, NOTES, OVERVIEW = "meta/templates/", "meta/topic/working-notes/", "meta/topic/overview.md"


def governance_files(files: DataFrame, compatible: list[int], folders: dict[str, str]) -> DataFrame:
    """Headers of the files under ``meta``; templates by their lines, as their placeholders are no YAML. files: path, raw, fm (VARIANT, null where there is none).

    folders: the folder of each node type. Working notes are left out; the record of the topic must be there.
    """
    rows = files.where(F.col("path").startswith("meta/") & F.col("path").endswith(".md") & ~F.col("path").startswith(NOTES))
    fm, own = F.col("fm"), F.regexp_replace("path", r"\.md$", "")
    version = F.try_variant_get(fm, "$.schema_version", "long")
    kind = F.schema_of_variant(F.try_variant_get(fm, "$.schema_version", "variant"))
    plain = [F.when(fm.isNull(), F.lit("missing or malformed frontmatter"))]
    plain += [F.when(fm.isNotNull() & absent(fm, f), F.lit(f"missing field: {f}")) for f in META_FIELDS]
    plain += [F.when(~absent(fm, "schema_version") & (kind != "BIGINT"), F.lit("schema_version must be an integer")), F.when((kind == "BIGINT") & ~version.isin(*compatible), F.concat(F.lit("schema_version not supported: "), version.cast("string")))]
    plain += [F.when(~absent(fm, "id") & ~F.coalesce(get("fm", "id") == own, F.lit(False)), F.concat(F.lit("id does not match the path: "), F.coalesce(get("fm", "id"), F.lit("null"))))]
    plain += [F.when((F.col("path") == OVERVIEW) & fm.isNotNull() & absent(fm, f), F.lit(f"missing topic field: {f}")) for f in ("topic", "display_name")]
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    block = F.regexp_extract("raw", r"(?s)\A---(.*?)\n---", 1)
    line = lambda key, value: F.regexp_extract(block, rf"(?m)^{key}:[ \t]*({value})[ \t]*$", 1)
    folder = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in folders.items() for x in kv]), stem), stem) if folders else stem
    opened, closed = F.startswith("raw", F.lit("---")), F.col("raw").rlike(r"(?s)\A---.*?\n---")
    ident, named, numbered = line("id", r"\S.*?"), line("type", r"\S.*?"), line("schema_version", "[0-9]+")
    held = [
        F.when(~opened, F.lit("template has no frontmatter")), F.when(opened & ~closed, F.lit("frontmatter of the template is not closed")), F.when(closed & (ident == ""), F.lit("template has no id")),
        F.when(closed & (ident != "") & (ident != F.concat(folder, F.lit("/{{slug}}"))), F.concat(F.lit("id of the template is not its pattern: "), ident)), F.when(closed & (named == ""), F.lit("template has no type")),
        F.when(closed & (named != "") & (named != stem), F.concat(F.lit("type of the template is not its name: "), named)), F.when(closed & (numbered == ""), F.lit("template has no schema_version")),
        F.when(closed & (numbered != "") & ~numbered.cast("long").isin(*compatible), F.concat(F.lit("schema_version not supported: "), numbered)), F.when(closed & ~block.rlike(r"(?m)^created:[ \t]*\S"), F.lit("template has no created")),
    ]
    is_template = F.col("path").startswith(TEMPLATES)
    every = F.when(is_template, F.array(*held)).otherwise(F.array(*plain))
    out = issues(rows.withColumn("_m", F.explode(F.array_compact(every))), F.col("path"), F.col("_m"), "governance_files")
    absent_ = files.select(F.max((F.col("path") == OVERVIEW).cast("int")).alias("n")).where("coalesce(n, 0) = 0")
    return out.unionByName(issues(absent_, F.lit(OVERVIEW), F.lit("required file is missing"), "governance_files"))
