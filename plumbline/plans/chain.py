"""The checks of nodes, artifacts and manifests over documents made from the standard tables.

Each document is JSON that one piece of SQL, read alike by both engines, makes of
customers and orders; remainders of their keys decide which fields are absent,
null, blank or wrong, so every rule meets rows that keep and that break it. The
oracle reads the same JSON with DuckDB's functions and states the rules anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import written
from ..operators import artifacts, issues, manifest, nodes, rules, tools
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


#: Rows of a table from which a task makes documents; a row may become hundreds.
DEAL = 5_000


def dealt(table: DataFrame) -> DataFrame:
    """A table's rows by a hash of its first column, in parts of about DEAL rows: small files are one task each as they lie, and what groups by that column needs no further shuffle."""
    parts = max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / DEAL))
    return table.repartition(parts, table.columns[0])


def _sql(spark: SparkSession, sf: str, text: str, *tables: str) -> DataFrame:
    """SQL that both engines read alike, over tables of the folder."""
    for t in tables:
        dealt(spark.read.parquet(f"{sf}/{t}.parquet")).createOrReplaceTempView(f"chain_{t}")
        text = text.replace(f"FROM {t}", f"FROM chain_{t}").replace(f"JOIN {t}", f"JOIN chain_{t}")
    return spark.sql(text)


def _found(df: DataFrame) -> DataFrame:
    return df.select("path", "level", "check_name", "message")


def _values(rows: list[tuple]) -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


# -- entries of list sections
_LIST_GOOD, _LIST_BAD = '["/a/b", "/c"]', '["/a/b", "c", 3]'


def _entry_fields() -> list[tuple]:
    """(section, field, good, bad, salt): what an entry may hold, as JSON values."""
    out = []
    for r in rules.ENTRY_RULES:
        named: dict[str, tuple[str, str]] = {f: ('"some words"', '"w"') for f in (*r.required, *r.non_blank)}
        for group in (r.enums, r.strict_enums, r.warned_enums):
            named |= {f: (f'"{v[0]}"', '"odd"') for f, v in group.items()}
        named |= {f: (f'"{p}x"', '"x/y"') for f, p in r.paths.items()}
        named |= {f: (_LIST_GOOD, _LIST_BAD) for f in r.lists}
        if r.sourced:
            named["source"] = ('{"path": "s1", "location": "p. 1"}', '{"path": "s9"}')
        if r.source_path:
            named["source_path"] = ('"s1"', '"s9"')
        named["added_date"] = ('"2026"', '"x"')
        out += [(r.section, f, good, bad, k) for k, (f, (good, bad)) in enumerate(sorted(named.items()))]
    return out


def _entries_sql(join: str) -> str:
    """(path, section, idx, j): two entries of every section for each customer."""
    state = "(c_custkey * 5 + salt * 7 + idx * 3 + length(section)) % 9"
    frag = f"""CASE {state} WHEN 0 THEN '' WHEN 1 THEN '"' || field || '": null, ' WHEN 2 THEN '"' || field || '": "", ' WHEN 3 THEN '"' || field || '": "  ", ' WHEN 4 THEN '"' || field || '": ' || bad || ', ' ELSE '"' || field || '": ' || good || ', ' END"""
    return f"""SELECT 'r/' || CAST(c_custkey AS STRING) AS path, section, idx, '{{' || {join.format('frag', 'field')} || '"id": "e' || CAST(idx * (c_custkey % 3) AS STRING) || '"}}' AS j
FROM (SELECT c_custkey, section, field, idx, {frag} AS frag FROM customer CROSS JOIN (SELECT * FROM (VALUES {_values(_entry_fields())}) AS f(section, field, good, bad, salt)) f CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS i(idx)) i) x
GROUP BY c_custkey, section, idx"""


_DUCK_JOIN = "string_agg({0}, '' ORDER BY {1})"


def _whole_sql() -> str:
    """(path, j): the whole artifacts of the entries that ``_entries_sql`` gives, each made within its customer's row."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    by_section: dict[str, list[str]] = {}
    for section, field, good, bad, salt in sorted(_entry_fields()):
        key = f'"{field}": '
        odd = ["", f"{key}null, ", f'{key}"", ', f'{key}"  ", ', f"{key}{bad}, "]
        by_section.setdefault(section, []).append(f"named_struct('odd', array({', '.join(map(quoted, odd))}), 'good', {quoted(f'{key}{good}, ')}, 'salt', {salt * 7 + len(section)})")
    sections = ", ".join(f"named_struct('section', {quoted(s)}, 'fields', array({', '.join(fs)}))" for s, fs in by_section.items())
    held = "array_join(transform(s.fields, f -> coalesce(get(f.odd, CAST((c_custkey * 5 + f.salt + i * 3) % 9 AS INT)), f.good)), '')"
    entry = f"""concat('{{', {held}, '"id": "e', CAST(i * (c_custkey % 3) AS STRING), '"}}')"""
    lists = f"""transform(array({sections}), s -> concat('"', s.section, '": [', array_join(transform(array(0, 1), i -> {entry}), ', '), ']'))"""
    return f"SELECT 'r/' || CAST(c_custkey AS STRING) AS path, concat('{{', array_join({lists}, ', '), '}}') AS j FROM customer"


def _artifact_entries(spark: SparkSession, sf: str) -> DataFrame:
    """(path, section, idx, entry) read back out of whole artifacts."""
    arts = written(_sql(spark, sf, _whole_sql(), "customer"), "artifacts").select("path", F.parse_json("j").alias("data"), F.lit("person").alias("target_type"))
    return artifacts.all_entries(arts, [r.section for r in rules.ENTRY_RULES])


def _rule_rows() -> list[tuple]:
    out = []
    for r in rules.ENTRY_RULES:
        out += [(r.section, "required", f, None) for f in r.required] + [(r.section, "blank", f, None) for f in r.non_blank]
        out += [(r.section, "lenient", f, "|".join(v)) for f, v in r.enums.items()] + [(r.section, "strict", f, "|".join(v)) for f, v in r.strict_enums.items()] + [(r.section, "warned", f, "|".join(v)) for f, v in r.warned_enums.items()]
        out += [(r.section, "path", f, p) for f, p in r.paths.items()] + [(r.section, "list", f, None) for f in r.lists]
        out += [(r.section, "source", "source", None)] * r.sourced + [(r.section, "named", "source_path", None)] * r.source_path
        out.append((r.section, "required", "added_date", None))
    return out


_RULES_SQL = f"""WITH e AS ({_entries_sql(_DUCK_JOIN)}), r(section, kind, field, arg) AS (VALUES {_values(_rule_rows())}),
x AS (SELECT path, e.section, idx, kind, field, arg, json_exists(j, '$.' || field) AS has, json_extract_string(j, '$.' || field) AS v, json_type(j, '$.' || field) AS t, json_extract(j, '$.' || field) AS raw, j FROM e JOIN r USING (section)),
m AS (
  SELECT path, section, idx, CASE WHEN kind = 'warned' THEN 'warn' ELSE 'error' END AS level, unnest([
    CASE WHEN kind = 'required' AND NOT has THEN 'missing ' || field END,
    CASE WHEN kind = 'blank' AND trim(coalesce(v, '')) = '' THEN 'blank ' || field END,
    CASE WHEN kind IN ('lenient', 'strict', 'warned') AND NOT list_contains(string_split(arg, '|'), v) AND (v <> '' OR kind <> 'lenient') THEN field || ' not in vocabulary: ' || v END,
    CASE WHEN kind = 'path' AND trim(v) <> '' AND NOT starts_with(trim(v), arg) THEN field || ' must start with ' || arg END,
    CASE WHEN kind = 'list' AND has AND ((t <> 'ARRAY' AND v <> '') OR (t = 'ARRAY' AND len(list_filter(raw::JSON[], lambda y: NOT starts_with(y::VARCHAR, '"/'))) > 0)) THEN field || ' must be a list of paths that start with /' END,
    CASE WHEN kind = 'source' AND coalesce(t, '') <> 'OBJECT' THEN 'source must have path and location' END,
    CASE WHEN kind = 'source' AND t = 'OBJECT' AND NOT json_exists(raw, '$.location') THEN 'source must include path and location' END,
    CASE WHEN kind = 'source' AND t = 'OBJECT' AND json_extract_string(raw, '$.path') <> 's1' THEN 'source not in manifest: ' || json_extract_string(raw, '$.path') END,
    CASE WHEN kind = 'named' AND v <> '' AND v <> 's1' THEN 'source not in manifest: ' || v END]) AS message FROM x)
SELECT path, level, 'entries' AS check_name, section || '[' || idx || ']: ' || message AS message FROM m WHERE message IS NOT NULL"""


@query(_RULES_SQL)
def entry_rules(spark, sf):
    """Every entry rule of every section."""
    known = spark.createDataFrame([("s1",)], "source_path string")
    return _found(rules.entry_issues(_artifact_entries(spark, sf), known))


@query(f"""WITH e AS ({_entries_sql(_DUCK_JOIN)}), k AS (SELECT path, section, idx, json_extract_string(j, '$.id') AS id, json_exists(j, '$.added_date') AS dated FROM e)
SELECT path, 'error' AS level, 'lifecycle' AS check_name, section || '[' || idx || ']: missing added_date' AS message FROM k WHERE NOT dated
UNION ALL SELECT path, 'error', 'lifecycle', section || '[' || idx || ']: duplicate id: ' || id FROM k QUALIFY row_number() OVER (PARTITION BY path, section, id ORDER BY idx) > 1""")
def entry_lifecycle(spark, sf):
    """Ids that are met again and missing dates of entry."""
    return _found(artifacts.lifecycle(_artifact_entries(spark, sf)))


# -- nodes
SPEC = {
    "person": {
        "required": ["id", "type", "schema_version", "status"], "status_values": ["active", "in-progress"],
        "archetypes": {"eyewitness": {"required_sections": ["Identity", "Statements"]}, "reporter": {"required_sections": ["Identity"]}},
        "conditionally_required": {"Notes": "status == in-progress", "updated": "flag is set"},
        "section_rules": {"Identity": {"prose_only": True}, "Statements": {"requires_quote_attribution": True, "split": ["Direct", "Flagged"]}},
    },
    "document": {"required": ["id", "type"], "kinds": {"gov-doc": {"required_sections": ["Provenance on {topic_display_name}"]}, "paper": {}}, "required_sections": ["Summary"], "doc_form_values": ["memo", "letter"], "archival_status_values": ["archived", "lost"]},
    "finding": {"required": ["id"], "required_sections": ["Evidence on {topic_display_name}"]},
}

#: (path, node_type, j, body): nodes by remainders of the customer's key.
_NODES = """SELECT * FROM (
SELECT CASE c_custkey % 3 WHEN 0 THEN 'people/c' WHEN 1 THEN 'documents/c' ELSE 'findings/c' END || CAST(c_custkey AS STRING) || '.md' AS path,
CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'zzz' WHEN c_custkey % 3 = 0 THEN 'person' WHEN c_custkey % 3 = 1 THEN 'document' ELSE 'finding' END AS node_type,
CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE '{"type": ' || CASE WHEN c_custkey % 37 = 0 THEN 'null' WHEN c_custkey % 29 = 0 THEN '"zzz"' WHEN c_custkey % 3 = 0 THEN '"person"' WHEN c_custkey % 3 = 1 THEN '"document"' ELSE '"finding"' END
  || CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN ', "id": "x/y"' WHEN c_custkey % 7 = 2 THEN ', "id": ""' ELSE ', "id": "' || CASE c_custkey % 3 WHEN 0 THEN 'people/c' WHEN 1 THEN 'documents/c' ELSE 'findings/c' END || CAST(c_custkey AS STRING) || '"' END
  || CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN ', "schema_version": "2"' WHEN c_custkey % 5 = 2 THEN ', "schema_version": 9' ELSE ', "schema_version": 2' END
  || CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN ', "status": "odd"' WHEN c_custkey % 11 < 5 THEN ', "status": "in-progress"' ELSE ', "status": "active"' END
  || CASE WHEN c_custkey % 13 = 0 THEN ', "archetype": "odd"' WHEN c_custkey % 13 < 4 THEN ', "archetype": "reporter"' ELSE ', "archetype": "eyewitness"' END
  || CASE WHEN c_custkey % 17 = 0 THEN ', "kind": "odd"' WHEN c_custkey % 17 < 6 THEN ', "kind": "paper"' WHEN c_custkey % 17 < 12 THEN ', "kind": "gov-doc"' ELSE '' END
  || CASE WHEN c_custkey % 6 = 0 THEN ', "flag": 1' ELSE ', "flag": false' END || CASE WHEN c_custkey % 4 = 0 THEN ', "updated": "2026"' ELSE '' END
  || CASE WHEN c_custkey % 8 = 0 THEN ', "doc_form": "note"' ELSE ', "doc_form": "memo"' END || CASE WHEN c_custkey % 10 = 0 THEN ', "archival_status": "gone"' ELSE ', "archival_status": "lost"' END || ', "corpus": "' || CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'd' END || '"}' END AS j,
'# ' || c_name || N || CASE WHEN c_custkey % 5 = 0 THEN '## Identity (old)' ELSE '## Identity' END || N || CASE WHEN c_custkey % 4 = 0 THEN '| a | b |' || N || '|---|---|' || N || '| 1 | 2 |' || N ELSE 'Prose.' || N END
  || CASE WHEN c_custkey % 6 = 1 THEN '' ELSE '## Statements' || N || CASE WHEN c_custkey % 9 < 4 THEN '### Direct' || N ELSE '' END || '> one' || N || '> more' || N || N || CASE WHEN c_custkey % 2 = 0 THEN '> two' || N || N ELSE '' END || '| Source | x |' || N END
  || CASE WHEN c_custkey % 4 = 1 THEN '## Notes' || N ELSE '' END || CASE WHEN c_custkey % 5 = 2 THEN '## Summary' || N ELSE '' END || CASE WHEN c_custkey % 7 < 3 THEN '## Evidence on T — more' || N WHEN c_custkey % 7 = 3 THEN '## Provenance on T' || N || '## Extra' || N ELSE '' END
  || '## Life' || N || '| Date | What | Note |' || N || '|---|---|---|' || N || '| ' || CASE WHEN c_custkey % 5 = 3 THEN 'some day' ELSE '200' || CAST(c_custkey % 10 AS STRING) END || ' | ' || repeat('w ', CAST(50 + c_custkey % 10 AS INT)) || '| ' || repeat('n ', 70) || '|' || N
  || '| | | |' || N || '| 200' || CAST(c_custkey % 7 AS STRING) || '-11 | born [`/people/c' || CAST(c_custkey * 3 AS STRING) || '`] | y |' || N || '| 200' || CAST(c_custkey % 3 AS STRING) || '-1-' || CAST(1 + c_custkey % 9 AS STRING) || ' | z | |' || N || 'See [`/findings/c' || CAST(c_custkey % 50 AS STRING) || '`].' || N AS body
FROM (SELECT *, chr(10) AS N FROM customer) c) n"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, _NODES, "customer")
    return written(rows, "nodes").select("path", "node_type", F.try_parse_json("j").alias("fm"), "body")


_N = f"WITH n AS (SELECT *, json_extract_string(j, '$.type') AS t, regexp_replace(path, '\\.md$', '') AS stem FROM ({_NODES.replace('repeat(', 'repeat(')}))"
_ONE = "SELECT path, '{level}' AS level, '{check}' AS check_name, {message} AS message FROM {rows} WHERE {where}"


def _one(check: str, message: str, where: str, rows: str = "n", level: str = "error") -> str:
    return _ONE.format(check=check, message=message, where=where, rows=rows, level=level)


_FRONT = [
    _one("frontmatter_parse", "CASE WHEN j IS NULL THEN 'no frontmatter' WHEN t IS NULL THEN 'no type' ELSE 'unknown type: ' || t END", "j IS NULL OR t IS NULL OR t NOT IN ('person', 'document', 'finding')"),
    *[_one("frontmatter_required", f"'missing field: {f}'", f"node_type IN ({types}) AND NOT coalesce(json_exists(j, '$.{f}'), false)", "ok") for f, types in (("id", "'person', 'document', 'finding'"), ("type", "'person', 'document'"), ("schema_version", "'person'"), ("status", "'person'"))],
    _one("schema_version_compat", "CASE WHEN NOT json_exists(j, '$.schema_version') THEN 'schema_version missing' WHEN json_type(j, '$.schema_version') NOT IN ('UBIGINT', 'BIGINT') THEN 'schema_version must be an integer' ELSE 'schema_version not supported: ' || json_extract_string(j, '$.schema_version') END",
         "NOT json_exists(j, '$.schema_version') OR json_type(j, '$.schema_version') NOT IN ('UBIGINT', 'BIGINT') OR json_extract_string(j, '$.schema_version') NOT IN ('1', '2')", "ok"),
    _one("id_path_match", "'id does not match the path: ' || json_extract_string(j, '$.id')", "coalesce(json_extract_string(j, '$.id'), '') NOT IN ('', stem)", "ok"),
    *[_one("vocabularies", f"'invalid {f}: ' || json_extract_string(j, '$.{f}')", f"node_type = '{t}' AND coalesce(json_extract_string(j, '$.{f}'), '') <> '' AND json_extract_string(j, '$.{f}') NOT IN ({v})", "ok", lv)
      for f, t, v, lv in (("status", "person", "'active', 'in-progress'", "error"), ("archetype", "person", "'eyewitness', 'reporter'", "error"), ("kind", "document", "'gov-doc', 'paper'", "error"), ("doc_form", "document", "'memo', 'letter'", "warn"), ("archival_status", "document", "'archived', 'lost'", "error"))],
]
_OK = ", ok AS (SELECT * FROM n WHERE j IS NOT NULL AND t IN ('person', 'document', 'finding'))"


@query(_N + _OK + " " + " UNION ALL ".join(_FRONT))
def node_frontmatter(spark, sf):
    """The registry of frontmatter checks with its fatal cut."""
    names = {"frontmatter_parse", "frontmatter_required", "schema_version_compat", "id_path_match", "vocabularies"}
    return _found(issues.run_checks({"nodes": _nodes(spark, sf)}, [c for c in nodes.node_checks(SPEC, [1, 2]) if c.name in names]))


_TITLES = "list_transform(regexp_extract_all(body, '(?m)^## ([^\\n]+)', 1), lambda y: trim(y))"
_HAS = "len(list_filter(titles, lambda y: y = '{0}' OR starts_with(y, '{0} (') OR starts_with(y, '{0} —'))) > 0"
_WANTED = [  # where a section is due
    ("Identity", "node_type = 'person' AND json_extract_string(j, '$.archetype') IN ('eyewitness', 'reporter')"), ("Statements", "node_type = 'person' AND json_extract_string(j, '$.archetype') = 'eyewitness'"),
    ("Provenance on T", "node_type = 'document' AND json_extract_string(j, '$.kind') = 'gov-doc'"), ("Summary", "node_type = 'document' AND (json_extract_string(j, '$.kind') = 'paper' OR coalesce(json_extract_string(j, '$.kind'), '') = '')"),
    ("Evidence on T", "node_type = 'finding'"), ("Extra", "node_type IN ('person', 'document', 'finding') AND json_extract_string(j, '$.corpus') = 'c'"),
]
_SECTION_SQL = f""", s AS (SELECT *, {_TITLES} AS titles,
  regexp_extract(body, '(?s)(?:^|\\n)## Identity\\n(.*?)(?:\\n## |$)', 1) AS ident, regexp_extract(body, '(?s)(?:^|\\n)## Statements\\n(.*?)(?:\\n## |$)', 1) AS stat FROM n),
b AS (SELECT *, string_split(stat, chr(10)) AS ls FROM s WHERE node_type = 'person' AND list_contains(titles, 'Statements'))
""" + " UNION ALL ".join([
    _one("conditionally_required", "'missing section Notes (required when status == in-progress)'", "node_type = 'person' AND json_extract_string(j, '$.status') = 'in-progress' AND NOT list_contains(titles, 'Notes')", "s"),
    _one("conditionally_required", "'missing updated (required when flag is set)'", "node_type = 'person' AND json_extract_string(j, '$.flag') = '1' AND NOT json_exists(j, '$.updated')", "s"),
    *[_one("required_sections", f"'missing section: {w}'", f"({due}) AND NOT ({_HAS.format(w)})", "s") for w, due in _WANTED],
    _one("section_rules", "'Identity: prose only, no tables'", "node_type = 'person' AND list_contains(titles, 'Identity') AND contains(ident, '|---|')", "s"),
    _one("section_rules", "'Statements: missing ### Direct'", "NOT contains(stat, '### Direct')", "b"),
    _one("section_rules", "'Statements: block quotes without attribution'", "len(list_filter(range(1, len(ls) + 1), lambda i: starts_with(ls[i], '>') AND (i = 1 OR NOT starts_with(ls[i - 1], '>')))) > len(list_filter(ls, lambda l: starts_with(l, '| Source |')))", "b"),
])


@query(_N + _SECTION_SQL)
def node_sections(spark, sf):
    """Conditionally required fields and sections, required sections with addenda, rules of sections."""
    n = _nodes(spark, sf)
    return _found(nodes.conditionally_required(n, SPEC).unionByName(nodes.required_sections(n, SPEC, {"c": ["Extra"]}, "T")).unionByName(nodes.section_rules(n, SPEC)))


@query(_N + """, l AS (SELECT path, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM n),
life AS (SELECT l.path, x, i, i - (SELECT min(i) FROM l m WHERE m.path = l.path AND m.x = '## Life') AS spot FROM l),
r AS (SELECT path, spot - 3 AS row, list_transform(string_split(trim(x, '|'), '|'), lambda c: trim(c)) AS c FROM (SELECT path, spot, CASE WHEN starts_with(x, '|') THEN x[2:-2] ELSE x END AS x FROM life WHERE spot BETWEEN 3 AND 6 AND starts_with(x, '|'))),
d AS (SELECT path, row, c[1] AS cell, CASE WHEN regexp_matches(c[1], '^[0-9]{4}') THEN [try_cast(regexp_extract(c[1], '^([0-9]{4})', 1) AS INT), coalesce(try_cast(regexp_extract(c[1], '^[0-9]{4}-([0-9]{1,2})', 1) AS INT), 0), coalesce(try_cast(regexp_extract(c[1], '^[0-9]{4}-[0-9]{1,2}-([0-9]{1,2})', 1) AS INT), 0)] END AS d FROM r),
p AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY path ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
w AS (SELECT path, len(list_filter(string_split_regex(regexp_replace(unnest(c[1:2]), '\\[`[^`]+`\\]', '', 'g'), '\\s+'), lambda y: y <> '')) AS n FROM r)
SELECT path, 'warn' AS level, 'chronological_tables' AS check_name, 'Life: unparseable date: ' || cell AS message FROM d WHERE d IS NULL AND cell <> ''
UNION ALL SELECT path, 'error', 'chronological_tables', 'Life: out of order at ' || arg_min(cell, row) FROM p WHERE d < before GROUP BY path
UNION ALL SELECT path, 'warn', 'table_cell_word_budget', 'Life: cell of ' || n || ' words' FROM w WHERE n > 55""")
def node_tables(spark, sf):
    """Chronology and word budget of the cells of tables."""
    n = _nodes(spark, sf)
    return _found(nodes.chronological_tables(n).unionByName(nodes.table_cell_word_budget(n)))


@query(_N + """, e AS (SELECT DISTINCT path, unnest(regexp_extract_all(body, '\\[`(/[^`]+)`\\]', 1)) AS dst FROM n)
SELECT dst, string_agg(path, ',' ORDER BY path) AS referrers, count(*)::BIGINT AS n FROM e WHERE dst NOT IN (SELECT '/' || stem FROM n) GROUP BY dst""")
def node_links(spark, sf):
    """Links of nodes to nodes that do not exist."""
    return nodes.link_resolution(_nodes(spark, sf))


_GROUPS = ("people", "organizations", "events", "documents", "transcripts", "media", "locations", "findings")


@query(_N + f""", a AS (SELECT path, body, list_sort(list_distinct(list_filter(regexp_extract_all(body, '\\[`(/[^`]+)`\\]', 1), lambda y: y <> '/' || stem))) AS ls FROM n)
SELECT path, rtrim(body, ' ' || chr(10)) || chr(10) || chr(10) || '## Associated Nodes' || chr(10) || chr(10) || '<!-- generated from the links of the body -->' || chr(10) || chr(10)
  || concat_ws(chr(10) || chr(10), {", ".join(f"CASE WHEN len(list_filter(ls, lambda y: starts_with(y, '/{g}/'))) > 0 THEN '### {g.capitalize()}' || chr(10) || chr(10) || '- [`' || array_to_string(list_filter(ls, lambda y: starts_with(y, '/{g}/')), '`]' || chr(10) || '- [`') || '`]' END" for g in _GROUPS)}) || chr(10) AS body, true AS changed FROM a""")
def node_associated(spark, sf):
    """The generated section of links."""
    return tools.with_associated(_nodes(spark, sf).select("path", "body"))


# -- the manifest
_MANIFEST = """SELECT 'u' || CAST(c_custkey % 400 AS STRING) AS url, CASE c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'odd' WHEN 2 THEN NULL ELSE 'archived' END AS status,
CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 6 AS INT) END AS archive_status, CASE WHEN c_custkey % 3 = 0 THEN '2025-01-01' WHEN c_custkey % 3 = 1 THEN '' ELSE NULL END AS wayback_date, c_custkey % 5 = 0 AS wayback_skip,
CAST(c_custkey % 3 AS INT) AS n_artifacts, c_custkey AS k FROM customer"""
_MANIFEST_ARTIFACT = """SELECT m.*, i, CASE (k + i) % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'html' ELSE 'pdf' END AS format, 'p' || CAST((k * 2 + i * 3) % 900 AS STRING) AS art, CASE (k + i) % 4 WHEN 0 THEN NULL ELSE 'h' || CAST((k + i) % 5 AS STRING) END AS sha256,
CASE (k + i) % 5 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN 'odd' ELSE 'ocr-scan' END AS extraction FROM ({0}) m CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS x(i)) x WHERE i < n_artifacts"""
_FILES = "SELECT DISTINCT 'p' || CAST(c_custkey % 700 AS STRING) AS path, 'h' || CAST(c_custkey % 700 % 4 AS STRING) AS sha256 FROM customer"


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, _MANIFEST, "customer")
    arts = _sql(spark, sf, _MANIFEST_ARTIFACT.format(_MANIFEST), "customer").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "format", F.col("art").alias("path"), "sha256", F.when(F.col("extraction") != "", F.col("extraction")).alias("extraction_type"), "extraction"))).alias("artifacts"))
    return written(rows.join(arts, "k", "left"), "manifest")


_M = f"WITH m AS ({_MANIFEST}), a AS ({_MANIFEST_ARTIFACT.format(_MANIFEST)}), f AS ({_FILES})"
_LOCAL = "coalesce(status = 'archived' AND n_artifacts > 0, false)"
_REMOTE = "coalesce(wayback_date, '') <> ''"


@query(_M + f""", s AS (SELECT *, {_LOCAL} AS l, {_REMOTE} AS r FROM m), flags AS (
  SELECT url, CASE WHEN archive_status IS NULL THEN 'missing' WHEN archive_status > 3 THEN 'out of range'
    ELSE nullif(concat_ws('; ', CASE WHEN (archive_status % 2 = 1) <> l THEN 'local bit' END, CASE WHEN (archive_status // 2 = 1) <> r THEN 'remote bit' END), '') END AS x FROM s
  UNION ALL SELECT url, 'skipped but has a snapshot' FROM s WHERE wayback_skip AND r AND archive_status BETWEEN 0 AND 3)
SELECT url AS path, 'error' AS level, 'manifest_archive_status' AS check_name, 'archive_status: ' || x AS message FROM flags WHERE x IS NOT NULL
UNION ALL SELECT url, 'error', 'manifest_value_enums', 'invalid status: ' || status FROM m WHERE status NOT IN ('archived', 'pending')
UNION ALL SELECT url, 'error', 'manifest_value_enums', 'invalid format: ' || format FROM a WHERE format NOT IN ('pdf', 'html')
UNION ALL SELECT url, 'error', 'manifest_value_enums', 'invalid extraction_type: ' || extraction FROM a WHERE extraction IN ('null', 'odd')
UNION ALL SELECT url, 'error', 'manifest_artifact_shape', 'url occurs more than once' FROM m GROUP BY url HAVING count(*) > 1
UNION ALL SELECT min(url), 'error', 'manifest_artifact_shape', 'path occurs more than once: ' || art FROM a GROUP BY art HAVING count(*) > 1
UNION ALL SELECT url, 'error', 'manifest_artifact_shape', 'artifacts do not agree with status' FROM m WHERE (n_artifacts > 0) <> coalesce(status = 'archived', false)
UNION ALL SELECT url, 'error', 'manifest_checksums', art || ': ' || CASE WHEN f.path IS NULL THEN 'file missing' WHEN a.sha256 IS NULL THEN 'no sha256' ELSE 'sha256 mismatch' END FROM a LEFT JOIN f ON f.path = art WHERE f.path IS NULL OR a.sha256 IS DISTINCT FROM f.sha256
UNION ALL SELECT url, 'error', 'manifest_extraction_type', 'invalid extraction_type: ' || extraction || ' of ' || art FROM a WHERE extraction IN ('null', 'odd')""")
def manifest_checks(spark, sf):
    """All checks of the manifest; an extraction type may be absent but not null."""
    m = _manifest(spark, sf)
    files_ = _sql(spark, sf, _FILES, "customer")
    entry = lambda x: F.concat(F.lit('{"path": "'), x["path"], F.lit('"'), F.when(x["extraction"] == "", "").when(x["extraction"] == "null", ', "extraction_type": null').otherwise(F.concat(F.lit(', "extraction_type": "'), x["extraction"], F.lit('"'))), F.lit("}"))
    body = m.where("artifacts is not null").select("url", F.parse_json(F.concat(F.lit('{"artifacts": ['), F.array_join(F.transform("artifacts", entry), ", "), F.lit("]}"))).alias("data"))
    parts = [manifest.archive_status(m), manifest.value_enums(m), manifest.artifact_shape(m), manifest.checksums(m, files_), manifest.extraction_types(body)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _found(out)


@query(_M + f" SELECT url, k, ({_LOCAL})::INTEGER + 2 * ({_REMOTE})::INTEGER AS archive_status FROM m")
def manifest_refresh(spark, sf):
    """The flag bits recomputed."""
    return manifest.refreshed(_manifest(spark, sf)).select("url", "k", "archive_status")


# -- artifacts
_K = "CAST(c_custkey AS STRING)"
#: (path, target_type, j): artifacts by remainders of the customer's key.
_ARTIFACTS = f"""SELECT 'r/a' || {_K} || '.yaml' AS path, CASE c_custkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'transcript' WHEN 2 THEN 'finding' WHEN 3 THEN 'investigation' ELSE 'organization' END AS target_type,
CASE WHEN c_custkey % 4 = 0 THEN 'paused' ELSE 'active' END AS target_status,
'{{"id": "r/a' || CAST(c_custkey - c_custkey % 13 % 2 AS STRING) || '", "type": ' || CASE WHEN c_custkey % 17 = 0 THEN 'null' ELSE '"research-artifact"' END || ', "target_node": "people/c' || CAST(c_custkey % 900 AS STRING) || '"'
 || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ', "schema_version": 2' END || ', "status": "' || CASE WHEN c_custkey % 7 = 0 THEN 'odd' ELSE 'open' END || '", "created": 1, "document_intrinsic": {{}}, "context_extrinsic": {{"w": "Context"}}'
 || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', "description": "d"' END
 || ', "primary_sources": [{{"path": "s' || CAST(c_custkey % 40 AS STRING) || '"' || CASE WHEN c_custkey % 5 = 2 THEN '' ELSE ', "format": "txt"' END || ', "sha256_at_extraction": "h' || CAST(c_custkey % 3 AS STRING) || '"}}, {{"path": "s' || CAST(c_custkey % 60 AS STRING) || '", "format": "pdf"}}]'
 || ', "naming_quirks": [{{"canonical": "Quick Fox"}}], "background": "zebra quick brown unicorn k' || {_K} || '", "establishes": ["x"' || CASE WHEN c_custkey % 5 = 2 THEN ', " ", 3' ELSE '' END || ']'
 || CASE WHEN c_custkey % 8 < 3 THEN ', "closure_path": [{{"id": "cp"}}]' ELSE '' END
 || ', "note": {{"deep": ["see /' || CASE WHEN c_custkey % 3 = 0 THEN 'findings' WHEN c_custkey % 3 = 1 THEN 'investigations' ELSE 'people' END || '/f"]}}'
 || ', "quotes": [{{"id": "q1", "text": "the quick ' || CASE WHEN c_custkey % 2 = 0 THEN 'brown' ELSE 'red' END || ' fox", "source": {{"path": "s' || CAST(c_custkey % 40 AS STRING) || '", "location": "p. 1"}}'
   || CASE WHEN c_custkey % 3 = 0 THEN ', "observation_type": "direct"' WHEN c_custkey % 3 = 1 THEN ', "observation_type": "odd"' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ', "context": " "' ELSE ', "context": "c"' END
   || CASE WHEN c_custkey % 6 = 1 THEN ', "speaker_id": "sp9"' WHEN c_custkey % 6 < 4 THEN ', "speaker_id": "sp1"' ELSE '' END || CASE WHEN c_custkey % 7 = 1 THEN ', "attestation_tier": "odd"' WHEN c_custkey % 7 = 2 THEN ', "attestation_tier": "on-record"' ELSE '' END
   || ', "corroborated_by": ["q2", "zz"], "superseded_by": "e' || CAST(c_custkey % 4 AS STRING) || '"}}'
   || ', {{"id": "q2"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ', "text": "a slow - fox &amp; hound"' END || ', "source": ' || CASE WHEN c_custkey % 9 = 0 THEN '"x"' WHEN c_custkey % 9 = 1 THEN '{{"path": "s1"}}' ELSE '{{"path": "s' || CAST(c_custkey % 50 AS STRING) || '", "location": 1}}' END || '}}]'
 || ', "speakers": [{{"id": "sp1", "name": "S", "node_link": "/people/c' || CAST(c_custkey % 20 AS STRING) || '"}}]'
 || ', "entities_referenced": [{{"id": "e1", "wrap_path": "/people/c' || CAST(c_custkey * 3 AS STRING) || '", "name": "Bob", "references": [{{"quote_id": "q1"}}, {{"quote_id": "q' || CAST(c_custkey % 4 AS STRING) || '"}}]}}, {{"id": "e2", "wrap_path": "/people/c' || CAST(c_custkey % 900 AS STRING) || '", "name": "A"}}]'
 || ', "contradictions": [{{"id": "c1", "positions": [{{"evidence_id": "q1"}}' || CASE WHEN c_custkey % 2 = 0 THEN ', {{"evidence_id": "q7"}}' ELSE '' END || ']}}]'
 || ', "hypotheses": [{{"id": "H1"}}], "hypothesis_evaluation": [{{"id": "1", "hypothesis_id": "h' || CAST(c_custkey % 2 AS STRING) || '", "status": "' || repeat('s', CAST(c_custkey % 15 AS INT)) || '", "sources": ' || CASE WHEN c_custkey % 4 = 0 THEN '[]' WHEN c_custkey % 4 = 1 THEN '[{{"entity_path": "/p", "description": "long enough text"}}]' ELSE '[{{"finding_path": "/findings/f", "description": "long enough text"}}]' END || '}}]}}' AS j
FROM customer"""
_PATHS = [(f"s{k}",) for k in range(35)]
_TEXTS = [(f"s{k}", None if k % 7 == 3 else f"The\nthe  quick\nbrown fox number {k}, zebra. A slow fox & hound.") for k in range(45)]
_SHAS = [(f"s{k}", f"h{k % 2}") for k in range(30)]


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return written(_sql(spark, sf, _ARTIFACTS, "customer"), "artifacts").select("path", F.parse_json("j").alias("data"), "target_type", "target_status")


def _duck_values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {_values(rows)})"


_A = f"WITH a AS ({_ARTIFACTS}), paths AS (SELECT * FROM (VALUES {_values(_PATHS)}) v(p)), texts AS (SELECT * FROM (VALUES {_values(_TEXTS)}) v(p, txt)), shas AS (SELECT * FROM (VALUES {_values(_SHAS)}) v(p, h)), nn AS ({_NODES})"
_EACH = "(SELECT path, target_type, '{0}' AS section, unnest(json_extract(j, '$.{0}[*]')) AS e, generate_subscripts(json_extract(j, '$.{0}[*]'), 1) - 1 AS idx FROM a)"
_PLACE = "section || '[' || idx || ']: '"


def _x(key: str, e: str = "e") -> str:
    return f"json_extract_string({e}, '$.{key}')"


def _has(key: str, e: str = "e") -> str:
    return f"json_exists({e}, '$.{key}')"


_SHAPE = [
    *[_one("artifact_top_level", f"'missing key: {k}'", f"NOT {_has(k, 'j')}", "a") for k in artifacts.TOP_LEVEL],
    _one("artifact_top_level", "'id does not match the path'", f"{_x('id', 'j')} || '.yaml' <> path", "a"),
    _one("artifact_top_level", "'type must be research-artifact'", f"{_x('type', 'j')} IS NULL", "a"),
    _one("artifact_top_level", "'invalid status'", f"{_x('status', 'j')} = 'odd'", "a"),
    _one("artifact_top_level", "'target_node does not exist'", f"{_x('target_node', 'j')} || '.md' NOT IN (SELECT path FROM nn)", "a"),
    _one("artifact_top_level", "'missing key: description'", f"target_type = 'person' AND NOT {_has('description', 'j')}", "a"),
    *[_one("primary_sources", f"{_PLACE} || 'missing {k}'", f"NOT {_has(k)}", _EACH.format("primary_sources")) for k in ("path", "format")],
    _one("primary_sources", f"{_PLACE} || 'not in manifest: ' || {_x('path')}", f"{_x('path')} NOT IN (SELECT p FROM paths)", _EACH.format("primary_sources")),
    _one("checksum_at_extraction", f"{_PLACE} || 'source changed since extraction: ' || p", f"{_x('sha256_at_extraction')} <> h", f"{_EACH.format('primary_sources')} x JOIN shas ON p = {_x('path')}", "warn"),
    _one("string_lists", f"{_PLACE} || 'must be a non-empty string'", f"json_type(e) <> 'VARCHAR' OR trim({_x('')}) = ''".replace(_x(""), "json_extract_string(e, '$')"), _EACH.format("establishes")),
    _one("paused_without_path", "'paused without a closure_path'", f"target_type = 'investigation' AND target_status = 'paused' AND NOT {_has('closure_path', 'j')}", "a"),
]


@query(_A + " " + " UNION ALL ".join(_SHAPE))
def artifact_shape(spark, sf):
    """Top level, primary sources, digests at extraction, lists of strings and closure paths."""
    a = _artifacts(spark, sf)
    known = spark.createDataFrame(_PATHS, "source_path string")
    parts = [artifacts.artifact_top_level(a, _nodes(spark, sf), ("open",), ("person",)), artifacts.primary_sources(a, known), artifacts.checksum_at_extraction(a, spark.createDataFrame(_SHAS, "source_path string, sha256 string")), artifacts.string_lists(a, ("establishes",)), artifacts.paused_without_path(a)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _found(out)


_OBJ = "coalesce(json_type(e, '$.source') = 'OBJECT', false)"
_QUOTE_SQL = [
    _one("quotes", f"{_PLACE} || 'missing text'", f"NOT {_has('text')}", "q"), _one("quotes", f"{_PLACE} || 'source must have path and location'", f"NOT {_OBJ}", "q"),
    _one("quotes", f"{_PLACE} || 'source must include path and location'", f"{_OBJ} AND ({_x('source.path')} IS NULL OR {_x('source.location')} IS NULL)", "q"),
    _one("quotes", f"{_PLACE} || 'missing observation_type'", f"{_OBJ} AND target_type = 'person' AND {_x('observation_type')} IS NULL", "q"), _one("quotes", f"{_PLACE} || 'invalid observation_type'", f"{_OBJ} AND target_type = 'person' AND {_x('observation_type')} = 'odd'", "q"),
    _one("quotes", f"{_PLACE} || 'missing context'", f"{_OBJ} AND target_type = 'person' AND trim(coalesce({_x('context')}, '')) = ''", "q"), _one("quotes", f"{_PLACE} || 'missing speaker_id'", f"{_OBJ} AND target_type = 'transcript' AND {_x('speaker_id')} IS NULL", "q"),
    _one("quotes", f"{_PLACE} || 'invalid attestation_tier'", f"{_OBJ} AND {_x('attestation_tier')} = 'odd'", "q"),
    *[_one("quotes", f"{_PLACE} || '{k} is ignored here'", f"{_OBJ} AND target_type <> '{t}' AND {_x(k)} IS NOT NULL AND ('{k}' <> 'attestation_tier' OR {_x(k)} <> 'odd')", "q", "warn") for k, t in (("observation_type", "person"), ("speaker_id", "transcript"), ("attestation_tier", "finding"))],
    _one("quotes", f"{_PLACE} || 'source not in manifest: ' || {_x('source.path')}", f"{_x('source.path')} NOT IN (SELECT p FROM paths)", "q"),
    _one("quotes", f"{_PLACE} || 'unknown speaker: sp9'", f"target_type = 'transcript' AND {_x('speaker_id')} = 'sp9'", "q"),
    _one("verbatim_quotes", f"{_PLACE} || 'not verbatim in ' || p", "txt IS NOT NULL AND NOT contains(flat, said)", "v"), _one("verbatim_quotes", f"{_PLACE} || 'source file missing: ' || sp", "p IS NULL", "v"), _one("verbatim_quotes", f"{_PLACE} || 'source has no text: ' || p", "p IS NOT NULL AND txt IS NULL", "v", "warn"),
]


@query(_A + f", q AS (SELECT * FROM {_EACH.format('quotes')}), v AS (SELECT q.*, {_x('source.path')} AS sp, p, txt, regexp_replace(replace(txt, '-', ''), '\\s+', ' ', 'g') AS flat, regexp_replace(replace(replace(regexp_replace({_x('text')}, '-\\s+', '-', 'g'), '&amp;', '&'), '-', ''), '\\s+', ' ', 'g') AS said FROM q LEFT JOIN texts ON p = {_x('source.path')} WHERE {_x('source.path')} IS NOT NULL AND {_x('text')} IS NOT NULL) " + " UNION ALL ".join(_QUOTE_SQL))
def artifact_quotes(spark, sf):
    """Shape of quotes, what each type's quotes need, speakers, and quotes their sources do not hold."""
    a = _artifacts(spark, sf)
    known = spark.createDataFrame(_PATHS, "source_path string")
    return _found(artifacts.quotes(a, known).unionByName(artifacts.verbatim_quotes(a, spark.createDataFrame(_TEXTS, "source_path string, text string"))))


_IDS = "(SELECT path, {0} AS id FROM {1} UNION SELECT path, {0} FROM {2})".format(_x("id"), _EACH.format("quotes"), _EACH.format("entities_referenced"))
_REFS = f"(SELECT path, section, idx, unnest(list_concat(from_json(e, '{{\"corroborated_by\":[\"VARCHAR\"]}}').corroborated_by, [{_x('superseded_by')}])) AS ref FROM {_EACH.format('quotes')})"
_KEYS = "(SELECT path, section, idx, unnest(json_extract_string(e, '$.{0}[*].{1}')) AS ref FROM {2})"
_SRC = "json_extract(e, '$.sources[0]')"
_REFERENCE_SQL = [
    _one("cross_refs", f"{_PLACE} || 'reference to no entry: ' || ref", f"ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_IDS} i WHERE i.path = r.path AND i.id = r.ref)", f"{_REFS} r", "warn"),
    *[_one(s, f"{_PLACE} || 'reference to no quote: ' || ref", "ref NOT IN ('q1', 'q2')", _KEYS.format(f, k, _EACH.format(s))) for s, f, k in (("entities_referenced", "references", "quote_id"), ("contradictions", "positions", "evidence_id"))],
    _one("contradictions", f"{_PLACE} || 'needs two positions'", "json_array_length(e, '$.positions') < 2", _EACH.format("contradictions")),
    _one("hypothesis_citations", f"{_PLACE} || 'unknown hypothesis: ' || {_x('hypothesis_id')}", f"{_x('hypothesis_id')} <> 'h1'", _EACH.format("hypothesis_evaluation")),
    _one("hypothesis_citations", f"{_PLACE} || 'status should have 10 to 300 characters'", f"length({_x('status')}) < 10", _EACH.format("hypothesis_evaluation"), "warn"),
    _one("hypothesis_citations", f"{_PLACE} || 'needs sources'", "json_array_length(e, '$.sources') = 0", _EACH.format("hypothesis_evaluation")),
    _one("hypothesis_citations", f"{_PLACE} || 'a source must name one target, its anchor and a description'", f"{_x('entity_path', _SRC)} IS NOT NULL AND {_x('anchor', _SRC)} IS NULL", _EACH.format("hypothesis_evaluation")),
    _one("layer_references", "place || ': reference to a higher layer'", "CASE WHEN target_type = 'finding' THEN contains(leaf, '/investigations/') WHEN target_type <> 'investigation' THEN regexp_matches(leaf, '/(findings|investigations)/') ELSE false END", "leaves"),
    _one("finding_sources", f"{_PLACE} || 'source is cited by no entity: ' || {_x('source.path')}", f"target_type = 'finding' AND {_x('source.path')} NOT IN (SELECT {_x('path')} FROM {_EACH.format('primary_sources')} WHERE target_type NOT IN ('finding', 'investigation'))", _EACH.format("quotes")),
    _one("speaker_baselines", f"{_PLACE} || 'no baseline image of ' || {_x('node_link')}[9:]", f"target_type = 'transcript' AND {_x('node_link')} NOT IN ('/people/c1', '/people/c6')", _EACH.format("speakers"), "warn"),
]
_LEAVES = ", leaves AS (SELECT path, target_type, replace(fullkey, '\"', '') AS place, atom->>'$' AS leaf FROM (SELECT a.path AS path, target_type, t.fullkey, t.atom, t.type FROM a, json_tree(a.j) t) WHERE type = 'VARCHAR')"


@query(_A + _LEAVES + " " + " UNION ALL ".join(_REFERENCE_SQL))
def artifact_references(spark, sf):
    """References between entries, hypotheses, layers, sources of findings, baselines of speakers."""
    a = _artifacts(spark, sf)
    parts = [artifacts.reference_checks(a, ["quotes", "entities_referenced"]), artifacts.hypothesis_citations(a), artifacts.layer_references(a), artifacts.finding_sources(a), artifacts.speaker_baselines(a, spark.createDataFrame([("c1",), ("c6",)], "slug string"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _found(out)
