"""Stores, schema files, guarded and gated runs, and re-runs, over documents made from the standard tables.

The two schema files are texts that a user edits. The queries save them as
documents, read them back and evaluate the rows they give; the oracle takes the
same texts apart with DuckDB's functions and states what each kind of rule asks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, written
from ..functions.text import links
from ..operators import artifacts, render, runs, schema, tools
from ..operators.issues import Check, issues
from ..sources import files, store
from .chain import _NODES, _found, _nodes, _sql, _values

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- stores
_ENTRIES = """SELECT 'https://x/' || CAST(c_custkey % 977 * 1000 + c_custkey AS STRING) AS url,
'{"url": "https://x/' || CAST(c_custkey % 977 * 1000 + c_custkey AS STRING) || '", "artifacts": [{"path": "' || CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'é' END || CAST(c_custkey AS STRING) || '"}], "note": "' || CAST(c_nationkey AS STRING) || '"}' AS json FROM customer"""


@query(f"""SELECT row_number() OVER (ORDER BY url, json) - 1 AS position, url, json_extract_string(json, '$.artifacts[0].path') AS artifact, json_extract_string(json, '$.note') AS note FROM ({_ENTRIES})""")
def manifest_round_trip(spark, sf):
    """A manifest saved over an older one in order of its urls, and read back with the places of its entries."""
    folder = _folder(spark, "manifest")
    entries = _sql(spark, sf, _ENTRIES, "customer")
    store.save_manifest(entries.limit(3), folder)
    store.save_manifest(entries, folder)
    got = lambda p: F.try_variant_get("data", p, "string")
    return store.load_manifest(spark, folder).select("position", "url", got("$.artifacts[0].path").alias("artifact"), got("$.note").alias("note"))


_FILES = f"SELECT path, coalesce(j, '') || chr(10) || body AS raw FROM ({_NODES}) f"


@query(f"SELECT path, sha256(raw) AS digest, length(raw)::BIGINT AS n_chars, length(raw) - length(replace(raw, chr(10), '')) AS n_lines FROM ({_FILES})")
def documents_round_trip(spark, sf):
    """Nodes written one file each, committed together, and read back."""
    folder = _folder(spark, "nodes")
    store.save_documents(_sql(spark, sf, _FILES, "customer"), folder)
    rows = store.load_documents(spark, folder)
    return rows.select("path", F.sha2("raw", 256).alias("digest"), F.length("raw").cast("long").alias("n_chars"), (F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


# -- schema files
#: The schema of artifacts: fixed values where they are vocabularies and keys, as in every corpus.
ARTIFACT_SCHEMA = """{
"evidentiary_basis_values": ["primary-source", "sworn-testimony", "on-record", "self-attested", "secondary"],
"confidence_values": ["high", "medium", "low"],
"entry_lifecycle_fields": {"required": ["id", "added_date"]},
"rumor_entry": {"section": "rumors", "required": ["claim", "status"], "status_values": ["not-primary-source-established", "primary-source-disputed"]},
"timeline_entry": {"section": "timeline", "required": ["date", "event", "source"]},
"corroboration_entry": {"section": "corroboration_items", "required": ["observer_path", "observation_type", "source"], "observation_type_values": ["testimonial", "instrumented", "government-statement", "documentary"], "lenient": ["observation_type"]},
"program_involvement_entry": {"section": "program_involvement", "required": ["program", "role", "evidentiary_basis", "confidence", "source"], "lenient": ["evidentiary_basis", "confidence"]},
"vouching_chain_entry": {"required": ["voucher_path", "attestation", "source"], "lenient": ["evidentiary_basis", "confidence"], "paths": {"voucher_path": "/"}},
"participant_entry": {"section": "participants", "required": ["participant_path", "capacity", "source"], "capacity_values": ["witness-eyewitness", "witness-whistleblower", "witness-institutional", "committee-member", "observer", "official", "other"], "lenient": ["capacity"], "paths": {"participant_path": "/"}},
"key_personnel_entry": {"required": ["person_path", "role", "source"], "leadership_class_values": ["director", "deputy", "staff", "advisor", "other"], "paths": {"person_path": "/"}},
"contract_entry": {"section": "contracts", "required": ["source"], "non_blank": ["contract_number", "contracting_agency", "period_start"], "paths": {"primary_counterparty_path": "/"}, "path_lists": ["deliverables"]},
"media_versioning_entry": {"required": ["source"], "non_blank": ["aspect", "parent_form", "this_form"], "aspect_values": ["duration", "encoding", "metadata", "content", "provenance", "other"], "warned": ["aspect"]},
"cited_finding_entry": {"section": "cited_findings", "non_blank": ["finding_path", "relevance"], "paths": {"finding_path": "/findings/"}},
"naming_quirk_entry": {"section": "naming_quirks", "required": ["observed", "canonical", "location", "source_path", "resolution"], "resolution_values": ["preserve-as-sic-in-quotes", "use-canonical", "disputed", "unresolved"], "source_paths": ["source_path"]},
"conditional_keys": {
  "rumors": {"required_when_any_of": [{"target_type": ["person", "event"]}]},
  "corroboration_items": {"required_when_any_of": [{"archetype": ["eyewitness"]}, {"target_type": ["event"], "kind": ["encounter", "hearing"]}]},
  "vouching_chain": {"required_when_any_of": [{"target_type": "person", "archetype": ["whistleblower"]}, {}]},
  "contracts": {"required_when_any_of": [{"target_type": ["organization"], "kind": ["contractor"]}]}
}}"""
MAIN_SCHEMA = """{"types": {
"person": {"path": "people", "frontmatter": {"required": ["id", "type", "schema_version", "status"], "status_values": ["active", "in-progress"]}, "archetypes": {"eyewitness": {"required_sections": ["Identity", "Statements"]}, "reporter": {"required_sections": ["Identity"]}}},
"document": {"path": "documents", "frontmatter": {"required": ["id", "type"], "doc_form_values": ["memo", "letter"], "archival_status_values": ["archived", "lost"]}, "kinds": {"gov-doc": {"required_sections": ["Provenance on {topic_display_name}"]}, "paper": {}}, "required_sections": ["Summary"]},
"finding": {"path": "findings", "frontmatter": {"required": ["id"]}, "required_sections": ["Evidence on {topic_display_name}"]},
"meta": {"frontmatter": {"required": ["id", "created"]}}},
"architecture_layers": {"entity": ["person", "document"], "finding": ["finding"]}}"""


def _schemas(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The main schema and that of artifacts, saved as files and read back."""
    folder = _folder(spark, "schema")
    store.save_documents(spark.createDataFrame([("schema.json", MAIN_SCHEMA), ("schema-research-artifact.json", ARTIFACT_SCHEMA)], "path string, raw string"), folder)
    parsed = written(files.parse_documents(store.load_documents(spark, folder), "json").select("path", F.to_json("body").alias("j")), "schema").select("path", F.parse_json("j").alias("data"))
    return tuple(parsed.where(F.col("path") == p).select("data") for p in ("schema.json", "schema-research-artifact.json"))


def _entry_texts() -> list[tuple]:
    """(section, number, json) of entries that keep and break the rules."""
    good = {
        "rumors": {"claim": "c", "status": "primary-source-disputed"}, "timeline": {"date": "2020", "event": "e", "source": 1}, "corroboration_items": {"observer_path": "/p/a", "observation_type": "documentary", "source": 1},
        "program_involvement": {"program": "p", "role": "r", "evidentiary_basis": "on-record", "confidence": "low", "source": 1}, "vouching_chain": {"voucher_path": "/p/a", "attestation": "a", "confidence": "high", "source": 1},
        "participants": {"participant_path": "/p/a", "capacity": "observer", "source": 1}, "key_personnel": {"person_path": "/p/a", "role": "r", "leadership_class": "staff", "source": 1},
        "contracts": {"contract_number": "7", "contracting_agency": "a", "period_start": "2020", "deliverables": ["/d/a"], "source": 1}, "media_versioning": {"aspect": "content", "parent_form": "p", "this_form": "t", "source": 1},
        "cited_findings": {"finding_path": "/findings/f", "relevance": "r"}, "naming_quirks": {"observed": "o", "canonical": "c", "location": "l", "source_path": "s1", "resolution": "disputed"}, "unknown": {"x": "y"},
    }
    source = [{"path": "s1", "location": "p. 1"}, {"path": "s9", "location": None}, {"path": "", "location": "x"}, {"path": "s1"}, "s1", None, {"location": "x"}]
    out = []
    for name, fields in good.items():
        keys = list(fields)
        for n in range(24):
            row = {"id": f"e{n}", "added_date": "2026"} | fields
            if "source" in row:
                row["source"] = source[n % len(source)] if n else source[0]
            key = keys[n % len(keys)]
            if n and key != "source":
                change = ["", "  ", "odd", "/x", None, ["/a", "b", 3], "s9", []][(n * 5 + len(name)) % 8]
                if not (isinstance(change, list) and key != "deliverables"):
                    row[key] = change
            if n % 5 == 4:
                del row[keys[(n + 1) % len(keys)]]
            if n % 11 == 10:
                row.pop("added_date")
            out.append((name, n, json.dumps(row)))
    return out


_ENTRY_ROWS = f"SELECT 'r/' || CAST(c_custkey AS STRING) AS path, section, CAST(row_number() OVER (PARTITION BY c_custkey, section ORDER BY n) - 1 AS INT) AS idx, j FROM customer CROSS JOIN (SELECT * FROM (VALUES {_values(_entry_texts())}) AS t(section, n, j)) t WHERE (c_custkey * 3 + n + length(section)) % 17 = 0"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'::JSON"


_TEXTS = "coalesce(CAST(json_extract(b, '$.{}') AS VARCHAR[]), [])"
_ENTRY_RULES_SQL = f"""WITH s AS (SELECT {_quoted(ARTIFACT_SCHEMA)} AS d),
b AS (SELECT d, k, json_extract(d, '$."' || k || '"') AS b FROM (SELECT d, unnest(json_keys(d)) AS k FROM s) WHERE ends_with(k, '_entry')),
n AS (SELECT *, coalesce(json_extract_string(b, '$.section'), k[:-7]) AS section, {_TEXTS.format('required')} || ['id', 'added_date'] AS required, {_TEXTS.format('lenient')} AS lenient, {_TEXTS.format('warned')} AS warned FROM b),
v AS (SELECT section, lenient, warned, key[:-8] AS field, CAST(json_extract(b, '$.' || key) AS VARCHAR[]) AS allowed FROM (SELECT *, unnest(json_keys(b)) AS key FROM n) WHERE ends_with(key, '_values')
  UNION ALL SELECT section, lenient, warned, field, CAST(json_extract(d, '$.' || field || '_values') AS VARCHAR[]) FROM (SELECT *, unnest(lenient || warned) AS field FROM n) WHERE NOT json_exists(b, '$.' || field || '_values')),
r AS (SELECT section, CASE WHEN f = 'source' THEN 'source' ELSE 'required' END AS kind, f AS field, []::VARCHAR[] AS allowed FROM (SELECT section, unnest(required) AS f FROM n)
  UNION ALL SELECT section, 'non_blank', unnest({_TEXTS.format('non_blank')}), [] FROM n
  UNION ALL SELECT section, CASE WHEN list_contains(warned, field) THEN 'warned' WHEN list_contains(lenient, field) THEN 'lenient' ELSE 'strict' END, field, allowed FROM v
  UNION ALL SELECT section, 'path', key, [json_extract_string(b, '$.paths.' || key)] FROM (SELECT section, b, unnest(json_keys(json_extract(b, '$.paths'))) AS key FROM n WHERE json_exists(b, '$.paths'))
  UNION ALL SELECT section, 'path_list', unnest({_TEXTS.format('path_lists')}), [] FROM n
  UNION ALL SELECT section, 'source_path', unnest({_TEXTS.format('source_paths')}), [] FROM n)"""


@query(f"""{_ENTRY_RULES_SQL}, e AS ({_ENTRY_ROWS}),
x AS (SELECT path, e.section, idx, kind, field, allowed, json_exists(j, '$.' || field) AS has, json_extract_string(j, '$.' || field) AS v, json_type(j, '$.' || field) AS t, json_extract(j, '$.' || field) AS raw FROM e JOIN r USING (section)),
m AS (SELECT path, section, idx, CASE WHEN kind = 'warned' THEN 'warn' ELSE 'error' END AS level, unnest([
    CASE WHEN kind = 'required' AND NOT has THEN 'missing ' || field END,
    CASE WHEN kind = 'non_blank' AND trim(coalesce(v, '')) = '' THEN 'blank ' || field END,
    CASE WHEN kind IN ('lenient', 'strict', 'warned') AND NOT list_contains(allowed, v) AND (v <> '' OR kind <> 'lenient') THEN field || ' not in vocabulary: ' || v END,
    CASE WHEN kind = 'path' AND trim(v) <> '' AND NOT starts_with(trim(v), allowed[1]) THEN field || ' must start with ' || allowed[1] END,
    CASE WHEN kind = 'path_list' AND has AND ((t <> 'ARRAY' AND v <> '') OR (t = 'ARRAY' AND len(list_filter(raw::JSON[], lambda y: NOT starts_with(y::VARCHAR, '"/'))) > 0)) THEN field || ' must be a list of paths that start with /' END,
    CASE WHEN kind = 'source' AND coalesce(t, '') <> 'OBJECT' THEN 'source must have path and location' END,
    CASE WHEN kind = 'source' AND t = 'OBJECT' AND (NOT json_exists(raw, '$.location') OR coalesce(json_extract_string(raw, '$.path'), '') = '') THEN 'source must include path and location' END,
    CASE WHEN kind = 'source' AND t = 'OBJECT' AND json_extract_string(raw, '$.path') NOT IN ('s1', '') THEN 'source not in manifest: ' || json_extract_string(raw, '$.path') END,
    CASE WHEN kind = 'source_path' AND v NOT IN ('', 's1') THEN 'source not in manifest: ' || v END]) AS message FROM x)
SELECT path, level, 'entries' AS check_name, section || '[' || idx || ']: ' || message AS message FROM m WHERE message IS NOT NULL""")
def schema_entry_rules(spark, sf):
    """The rules of a schema file over the entries of artifacts."""
    rows = _sql(spark, sf, _ENTRY_ROWS, "customer")
    lists = rows.groupBy("path", "section").agg(F.concat(F.lit("["), render.joined(F.col("j"), F.col("idx"), ", "), F.lit("]")).alias("l"))
    whole = lists.groupBy("path").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "section", F.lit('": '), "l")), ", "), F.lit("}")).alias("j"))
    entries = artifacts.all_entries(written(whole, "artifacts").select("path", F.parse_json("j").alias("data")), keep=("path",))
    rules = written(schema.entry_rules(_schemas(spark)[1]), "rules")
    return _found(schema.entry_issues(entries, rules, spark.createDataFrame([("s1",)], "source_path string")))


_RECORDS = """SELECT 'r/' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'event' WHEN 2 THEN 'organization' ELSE 'media' END AS target_type,
CASE WHEN c_custkey % 5 = 0 THEN 'eyewitness' WHEN c_custkey % 5 = 1 THEN 'whistleblower' WHEN c_custkey % 5 = 2 THEN '' END AS archetype, CASE c_custkey % 7 WHEN 0 THEN 'encounter' WHEN 1 THEN 'contractor' WHEN 2 THEN 'hearing' END AS kind, c_custkey AS k FROM customer"""
_HELD = f"SELECT path, section FROM ({_RECORDS}) h CROSS JOIN (SELECT * FROM (VALUES ('rumors', 2), ('corroboration_items', 3), ('vouching_chain', 5), ('contracts', 4), ('timeline', 2)) AS s(section, n)) s WHERE (k + length(section)) % n = 0"


@query(f"""WITH d AS (SELECT json_extract({_quoted(ARTIFACT_SCHEMA)}, '$.conditional_keys') AS d), a AS (SELECT section, unnest(range(len(l))) AS rule, unnest(l) AS r FROM (SELECT section, json_extract(d, '$.' || section || '.required_when_any_of')::JSON[] AS l FROM (SELECT d, unnest(json_keys(d)) AS section FROM d))),
f AS (SELECT section, rule, field, CASE WHEN json_type(r, '$.' || field) = 'ARRAY' THEN CAST(json_extract(r, '$.' || field) AS VARCHAR[]) ELSE [json_extract_string(r, '$.' || field)] END AS allowed FROM (SELECT *, unnest(json_keys(r)) AS field FROM a)),
t AS (SELECT section, string_agg(c, ' or ' ORDER BY rule) AS condition FROM (SELECT section, rule, string_agg(field || ' in (' || array_to_string(list_sort(allowed), ', ') || ')', ' and ' ORDER BY field) AS c FROM f GROUP BY section, rule) GROUP BY section),
p AS (SELECT path, section, bool_or(ok) AS due FROM (SELECT path, section, rule, bool_and(coalesce(list_contains(allowed, CASE field WHEN 'target_type' THEN target_type WHEN 'archetype' THEN archetype ELSE kind END), false)) AS ok FROM ({_RECORDS}) CROSS JOIN f GROUP BY path, section, rule) GROUP BY path, section)
SELECT p.path, 'error' AS level, 'iff_section' AS check_name, CASE WHEN due THEN 'missing' ELSE 'misplaced' END || ' section ' || section || ' (due where ' || condition || ')' AS message
FROM p JOIN t USING (section) LEFT JOIN ({_HELD}) h USING (path, section) WHERE due <> (h.path IS NOT NULL)""")
def schema_placement(spark, sf):
    """Sections that are missing where the schema file asks for them, or stand where it does not, with the condition told."""
    records = _sql(spark, sf, _RECORDS, "customer").select("path", F.map_filter(F.create_map(*[x for c in ("target_type", "archetype", "kind") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull()).alias("fields"))
    rules = written(schema.placements(_schemas(spark)[1]), "placements")
    return _found(schema.placement_issues(records, _sql(spark, sf, _HELD, "customer"), rules))


@query(f"""WITH d AS (SELECT {_quoted(MAIN_SCHEMA.replace('{topic_display_name}', 'T'))} AS d), t AS (SELECT k AS node_type, json_extract(d, '$.types.' || k) AS b FROM (SELECT d, unnest(json_keys(d, '$.types')) AS k FROM d)),
n AS (SELECT path, node_type, json_extract_string(j, '$.type') AS told, j, list_transform(regexp_extract_all(body, '(?m)^## ([^\\n]+)', 1), lambda y: trim(y)) AS titles FROM ({_NODES})),
o AS (SELECT * FROM n JOIN t USING (node_type)),
v AS (SELECT node_type, key[:-8] AS field, CAST(json_extract(b, '$.frontmatter.' || key) AS VARCHAR[]) AS allowed FROM (SELECT *, unnest(json_keys(b, '$.frontmatter')) AS key FROM t) WHERE ends_with(key, '_values')
  UNION ALL SELECT node_type, 'archetype', json_keys(b, '$.archetypes') FROM t WHERE json_exists(b, '$.archetypes') UNION ALL SELECT node_type, 'kind', json_keys(b, '$.kinds') FROM t WHERE json_exists(b, '$.kinds')),
l AS (SELECT *, CASE WHEN json_exists(b, '$.archetypes') AND coalesce(json_extract_string(j, '$.archetype'), '') <> '' THEN 'archetypes.' || json_extract_string(j, '$.archetype') WHEN json_exists(b, '$.kinds') AND coalesce(json_extract_string(j, '$.kind'), '') <> '' THEN 'kinds.' || json_extract_string(j, '$.kind') END AS place FROM o),
w AS (SELECT path, titles, unnest(CAST(CASE WHEN place IS NULL THEN json_extract(b, '$.required_sections') WHEN NOT json_exists(b, '$.' || place) THEN NULL ELSE coalesce(json_extract(b, '$.' || place || '.required_sections'), json_extract(b, '$.required_sections')) END AS VARCHAR[])) AS s FROM l),
m AS (SELECT path, 'unknown type: ' || coalesce(node_type, 'none') AS message FROM n WHERE node_type IS NULL OR node_type NOT IN (SELECT node_type FROM t)
  UNION ALL SELECT path, 'missing field: ' || f FROM (SELECT path, j, unnest(CAST(json_extract(b, '$.frontmatter.required') AS VARCHAR[])) AS f FROM o) WHERE json_extract_string(j, '$.' || f) IS NULL
  UNION ALL SELECT path, 'invalid ' || field || ': ' || json_extract_string(j, '$.' || field) FROM n JOIN v USING (node_type) WHERE json_extract_string(j, '$.' || field) <> '' AND NOT list_contains(allowed, json_extract_string(j, '$.' || field))
  UNION ALL SELECT path, 'missing section: ' || s FROM w WHERE len(list_filter(titles, lambda y: y = s OR starts_with(y, s || ' (') OR starts_with(y, s || ' —'))) = 0)
SELECT path, 'error' AS level, 'node_schema' AS check_name, message FROM m""")
def schema_nodes(spark, sf):
    """Fields, vocabularies and sections of nodes under the main schema file."""
    fields = F.map_filter(F.transform_values(F.coalesce(F.try_variant_get("fm", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: F.try_variant_get(v, "$", "string")), lambda k, v: v.isNotNull())
    rows = _nodes(spark, sf).select("path", F.col("node_type").alias("type"), fields.alias("fields"), "body")
    return _found(schema.node_issues(rows, _schemas(spark)[0], "T"))


@query(f"""WITH d AS (SELECT {_quoted(MAIN_SCHEMA)} AS d), t AS (SELECT d, unnest(json_keys(d, '$.types')) AS type FROM d), p AS (SELECT type, json_extract_string(d, '$.types.' || type || '.path') AS dir,
  (SELECT min(k) FROM (SELECT unnest(json_keys(d, '$.architecture_layers')) AS k) WHERE list_contains(CAST(json_extract(d, '$.architecture_layers.' || k) AS VARCHAR[]), type)) AS layer FROM t)
SELECT type, dir, layer, count(n.path)::BIGINT AS n_nodes FROM p LEFT JOIN ({_NODES}) n ON starts_with(n.path, dir || '/') WHERE dir IS NOT NULL GROUP BY ALL""")
def schema_types(spark, sf):
    """The types of the schema file with their folders, layers and nodes."""
    types = schema.content_types(_schemas(spark)[0])
    held = _nodes(spark, sf).groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return types.join(held, "dir", "left").select("type", "dir", "layer", F.coalesce("n", F.lit(0)).cast("long").alias("n_nodes"))


# -- runs that survive
_GUARDED = """SELECT 'g/' || CAST(c_custkey AS STRING) AS path, CASE WHEN c_custkey % 61 = 0 THEN '{"id": ' WHEN c_custkey % 59 = 0 THEN NULL ELSE '{' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '"id": "x", ' END
|| '"n": ' || CASE c_custkey % 11 WHEN 0 THEN '"x"' WHEN 1 THEN '-3' WHEN 2 THEN '[1]' ELSE '5' END || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ', "parts": [' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1' END || ']' END || '}' END AS json, c_custkey AS k FROM customer"""


def _named(document: dict):
    if document.get("id") is None:
        yield "error", "no id", True


def _positive(document: dict):
    if int(document["n"]) <= 0:
        yield "error", "n is not positive"


def _parted(document: dict):
    if not document["parts"]:
        yield "warn", "no parts"


_CHECKS = [runs.DocumentCheck("named", 0, _named), runs.DocumentCheck("positive", 1, _positive), runs.DocumentCheck("parted", 2, _parted)]


@query(f"""WITH g AS ({_GUARDED}), s AS (SELECT *, json IS NULL AS empty, k % 61 = 0 AS bad, k % 7 = 0 AS nameless, k % 11 IN (0, 2) AS raises FROM g),
m AS (SELECT path, unnest([
  CASE WHEN bad THEN {{'l': 'error', 'c': 'document_parse', 'f': true, 'm': 'check crashed: JSONDecodeError: Expecting value: line 1 column 8 (char 7)'}} END,
  CASE WHEN NOT bad AND empty THEN {{'l': 'error', 'c': 'named', 'f': true, 'm': 'check crashed: AttributeError: ''NoneType'' object has no attribute ''get'''}} END,
  CASE WHEN NOT bad AND NOT empty AND nameless THEN {{'l': 'error', 'c': 'named', 'f': true, 'm': 'no id'}} END,
  CASE WHEN NOT bad AND NOT empty AND NOT nameless AND raises THEN {{'l': 'error', 'c': 'positive', 'f': true, 'm': CASE WHEN k % 11 = 0 THEN 'check crashed: ValueError: invalid literal for int() with base 10: ''x''' ELSE 'check crashed: TypeError: int() argument must be a string, a bytes-like object or a real number, not ''list''' END}} END,
  CASE WHEN NOT bad AND NOT empty AND NOT nameless AND k % 11 = 1 THEN {{'l': 'error', 'c': 'positive', 'f': false, 'm': 'n is not positive'}} END,
  CASE WHEN NOT bad AND NOT empty AND NOT nameless AND NOT raises AND k % 13 = 0 THEN {{'l': 'error', 'c': 'parted', 'f': true, 'm': 'check crashed: KeyError: ''parts'''}} END,
  CASE WHEN NOT bad AND NOT empty AND NOT nameless AND NOT raises AND k % 13 <> 0 AND k % 3 = 0 THEN {{'l': 'warn', 'c': 'parted', 'f': false, 'm': 'no parts'}} END]) AS x FROM s)
SELECT path, x.l AS level, x.c AS check_name, x.m AS message, x.f AS fatal FROM m WHERE x IS NOT NULL""")
def guarded_checks(spark, sf):
    """Checks that raise on some documents: those have one fatal issue, all others their issues."""
    found = runs.document_issues(_sql(spark, sf, _GUARDED, "customer"), _CHECKS)
    return found.select("path", "level", "check_name", "message", "fatal")


_RAISING = "SELECT 'g/' || CAST(c_custkey AS STRING) AS path, CASE WHEN c_custkey % 4999 = 7 THEN 'x' WHEN c_custkey % 10 = 3 THEN '-1' ELSE '4' END AS n, c_nationkey FROM customer"


@query(f"""WITH r AS ({_RAISING}) SELECT path, 'error' AS level, 'number' AS check_name, CASE WHEN n = 'x' THEN 'check crashed: CAST_INVALID_INPUT' ELSE 'n is negative' END AS message, n = 'x' AS fatal FROM r WHERE n IN ('x', '-1')
UNION ALL SELECT path, 'warn', 'nation', 'nation 5', false FROM r WHERE c_nationkey = 5 AND n <> 'x'""")
def surviving_checks(spark, sf):
    """A check over a table that raises on a few of its documents: they are found, and the others keep their issues."""
    docs = written(_sql(spark, sf, _RAISING, "customer"), "raising")
    number = Check("number", 0, lambda t: issues(t["docs"].where(F.col("n").cast("int") < 0), F.col("path"), F.lit("n is negative"), "number"))
    nation = Check("nation", 1, lambda t: issues(t["docs"].where("c_nationkey = 5"), F.col("path"), F.lit("nation 5"), "nation", "warn"))
    return runs.surviving({"docs": docs}, [number, nation]).select("path", "level", "check_name", "message", "fatal")


# -- gated stages
_START, _END = "<!-- body -->", "<!-- end -->"
_DRAFTS = f"""SELECT 'people/d' || CAST(c_custkey AS STRING) || '.md' AS path, CASE WHEN c_custkey % 23 = 0 THEN '{{"title": ' ELSE '{{"title": "' || CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE c_name END || '", "link": "/events/e' || CAST(c_custkey % 40 AS STRING) || '"}}' END AS json,
'# Old' || chr(10) || CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '{_START}' END || 'old' || chr(10) || '{_END}' || chr(10) || 'Tail.' AS body, c_custkey AS k, c_name FROM customer"""


def _preflight(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("data", F.try_parse_json("json"))
    return rows, issues(rows.where("data is null"), F.col("path"), F.lit("not well formed"), "preflight", fatal=True)


def _rendered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = lambda k: F.try_variant_get("data", k, "string")
    rows = rows.select("path", "body", got("$.title").alias("title"), F.concat(F.lit("# "), got("$.title"), F.lit("\n\nSee [`"), got("$.link"), F.lit("`].")).alias("block"))
    return rows.drop("title"), issues(rows.where("trim(title) = ''"), F.col("path"), F.lit("blank title"), "render", fatal=True)


def _spliced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    lost = issues(rows.where(~F.contains("body", F.lit(_START))), F.col("path"), F.lit("no place for the body"), "splice", fatal=True)
    return rows.select("path", render.splice(F.col("body"), _START, _END, F.col("block")).alias("body")), lost


def _linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = tools.with_associated(rows)
    return rows.select("path", "body"), issues(rows.where("changed").where(F.exists(links(F.col("body")), lambda x: x.endswith("7"))), F.col("path"), F.lit("links to an event of 7"), "associate", "warn")


STAGES = [runs.Stage("preflight", _preflight), runs.Stage("render", _rendered), runs.Stage("splice", _spliced), runs.Stage("associate", _linked)]


@query(f"""WITH d AS ({_DRAFTS}), s AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'preflight' WHEN k % 19 = 0 THEN 'render' WHEN k % 17 = 0 THEN 'splice' END AS stopped, '/events/e' || (k % 40) AS link FROM d)
SELECT path, stopped AS stage, true AS fatal, CASE stopped WHEN 'preflight' THEN 'not well formed' WHEN 'render' THEN 'blank title' ELSE 'no place for the body' END AS message FROM s WHERE stopped IS NOT NULL
UNION ALL SELECT path, 'associate', false, 'links to an event of 7' FROM s WHERE stopped IS NULL AND ends_with(link, '7')
UNION ALL SELECT path, 'built', false, '# Old' || chr(10) || '{_START}' || chr(10) || '# ' || c_name || chr(10) || chr(10) || 'See [`' || link || '`].' || chr(10) || '{_END}' || chr(10) || 'Tail.' || chr(10) || chr(10)
  || '## Associated Nodes' || chr(10) || chr(10) || '<!-- generated from the links of the body -->' || chr(10) || chr(10) || '### Events' || chr(10) || chr(10) || '- [`' || link || '`]' || chr(10) FROM s WHERE stopped IS NULL""")
def gated_build(spark, sf):
    """Artifacts parsed, rendered, spliced into their nodes and linked; a fatal issue takes a document out of what follows."""
    built, found = runs.run_stages(_sql(spark, sf, _DRAFTS, "customer").select("path", "json", "body"), STAGES)
    return found.select("path", "stage", "fatal", "message").unionByName(built.select("path", F.lit("built").alias("stage"), F.lit(False).alias("fatal"), F.col("body").alias("message")))


# -- re-runs
_VERSION = """SELECT 'n/' || CAST(c_custkey AS STRING) AS path, CASE WHEN c_custkey % 997 = 4 THEN '{0}' WHEN c_custkey % 9 = 0 THEN 'lost' ELSE 'active' END AS status, 'n/' || CAST(c_custkey * 7 % 1200 AS STRING) AS target FROM customer WHERE c_custkey % 997 <> {1}"""
_BEFORE, _NOW = _VERSION.format("active", 5), _VERSION.format("lost", 6)
_COLUMNS = ["status", "target"]


def _edges(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").alias("src"), F.col("target").alias("dst"))


def _against(every: DataFrame):
    """A check of documents by what their targets are."""

    def check(docs: DataFrame) -> DataFrame:
        there = every.select(F.col("path").alias("target"), F.col("status").alias("state"))
        message = F.when(F.col("state").isNull(), "target is missing").when((F.col("state") == "lost") & (F.col("status") == "active"), "active, but its target is lost")
        return docs.join(there, "target", "left").select("path", message.alias("message")).where("message is not null")

    return check


def rerun_of(spark: SparkSession, sf: str) -> tuple[runs.State, DataFrame, DataFrame]:
    """The state after the re-run, the paths that it checked, and the documents of now."""
    before, now = (written(_sql(spark, sf, v, "customer"), "version") for v in (_BEFORE, _NOW))
    state = runs.first_run(before, _COLUMNS, _edges, _against(before))
    after, touched = runs.rerun(state, now, _COLUMNS, _edges, _against(now))
    return after, touched, now


@query(f"""WITH n AS ({_NOW}) SELECT a.path, CASE WHEN b.path IS NULL THEN 'target is missing' ELSE 'active, but its target is lost' END AS message FROM n a LEFT JOIN n b ON b.path = a.target WHERE b.path IS NULL OR (b.status = 'lost' AND a.status = 'active')""")
def changed_rerun(spark, sf):
    """The issues after a re-run that checks only what a change touches; the oracle checks everything."""
    return rerun_of(spark, sf)[0].issues
