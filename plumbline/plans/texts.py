"""Text, time, source and template operators over texts made from the standard tables, each beside an independent SQL form.

The inputs come from SQL that both engines read alike; the oracle states each operator anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.storage import shared_folder, written
from ..operators import artifacts, nodes, render, templates, timeline, tools
from ..sources import files
from . import sql as S
from .chain import _duck_values, _sql, _values

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# -- times, paths and names
_ORDERS = """SELECT o_orderkey, o_totalprice / 20 AS secs, 'https://web.archive.org/web/' || CASE WHEN o_orderkey % 3 = 0 THEN '2024' ELSE '' END || CAST(20250101 + o_orderkey % 28 AS STRING) || '/http://x' AS url,
'./sources//a/' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MP4' WHEN 2 THEN '.html' WHEN 3 THEN '' WHEN 4 THEN '.jpeg' WHEN 5 THEN '.m4a' ELSE '.md' END AS path,
CASE o_orderkey % 5 WHEN 0 THEN 'Some-Name' WHEN 1 THEN '-x' WHEN 2 THEN 'a b' ELSE 'a' || CAST(o_orderkey AS STRING) || '-b' END AS slug FROM orders"""
_HMS = "(n // 3600)::BIGINT AS h, (n % 3600 // 60)::BIGINT AS m, (n % 60)::BIGINT AS s"


@query(f"""WITH o AS ({_ORDERS}), t AS (SELECT *, floor(secs)::BIGINT AS n, round_even(secs, 0)::BIGINT AS r FROM o),
x AS (SELECT *, printf('%02d', n % 3600 // 60) AS m, printf('%02d', n % 60) AS s, n // 3600 AS h, printf('%02d', r % 3600 // 60) AS rm, printf('%02d', r % 60) AS rs, r // 3600 AS rh FROM t)
SELECT o_orderkey, CASE WHEN h > 0 THEN h || ':' || m || ':' || s ELSE m || ':' || s END AS display, CASE WHEN h > 0 THEN h || '-' || m || '-' || s ELSE m || '-' || s END AS file_name,
printf('%02d', rh) || ':' || rm || ':' || rs AS long_form, CASE WHEN rh > 0 THEN rh || ':' || rm || ':' || rs ELSE (r // 60) || ':' || rs END AS duration, CASE WHEN h > 0 THEN h || ':' || m || ':' || s ELSE (n // 60) || ':' || s END AS mark, n::DOUBLE AS again FROM x""")
def time_forms(spark, sf):
    """The five written forms of a time, and the display form read back."""
    t = _sql(spark, sf, _ORDERS, "orders").select("o_orderkey", F.col("secs").cast("double").alias("secs"))
    return t.select("o_orderkey", X.clock(F.col("secs")).alias("display"), X.file_clock(F.col("secs")).alias("file_name"), X.long_clock(F.col("secs")).alias("long_form"), X.short_clock(F.col("secs"), True).alias("duration"), X.short_clock(F.col("secs")).alias("mark"), X.seconds_of(X.clock(F.col("secs"))).alias("again"))


@query(f"""WITH o AS ({_ORDERS}) SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'video' WHEN 4 THEN 'image' WHEN 5 THEN 'audio' WHEN 6 THEN 'transcript' ELSE 'html' END AS format,
substr(CASE WHEN o_orderkey % 3 = 0 THEN '20242025' ELSE (20250101 + o_orderkey % 28)::VARCHAR END, 1, 4) || '-' || substr(CASE WHEN o_orderkey % 3 = 0 THEN '20242025' ELSE (20250101 + o_orderkey % 28)::VARCHAR END, 5, 2) || '-' || substr(CASE WHEN o_orderkey % 3 = 0 THEN '20242025' ELSE (20250101 + o_orderkey % 28)::VARCHAR END, 7, 2) AS taken,
replace(path, './sources//', '') AS rel, CASE o_orderkey % 5 WHEN 0 THEN 'some-name' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE slug END AS name, CASE o_orderkey % 5 WHEN 0 THEN 'Some Name' WHEN 1 THEN ' X' WHEN 2 THEN 'A b' ELSE 'A' || o_orderkey || ' B' END AS title, '[`/' || slug || '`]' AS wrapped FROM o""")
def path_forms(spark, sf):
    """Formats, snapshot dates, paths below sources, slugs, titles and wrapped paths."""
    o = _sql(spark, sf, _ORDERS, "orders")
    return o.select("o_orderkey", X.format_of(F.col("path")).alias("format"), X.snapshot_date(F.col("url")).alias("taken"), X.source_path(F.col("path")).alias("rel"), X.kebab(F.col("slug")).alias("name"), X.humanize(F.col("slug")).alias("title"), X.wrap_path(F.concat(F.lit("/"), "slug")).alias("wrapped"))


@query("SELECT event_id, (value + event_id % 100) / 2 AS mid, abs(value - event_id % 100) AS length FROM events")
def interval_values(spark, sf):
    """Midpoints and lengths of intervals."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.midpoint(F.col("value"), F.col("event_id") % 100).alias("mid"), F.abs(F.col("value") - F.col("event_id") % 100).alias("length"))


@query("SELECT event_id, greatest(0.0, value - 15.0) AS start FROM events WHERE value + 30.0 < 90.0 + event_id % 40")
def burst_windows(spark, sf):
    """Windows centred on times, those that end after the recording left out."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", (F.lit(90.0) + F.col("event_id") % 40).alias("d"))
    return timeline.bursts(e, "value", 30.0, "d").select("event_id", "start")


# -- marks, pages, paragraphs, sections
#: Source texts with marks and form feeds, and the line a quote of each stands on.
_MARKED = """SELECT c_custkey, 1 + c_custkey % 6 AS line, 'intro' || N || '[0:1' || CAST(c_custkey % 10 AS STRING) || '] one' || N || 'two' || CASE WHEN c_custkey % 3 = 0 THEN chr(12) ELSE '' END || N || '[1:02:03] three [9:59]' || N || 'four' || chr(12) || N || '[0:1' || CAST(c_custkey % 10 AS STRING) || '] six' AS txt,
CASE WHEN c_custkey % 4 = 0 THEN 'no marks at all' || N || 'none' ELSE NULL END AS bare FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"""WITH m AS (SELECT c_custkey, line, coalesce(bare, txt) AS t FROM ({_MARKED})), l AS (SELECT c_custkey, line, t, string_split(t, chr(10)) AS ls FROM m)
SELECT c_custkey, CASE WHEN contains(t, chr(12)) THEN 1 + length(array_to_string(ls[1:line - 1], '')) - length(replace(array_to_string(ls[1:line - 1], ''), chr(12), '')) END::INTEGER AS page,
nullif(list_last(list_filter(list_transform(ls[1:line], lambda x: regexp_extract(x, '\\[[0-9]+:[0-9]+(?::[0-9]+)?\\]')), lambda x: x <> '')), '') AS mark,
CASE WHEN contains(t, '[') THEN array_to_string(list_sort([10 + c_custkey % 10, 599, 3723]), ',') ELSE '' END AS ticks FROM l""")
def source_marks(spark, sf):
    """Page and last mark of a line, and all ticks of a text."""
    m = _sql(spark, sf, _MARKED, "customer").withColumn("t", F.coalesce("bare", "txt"))
    return m.select("c_custkey", X.page_of_line(F.col("t"), F.col("line").cast("int")).cast("int").alias("page"), X.mark_before(F.col("t"), F.col("line").cast("int")).alias("mark"), F.array_join(F.transform(X.ticks(F.col("t")), lambda x: x.cast("int").cast("string")), ",").alias("ticks"))


#: Node texts with sections and paragraphs.
_SECTIONS = """SELECT c_custkey, '# ' || c_name || N || N || N || N || 'Lead.' || N || '## One ' || N || 'a' || CAST(c_custkey AS STRING) || N || ' ' || N || '  b  ' || N || CASE WHEN c_custkey % 2 = 0 THEN '## Two' || N || 'c' || N || N || N || N || 'd' ELSE '### Two' END || N || '## One' || N || 'again' AS body FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"""WITH n AS ({_SECTIONS})
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'One|Two|One' ELSE 'One|One' END AS titles, 'a' || c_custkey || chr(10) || ' ' || chr(10) || '  b  ' || CASE WHEN c_custkey % 2 = 1 THEN chr(10) || '### Two' ELSE '' END AS one,
CASE WHEN c_custkey % 2 = 0 THEN 'c' || chr(10) || chr(10) || chr(10) || chr(10) || 'd' END AS two, len(list_filter(string_split_regex(body, '\\n\\s*\\n+'), lambda p: trim(p, ' ' || chr(10)) <> ''))::INTEGER AS n_paragraphs, regexp_replace(body, '\\n{{3,}}', chr(10) || chr(10), 'g') AS tight FROM n""")
def section_texts(spark, sf):
    """Titles, the first section of a title, paragraphs, and runs of blank lines."""
    n = _sql(spark, sf, _SECTIONS, "customer")
    return n.select("c_custkey", F.array_join(X.h2_titles(F.col("body")), "|").alias("titles"), X.section(F.regexp_replace("body", "## One \n", "## One\n"), "One").alias("one"), X.section(F.col("body"), "Two").alias("two"), F.size(X.paragraphs(F.col("body"))).alias("n_paragraphs"), X.no_blank_runs(F.col("body")).alias("tight"))


#: Quotes with typographic signs and odd white space, and sources in which they start on a known line.
_QUOTED = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'p. 4' ELSE 'lines 7' END AS location, '> “the ' || c_name || N || '> went — away”' AS quote,
repeat('filler' || N, CAST(c_custkey % 5 AS INT)) || 'so "the  ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN N ELSE ' ' END || 'went - away" he said' || N AS source_text FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query("SELECT c_custkey, 'lines ' || (c_custkey % 5 + 1) || '-' || (c_custkey % 5 + 1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) || ' of the extract' AS proposed FROM customer WHERE c_custkey % 3 <> 0")
def quote_positions(spark, sf):
    """Line numbers of quotes for locations that are bare line numbers."""
    return tools.canonical_locations(_sql(spark, sf, _QUOTED, "customer")).select("c_custkey", "proposed")


# -- sources and sinks
_RAW_NODES = """SELECT 'n' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 4 WHEN 0 THEN '---' || N || 'id: x' || CAST(c_custkey AS STRING) || N || '---' || N || '# body' || N || '---' || N || 'more' WHEN 1 THEN 'no header' WHEN 2 THEN '---' || N || 'a: 1' || N || 'b: 2' || N || '---' ELSE '---' || N || 'never closed' END AS raw FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"SELECT path, CASE substr(path, 2)::BIGINT % 4 WHEN 0 THEN 'id: x' || substr(path, 2) WHEN 2 THEN 'a: 1' || chr(10) || 'b: 2' END AS raw_frontmatter, CASE substr(path, 2)::BIGINT % 4 WHEN 0 THEN '# body' || chr(10) || '---' || chr(10) || 'more' WHEN 2 THEN '' END AS body FROM ({_RAW_NODES})")
def node_split(spark, sf):
    """Header and body of nodes."""
    return files.split_nodes(_sql(spark, sf, _RAW_NODES, "customer"))


@query(f"""WITH n AS (SELECT * FROM ({_RAW_NODES})) SELECT path, CASE WHEN substr(path, 2)::BIGINT % 4 IN (0, 2) THEN regexp_replace(raw, '---$', '---' || chr(10)) END AS whole FROM n""")
def node_compose(spark, sf):
    """Header and body put together again."""
    parts = files.split_nodes(_sql(spark, sf, _RAW_NODES, "customer"))
    return parts.select("path", templates.node(F.col("raw_frontmatter"), F.col("body")).alias("whole"))


_RAW_JSON = """SELECT 'd' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 5 WHEN 0 THEN '{"a": 1, "a": 2}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"a": ' WHEN 3 THEN '{"url": "u", "deep": {"b": {"c": 1}}}' ELSE '{"deep": {"b": 1, "b": 2}}' END AS raw, c_custkey AS k FROM customer"""


@query(f"""SELECT path, CASE k % 5 WHEN 1 THEN 'root is no mapping' WHEN 2 THEN 'parse error' ELSE 'parse error: duplicate key: ' || CASE k % 5 WHEN 0 THEN 'a' ELSE 'b' END END AS message FROM ({_RAW_JSON}) WHERE k % 5 <> 3""")
def strict_parse(spark, sf):
    """Documents that can't be read, repeat a key at any depth, or are no mapping."""
    found = artifacts.artifact_parse(files.parse_documents(_sql(spark, sf, _RAW_JSON, "customer"), "json"))
    return found.select("path", F.when(F.contains("message", F.lit("duplicate")) | ~F.startswith("message", F.lit("parse")), F.col("message")).otherwise("parse error").alias("message"))


_CAPTIONS = """SELECT 'c' || CAST(c_custkey AS STRING) AS path, 'head' || N || '[0:05] hello ' || c_name || ' ' || N || N || '[1:00:07.5]  ' || CASE WHEN c_custkey % 2 = 0 THEN 'two' ELSE '' END || N || '[bad] x' AS raw, c_name, c_custkey AS k FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"SELECT path, 1 AS line, 5.0::DOUBLE AS ts, '0:05' AS ts_display, 'hello ' || c_name AS text FROM ({_CAPTIONS}) UNION ALL SELECT path, 3, 3607.5, '1:00:07.5', 'two' FROM ({_CAPTIONS}) WHERE k % 2 = 0")
def caption_lines(spark, sf):
    """Lines of captions with their times."""
    return files.captions(_sql(spark, sf, _CAPTIONS, "customer").select("path", "raw"))


@query("SELECT round(value, 3) AS start_seconds, round(value + event_id % 7, 3) AS end_seconds, round(round(value + event_id % 7, 6) - value, 3) AS duration_seconds, 's' || user_id AS speaker FROM events")
def segments_round_trip(spark, sf):
    """Segments written as CSV to three places and read again."""
    path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet")
    files.write_segments(e.select(F.col("value").alias("start"), (F.col("value") + F.col("event_id") % 7).alias("end"), F.concat(F.lit("s"), F.col("user_id")).alias("speaker")), path)
    return files.read_segments(spark, path)


@query("SELECT trim('a' || event_id || ' b ') AS text, event_id * 10 / 1000 AS start, CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS duration FROM events WHERE event_id % 3 <> 0")
def caption_events(spark, sf):
    """Caption events with their pieces joined."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    piece = F.array(F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("utf8")), F.struct(F.lit(None).cast("string").alias("utf8")), F.struct(F.lit(" b ").alias("utf8")))
    blank = F.array(F.struct(F.lit(" ").alias("utf8")))
    rows = e.select((F.col("event_id") * 10).alias("tStartMs"), F.when(F.col("event_id") % 2 == 0, 1500).alias("dDurationMs"), F.when(F.col("event_id") % 3 == 0, blank).otherwise(piece).alias("segs"))
    return files.caption_events(rows)


# -- raw lines of YAML
_TRAPS = """SELECT 'a' || CAST(c_custkey AS STRING) AS path, 'x: see issue #' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ' of the list' ELSE '' END || N || 'y: ''a #b c d''' || N || 'z: http://x # one two' || N || 'w: He said: ' || CASE WHEN c_custkey % 3 = 0 THEN 'no way out' ELSE 'no' END || N || 'v: at 10: 30 or so' || N || '- k: text mailto: some one' AS raw, c_custkey AS k FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"""WITH t AS ({_TRAPS}) SELECT path, 'line[0]: text after '' #'' is lost; quote the value' AS message FROM t WHERE k % 2 = 0 UNION ALL SELECT path, 'line[3]: inner '': '' needs quotes' FROM t WHERE k % 3 = 0""")
def yaml_line_traps(spark, sf):
    """Unquoted scalars that YAML cuts at a comment sign or reads as a mapping."""
    return artifacts.raw_line_traps(_sql(spark, sf, _TRAPS, "customer").select("path", "raw")).select("path", "message")


# -- templates and marked regions
_TEMPLATE = """SELECT c_custkey, 'id: {{slug}}' || N || '<!-- ARCHETYPE: one -->' || N || 'first {{x}}' || N || '<!-- /ARCHETYPE -->' || N || '<!-- ARCHETYPE: two -->' || N || 'second' || N || '<!-- /ARCHETYPE -->' || N || N || N || N || '<!-- CORPUS-ADDENDUM-INSERT: here -->' || N || '{{slug}} end' AS txt,
CASE WHEN c_custkey % 2 = 0 THEN 'one' ELSE 'two' END AS archetype, CASE WHEN c_custkey % 3 = 0 THEN 'corp' ELSE '' END AS corpus, 's' || CAST(c_custkey AS STRING) AS slug FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"""WITH t AS (SELECT *, chr(10) AS N FROM ({_TEMPLATE})) SELECT c_custkey, 'id: ' || slug || N || CASE WHEN archetype = 'one' THEN 'first {{{{x}}}}' ELSE 'second' END || N || N
|| CASE WHEN corpus = 'corp' THEN '## Rules $1' || N || N || '<!-- Per meta/topic/addenda/corp.md rules. -->' || N || N || '---' || N ELSE '' END || slug || ' end' AS node FROM t""")
def template_fill(spark, sf):
    """Nodes from a template: placeholders, blocks of the archetype, addenda, blank lines."""
    t = _sql(spark, sf, _TEMPLATE, "customer")
    return t.select("c_custkey", templates.filled(F.col("txt"), {"slug": F.col("slug")}, {"ARCHETYPE": F.col("archetype")}, F.col("corpus"), F.array(F.lit("Rules $1"))).alias("node"))


@query("SELECT c_custkey, 'head <!-- s -->' || chr(10) || c_name || chr(10) || '<!-- e --> tail' AS doc FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'head <!-- s -->' || c_name FROM customer WHERE c_custkey % 2 = 1")
def marked_region(spark, sf):
    """The region between two marks replaced, in documents that have both."""
    doc = F.when(F.col("c_custkey") % 2 == 0, F.lit("head <!-- s -->old<!-- e --> tail")).otherwise(F.concat(F.lit("head <!-- s -->"), "c_name"))
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", render.splice(doc, "<!-- s -->", "<!-- e -->", F.col("c_name")).alias("doc"))


_STITCH = "SELECT conv_id, turn, text, CASE turn % 5 WHEN 4 THEN NULL WHEN 0 THEN 'sp1' WHEN 1 THEN 'sp1' ELSE 'sp2' END AS speaker, CASE WHEN turn % 5 < 2 THEN 'ann' ELSE NULL END AS ident FROM (SELECT DISTINCT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id, turn) AS text FROM conversations c WHERE turn IS NOT NULL AND conv_id IS NOT NULL) d"


@query(f"""WITH l AS (SELECT *, CASE WHEN speaker IS NULL THEN 'u' ELSE coalesce(ident, speaker) END AS lab FROM ({_STITCH})), p AS (SELECT *, lag(lab) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM l)
SELECT 'c' || conv_id AS path, string_agg('[' || turn || '] ' || CASE WHEN lab IS NOT DISTINCT FROM last THEN '' WHEN lab = 'u' THEN '_(unanalyzed)_ ' WHEN ident IS NOT NULL THEN '**ann:** ' ELSE '_(' || speaker || ')_ ' END || coalesce(text::VARCHAR, ''), chr(10) ORDER BY turn) || chr(10) AS body FROM p GROUP BY conv_id""")
def stitched_document(spark, sf):
    """Caption lines with the speaker named where it changes."""
    l = _sql(spark, sf, _STITCH, "conversations")
    return timeline.stitched(l.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line"), F.col("turn").cast("string").alias("ts_display"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "speaker", F.col("ident").alias("identity")))


# -- scaffolds
@query("""SELECT 'people/c' || c_custkey AS path, '{"type":"research-artifact","target_node":"people/c' || c_custkey || '","primary_sources":[' || CASE WHEN c_custkey % 2 = 0 THEN '{"path":"s' || c_custkey || '","format":"pdf"}' ELSE '' END || '], "document_intrinsic": {}, "context_extrinsic": {}, "quotes": [], "entities_referenced": [], "naming_quirks": []'
|| CASE WHEN c_custkey % 3 = 0 THEN ', "affiliations": []' ELSE '' END || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN ', "claims": []' ELSE '' END || '}' AS json FROM customer""")
def empty_artifacts(spark, sf):
    """Empty artifacts with the sections that their target's rules ask for."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("people/c"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_custkey") % 3 == 0, "person").otherwise("event").alias("type"), F.when(F.col("c_custkey") % 4 == 0, "witness").alias("archetype"), F.lit(None).cast("string").alias("kind"), "c_custkey")
    rules = {"affiliations": [{"type": ["person"]}], "claims": [{"type": ["person"], "archetype": ["witness"]}]}
    sources = c.where("c_custkey % 2 = 0").select("path", F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_path"), F.lit("pdf").alias("format"))
    return tools.scaffold(c.drop("c_custkey"), rules, sources)


# -- governance files
_GOVERNED = """SELECT CASE c_custkey % 4 WHEN 0 THEN 'meta/templates/' || CASE WHEN c_custkey % 8 = 0 THEN 'person' ELSE 't' || CAST(c_custkey AS STRING) END WHEN 1 THEN 'meta/topic/working-notes/w' || CAST(c_custkey AS STRING) ELSE 'meta/g' || CAST(c_custkey AS STRING) END || '.md' AS path, c_custkey AS k,
CASE WHEN c_custkey % 4 <> 0 THEN 'x' WHEN c_custkey % 20 = 0 THEN 'none' WHEN c_custkey % 20 = 4 THEN '---' || N || 'id: open' ELSE '---' || N || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'id: people/{{slug}} ' || N END || CASE WHEN c_custkey % 5 = 3 THEN '' ELSE 'type: person' || N END || 'schema_version: ' || CASE c_custkey % 7 WHEN 0 THEN '{{v}}' WHEN 1 THEN '9' ELSE '2' END || N || CASE WHEN c_custkey % 11 = 0 THEN 'created:' ELSE 'created: {{today}}' END || N || '---' || N END AS raw,
CASE WHEN c_custkey % 4 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE '{"type": "governance"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ', "id": "meta/g' || CAST(c_custkey - c_custkey % 2 AS STRING) || '"' END || CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ', "schema_version": "2"' WHEN 2 THEN ', "schema_version": 7' ELSE ', "schema_version": 2' END || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ', "created": 1' END || '}' END AS j FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"""WITH g AS (SELECT *, regexp_replace(path, '\\.md$', '') AS own, parse_filename(path, true) AS stem FROM ({_GOVERNED}) WHERE NOT contains(path, 'working-notes')), t AS (SELECT * FROM g WHERE k % 4 = 0), c AS (SELECT * FROM t WHERE k % 20 NOT IN (0, 4)), d AS (SELECT * FROM g WHERE k % 4 <> 0)
SELECT 'meta/topic/overview.md' AS path, 'required file is missing' AS message UNION ALL SELECT path, 'missing or malformed frontmatter' FROM d WHERE j IS NULL
UNION ALL SELECT path, 'missing field: id' FROM d WHERE j IS NOT NULL AND k % 5 = 0 UNION ALL SELECT path, 'missing field: schema_version' FROM d WHERE j IS NOT NULL AND k % 6 = 0 UNION ALL SELECT path, 'missing field: created' FROM d WHERE j IS NOT NULL AND k % 9 = 0
UNION ALL SELECT path, CASE k % 6 WHEN 1 THEN 'schema_version must be an integer' ELSE 'schema_version not supported: 7' END FROM d WHERE j IS NOT NULL AND k % 6 IN (1, 2) UNION ALL SELECT path, 'id does not match the path: meta/g' || (k - 1) FROM d WHERE j IS NOT NULL AND k % 5 <> 0 AND k % 2 = 1
UNION ALL SELECT path, CASE k % 20 WHEN 0 THEN 'template has no frontmatter' ELSE 'frontmatter of the template is not closed' END FROM t WHERE k % 20 IN (0, 4)
UNION ALL SELECT path, 'template has no id' FROM c WHERE k % 3 = 0 UNION ALL SELECT path, 'id of the template is not its pattern: people/{{{{slug}}}}' FROM c WHERE k % 3 <> 0 AND stem <> 'person' UNION ALL SELECT path, 'template has no type' FROM c WHERE k % 5 = 3
UNION ALL SELECT path, 'type of the template is not its name: person' FROM c WHERE k % 5 <> 3 AND stem <> 'person' UNION ALL SELECT path, CASE k % 7 WHEN 0 THEN 'template has no schema_version' ELSE 'schema_version not supported: 9' END FROM c WHERE k % 7 IN (0, 1) UNION ALL SELECT path, 'template has no created' FROM c WHERE k % 11 = 0""")
def governance_files(spark, sf):
    """Headers of governance files and templates."""
    g = written(_sql(spark, sf, _GOVERNED, "customer"), "governed").select("path", "raw", F.try_parse_json("j").alias("fm"))
    return nodes.governance_files(g, [1, 2], {"person": "people"}).select("path", "message")


# -- character references
_REFERENCES = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'caf&eacute; &#8217;tis &#x2014; &amp;eacute;' WHEN 1 THEN 'a &amp; b' WHEN 2 THEN '&lt;p&gt; &ldquo;x&rdquo;' WHEN 3 THEN 'plain' WHEN 4 THEN 'AT&T &frac12; &uuml;ber' ELSE NULL END AS txt FROM customer"""


@query(f"SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'café ’tis — &eacute;' WHEN 1 THEN 'a & b' WHEN 2 THEN '<p> “x”' WHEN 3 THEN 'plain' WHEN 4 THEN 'AT&T ½ über' END AS decoded, CASE c_custkey % 6 WHEN 0 THEN 'café ''tis &eacute;' WHEN 1 THEN 'a & b' WHEN 2 THEN '<p> \"x\"' WHEN 3 THEN 'plain' WHEN 4 THEN 'AT&T ½ über' END AS norm FROM ({_REFERENCES})")
def character_references(spark, sf):
    """Named and numbered references, those beyond the common ones too."""
    r = _sql(spark, sf, _REFERENCES, "customer")
    return r.select("c_custkey", X.decode_entities(F.col("txt")).alias("decoded"), X.normalize_for_compare(F.col("txt")).alias("norm"))


_KEPT = ("witness", "program", "sensor", "testimony", "the")


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents)
SELECT word, count(*)::BIGINT AS n_docs, word IN ({', '.join(S.quoted(w) for w in X.STOPWORDS)}) AS is_stop, word IN {_KEPT} AS is_kept FROM w WHERE is_stop OR is_kept GROUP BY word""")
def stopwords_keep_terms(spark, sf):
    """Stop words and words of the record in the documents; a word that is both would be lost from every comparison."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    lists = spark.createDataFrame([(w, w in X.STOPWORDS, w in _KEPT) for w in {*X.STOPWORDS, *_KEPT}], "word string, is_stop boolean, is_kept boolean")
    return words.join(F.broadcast(lists), "word").groupBy("word", "is_stop", "is_kept").agg(F.count(F.lit(1)).alias("n_docs"))


# -- sources of an artifact
_SOURCE_FILES = """SELECT 's' || CAST(c_custkey AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpg' ELSE '.pdf' END AS path, CASE c_custkey % 5 WHEN 1 THEN '<p>all-' || N || 'domain <b>t</b>ext</p><script>x</script>' WHEN 2 THEN 'plain trans- media ' || CAST(c_custkey AS STRING) ELSE 'bytes' END AS raw,
CASE WHEN c_custkey % 10 = 4 THEN 'ocr-scan' WHEN c_custkey % 10 = 9 THEN 'extraction-lossy' ELSE NULL END AS extraction, CASE WHEN c_custkey % 10 = 4 THEN 'clean sibling' ELSE NULL END AS sibling, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 'out-' || N || 'side tool' END AS extracted, c_custkey AS k FROM (SELECT *, chr(10) AS N FROM customer c) n"""


@query(f"SELECT path, CASE k % 5 WHEN 1 THEN ' all-domain text  ' WHEN 2 THEN 'plain trans-media ' || k WHEN 0 THEN CASE WHEN k % 20 = 0 THEN NULL ELSE 'out-side tool' END WHEN 4 THEN CASE WHEN k % 10 = 4 THEN 'clean sibling' ELSE 'out-side tool' END END AS text FROM ({_SOURCE_FILES})")
def source_texts(spark, sf):
    """The plain text of sources by their format."""
    s = _sql(spark, sf, _SOURCE_FILES, "customer")
    return s.select("path", artifacts.source_text(F.col("path"), F.col("raw"), F.col("extraction"), F.col("sibling"), F.col("extracted")).alias("text"))
