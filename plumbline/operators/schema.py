"""The two schema files as tables of rules, and checks that evaluate the tables.

A schema is a document (VARIANT). ``entry_rules``, ``placements``,
``node_rules`` and ``content_types`` turn it into rows; a check joins its records
with those rows and evaluates what they say, so a rule is added, changed or
taken away by an edit of the file alone. Rules are gathered into one array for a
section or a type before they meet the records, so a record meets one row and
is never multiplied by its rules.

Of the schema of artifacts: ``required_keys``; ``conditional_keys`` (a section and
``required_when_any_of``, rules of which one must match in all its fields);
``entry_lifecycle_fields``; for each kind of entry a block ``<name>_entry`` with

    section            the list section it describes (the block's name without ``_entry`` if absent)
    required           keys that must be there; ``source`` stands for a mapping with path and location
    non_blank          keys that must hold words
    <key>_values       the vocabulary of a key
    lenient, warned    keys whose vocabulary lets an empty value pass, or only warns
    paths              key to the prefix that a value must start with
    path_lists         keys that are lists of paths that start with ``/``
    source_paths       keys that name a source

Of the main schema, ``types``: for each type ``path``, ``frontmatter`` with
``required`` and ``<key>_values``, ``archetypes`` and ``kinds`` with their
``required_sections``, ``required_sections``; and ``architecture_layers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .issues import issues

TEXTS = "array<string>"
ENTRY_RULE = "section string, kind string, field string, allowed array<string>"


def _keys(body: Column) -> Column:
    """A mapping's entries; none where it is no mapping."""
    return F.map_entries(F.coalesce(F.try_variant_get(body, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def _texts(body: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(body, path, TEXTS), F.array().cast(TEXTS))


def _each(values: Column, kind: str) -> Column:
    return F.transform(values, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("field"), F.array().cast(TEXTS).alias("allowed")))


def _pairs(mapping: Column, kind: str) -> Column:
    return F.transform(mapping, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("field"), F.array(F.try_variant_get(e["value"], "$", "string")).alias("allowed")))


def entry_rules(schema: DataFrame) -> DataFrame:
    """(section, kind, field, allowed) of the entries of every section that a schema of artifacts describes. schema: data (VARIANT)."""
    blocks = schema.select("data", F.explode(_keys(F.col("data"))).alias("b")).where(F.col("b.key").endswith("_entry"))
    body = F.col("b.value")
    section = F.coalesce(F.try_variant_get(body, "$.section", "string"), F.regexp_replace("b.key", "_entry$", ""))
    required = F.array_union(_texts(body, "$.required"), _texts(F.col("data"), "$.entry_lifecycle_fields.required"))
    lenient, warned = _texts(body, "$.lenient"), _texts(body, "$.warned")
    named = F.transform(
        F.filter(_keys(body), lambda e: e["key"].endswith("_values")),
        lambda e: F.struct(F.regexp_replace(e["key"], "_values$", "").alias("field"), F.coalesce(F.try_variant_get(e["value"], "$", TEXTS), F.array().cast(TEXTS)).alias("allowed")),
    )
    strength = lambda f: F.when(F.array_contains(warned, f), "warned").when(F.array_contains(lenient, f), "lenient").otherwise("strict")
    # evidentiary_basis and confidence have one vocabulary for all sections; an entry takes it over by naming the key as lenient or warned
    shared = F.transform(
        F.filter(F.array_union(lenient, warned), lambda f: ~F.exists(named, lambda n: n["field"] == f)),
        lambda f: F.struct(f.alias("field"), F.element_at(F.transform(F.filter(_keys(F.col("data")), lambda e: e["key"] == F.concat(f, F.lit("_values"))), lambda e: F.try_variant_get(e["value"], "$", TEXTS)), 1).alias("allowed")),
    )
    vocabulary = F.transform(F.concat(named, shared), lambda n: F.struct(strength(n["field"]).alias("kind"), n["field"].alias("field"), n["allowed"].alias("allowed")))
    mapping = F.array_contains(required, "source")
    rules = F.concat(
        _each(F.filter(required, lambda f: f != "source"), "required"),
        F.when(mapping, _each(F.array(F.lit("source")), "source")).otherwise(_each(F.array().cast(TEXTS), "source")),
        _each(_texts(body, "$.non_blank"), "non_blank"),
        vocabulary,
        _pairs(_keys(F.try_variant_get(body, "$.paths", "variant")), "path"),
        _each(_texts(body, "$.path_lists"), "path_list"),
        _each(_texts(body, "$.source_paths"), "source_path"),
    )
    return blocks.select(section.alias("section"), F.explode(rules).alias("r")).select("section", "r.kind", "r.field", "r.allowed").distinct()


def _entry_problem(rule: Column, value: Column, text: Column) -> Column:
    """What is wrong with an entry's value, told as text too, under a rule; null if nothing is."""
    kind, field, allowed = rule["kind"], rule["field"], rule["allowed"]
    items = F.try_variant_get(value, "$", "array<variant>")
    wrong = F.exists(items, lambda x: ~F.coalesce((F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").startswith("/"), F.lit(False)))
    mapping = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    lacks = F.coalesce(F.try_variant_get(value, "$.path", "string"), F.lit("")).isin("", "0", "false", "[]", "{}", "0.0") | F.try_variant_get(value, "$.location", "variant").isNull()
    outside = kind.isin("strict", "lenient", "warned") & ~F.array_contains(allowed, text) & ((text != "") | (kind != "lenient"))
    return (
        F.when((kind == "required") & value.isNull(), F.concat(F.lit("missing "), field))
        .when((kind == "non_blank") & X.is_blank(text), F.concat(F.lit("blank "), field))
        .when(outside, F.concat(field, F.lit(" not in vocabulary: "), text))
        .when((kind == "path") & (F.trim(text) != "") & ~F.startswith(F.trim(text), F.element_at(allowed, 1)), F.concat(field, F.lit(" must start with "), F.element_at(allowed, 1)))
        .when((kind == "path_list") & (F.coalesce(wrong, F.lit(False)) | (items.isNull() & ~F.coalesce(text.isin("", "0", "false", "{}", "0.0"), F.lit(True)))), F.concat(field, F.lit(" must be a list of paths that start with /")))
        .when((kind == "source") & ~mapping, F.lit("source must have path and location"))
        .when((kind == "source") & lacks, F.lit("source must include path and location"))
    )


def entry_issues(entries: DataFrame, rules: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Issues of list entries under the rules' rows. entries: path, section, idx, entry (VARIANT); known_paths: source_path. Entries that are no mapping are left to others."""
    by_section = rules.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("kind", "field", "allowed"))).alias("rules"))
    rows = entries.where(F.schema_of_variant("entry").startswith("OBJECT")).join(by_section, "section")
    rows = rows.withColumn("_m", F.try_variant_get("entry", "$", "map<string,variant>"))
    value = lambda r: F.try_element_at("_m", r["field"])
    # a rule's value is taken out of the entry once, then judged
    asked = F.transform(F.transform("rules", lambda r: F.struct(r.alias("r"), value(r).alias("v"))), lambda x: F.struct(x["r"].alias("r"), x["v"].alias("v"), F.try_variant_get(x["v"], "$", "string").alias("t")))
    found = F.when(F.col("_m").isNotNull(), F.filter(F.transform(asked, lambda x: F.struct(F.when(x["r"]["kind"] == "warned", "warn").otherwise("error").alias("level"), _entry_problem(x["r"], x["v"], x["t"]).alias("message"))), lambda x: x["message"].isNotNull()))  # named twice, so that the mapping is not made anew for each rule
    place = F.concat(F.col("section"), F.lit("["), F.col("idx").cast("string"), F.lit("]: "))
    names = F.transform(F.filter("rules", lambda r: r["kind"].isin("source", "source_path")), lambda r: F.when(r["kind"] == "source", F.when(F.schema_of_variant(value(r)).startswith("OBJECT"), F.try_variant_get(value(r), "$.path", "string"))).otherwise(F.try_variant_get(value(r), "$", "string")))
    out = rows.select("path", place.alias("place"), F.explode_outer(found).alias("f")).where("f is not null")  # explode alone would evaluate all rules three times
    known = rows.select("path", place.alias("place"), F.explode_outer(F.array_distinct(names)).alias("source_path")).where("source_path <> ''").join(known_paths, "source_path", "left_anti")
    told = issues(out, F.col("path"), F.concat("place", "f.message"), "entries", F.col("f.level"))
    return told.unionByName(issues(known, F.col("path"), F.concat(F.col("place"), F.lit("source not in manifest: "), F.col("source_path")), "entries"))


# -- where sections belong
def placements(schema: DataFrame) -> DataFrame:
    """(section, rule, field, allowed): a section is due where every field of one of its rules holds; rule numbers the alternatives. A rule without fields never matches and gives no row."""
    sections = schema.select(F.explode(_keys(F.try_variant_get("data", "$.conditional_keys", "variant"))).alias("s"))
    rules = sections.select(F.col("s.key").alias("section"), F.posexplode(F.try_variant_get("s.value", "$.required_when_any_of", "array<variant>")).alias("rule", "r"))
    fields = rules.select("section", "rule", F.explode(_keys(F.col("r"))).alias("f"))
    allowed = F.coalesce(F.try_variant_get("f.value", "$", TEXTS), F.array(F.try_variant_get("f.value", "$", "string")))
    return fields.select("section", "rule", F.col("f.key").alias("field"), allowed.alias("allowed"))


def condition_text(rules: DataFrame) -> DataFrame:
    """(section, condition): the rules of a section as they are told in messages, as ``a in (x, y) and b in (z) or ...``."""
    one = F.concat(F.col("field"), F.lit(" in ("), F.array_join(F.array_sort("allowed"), ", "), F.lit(")"))
    each = rules.groupBy("section", "rule").agg(F.array_join(F.array_sort(F.collect_list(one)), " and ").alias("c"))
    return each.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "c"))), lambda x: x["c"]), " or ").alias("condition"))


def placement_issues(records: DataFrame, present: DataFrame, rules: DataFrame) -> DataFrame:
    """A section is present exactly where its rules match. records: path, fields (map of texts); present: path, section.

    One array of all rules meets each record, so nothing is multiplied; the rules are as many as the schema has.
    """
    grouped = rules.groupBy("section", "rule").agg(F.collect_list(F.struct("field", "allowed")).alias("all")).groupBy("section").agg(F.collect_list("all").alias("any"))
    table = grouped.join(condition_text(rules), "section").agg(F.array_sort(F.collect_list(F.struct("section", "condition", "any"))).alias("rules"))
    holds = lambda f: F.coalesce(F.array_contains(f["allowed"], F.try_element_at("fields", f["field"])), F.lit(False))
    due = F.filter("rules", lambda r: F.exists(r["any"], lambda a: F.forall(a, holds)))
    held = present.groupBy("path").agg(F.collect_set("section").alias("held"))
    rows = records.join(held, "path", "left").crossJoin(table)  # a table of one row
    held_ = F.coalesce("held", F.array().cast(TEXTS))
    names = F.transform("due", lambda r: r["section"])
    missing = F.transform(F.filter("due", lambda r: ~F.array_contains(held_, r["section"])), lambda r: F.concat(F.lit("missing section "), r["section"], F.lit(" (due where "), r["condition"], F.lit(")")))
    misplaced = F.transform(F.filter("rules", lambda r: F.array_contains(held_, r["section"]) & ~F.array_contains(names, r["section"])), lambda r: F.concat(F.lit("misplaced section "), r["section"], F.lit(" (due where "), r["condition"], F.lit(")")))
    rows = rows.withColumn("due", due).select("path", F.explode(F.concat(missing, misplaced)).alias("_m"))
    return issues(rows, F.col("path"), F.col("_m"), "iff_section")


# -- types of nodes
def content_types(schema: DataFrame) -> DataFrame:
    """(type, dir, layer) of the types that have a path, in the order of the file's keys."""
    types = schema.select("data", F.explode(_keys(F.try_variant_get("data", "$.types", "variant"))).alias("t"))
    layers = F.filter(_keys(F.try_variant_get("data", "$.architecture_layers", "variant")), lambda e: F.array_contains(F.coalesce(F.try_variant_get(e["value"], "$", TEXTS), F.array().cast(TEXTS)), F.col("t.key")))
    rows = types.select(F.col("t.key").alias("type"), F.try_variant_get("t.value", "$.path", "string").alias("dir"), F.try_element_at(F.transform(layers, lambda e: e["key"]), F.lit(1)).alias("layer"))
    return rows.where("dir is not null")


def section_needs(schema: DataFrame, topic: str = "") -> DataFrame:
    """(type, field, value, section): the sections that a type asks for of a value of archetype or kind; both null for the type's own, and section null for a value that asks for none."""
    types = schema.select(F.explode(_keys(F.try_variant_get("data", "$.types", "variant"))).alias("t"))
    body = F.col("t.value")
    own = _texts(body, "$.required_sections")
    plain = types.select(F.col("t.key").alias("type"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.explode(own).alias("section"))
    out = plain
    for level in ("archetypes", "kinds"):
        values = types.select(F.col("t.key").alias("type"), own.alias("own"), F.explode(_keys(F.try_variant_get(body, f"$.{level}", "variant"))).alias("v"))
        needs = F.coalesce(F.try_variant_get("v.value", "$.required_sections", TEXTS), F.col("own"))
        out = out.unionByName(values.select("type", F.lit(level[:-1]).alias("field"), F.col("v.key").alias("value"), F.explode_outer(needs).alias("section")))
    return out.withColumn("section", F.replace("section", F.lit("{topic_display_name}"), F.lit(topic)))


def node_rules(schema: DataFrame) -> DataFrame:
    """(type, kind, field, allowed): required fields and vocabularies of the frontmatter."""
    types = schema.select(F.explode(_keys(F.try_variant_get("data", "$.types", "variant"))).alias("t"))
    front = F.try_variant_get("t.value", "$.frontmatter", "variant")
    named = F.transform(F.filter(_keys(front), lambda e: e["key"].endswith("_values")), lambda e: F.struct(F.lit("values").alias("kind"), F.regexp_replace(e["key"], "_values$", "").alias("field"), F.coalesce(F.try_variant_get(e["value"], "$", TEXTS), F.array().cast(TEXTS)).alias("allowed")))
    levels = [F.filter(F.array(F.struct(F.lit("values").alias("kind"), F.lit(lv[:-1]).alias("field"), F.transform(_keys(F.try_variant_get("t.value", f"$.{lv}", "variant")), lambda e: e["key"]).alias("allowed"))), lambda r: F.size(r["allowed"]) > 0) for lv in ("archetypes", "kinds")]
    rules = F.concat(_each(_texts(front, "$.required"), "required"), named, *levels)
    return types.select(F.col("t.key").alias("type"), F.explode(rules).alias("r")).select("type", "r.kind", "r.field", "r.allowed")


def node_issues(nodes: DataFrame, schema: DataFrame, topic: str = "") -> DataFrame:
    """Unknown types, missing fields, values outside their vocabulary, missing sections. nodes: path, type, fields (map of texts, of the keys that are set), body.

    The sections are those of the archetype, else of the kind, else of the type; a value that the schema does not know asks for none.
    """
    rules = node_rules(schema).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("kind", "field", "allowed"))).alias("rules"))
    needs = section_needs(schema, topic).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("field", "value", "section"))).alias("needs"))
    known = schema.select(F.explode(F.transform(_keys(F.try_variant_get("data", "$.types", "variant")), lambda e: e["key"])).alias("type")).withColumn("known", F.lit(True))
    rows = nodes.join(known, "type", "left").join(rules, "type", "left").join(needs, "type", "left")
    value = lambda f: F.try_element_at("fields", f)
    wrong = F.transform("rules", lambda r: F.when((r["kind"] == "required") & value(r["field"]).isNull(), F.concat(F.lit("missing field: "), r["field"])).when((r["kind"] == "values") & (value(r["field"]) != "") & ~F.array_contains(r["allowed"], value(r["field"])), F.concat(F.lit("invalid "), r["field"], F.lit(": "), value(r["field"]))))
    of = lambda f: F.coalesce(value(F.lit(f)), F.lit(""))
    has = lambda f: F.exists("needs", lambda n: n["field"] == f)
    level = F.when(has("archetype") & (of("archetype") != ""), "archetype").when(has("kind") & (of("kind") != ""), "kind")
    wanted = F.transform(F.filter("needs", lambda n: n["field"].eqNullSafe(level) & n["section"].isNotNull() & (level.isNull() | (n["value"] == F.when(level == "archetype", of("archetype")).otherwise(of("kind"))))), lambda n: n["section"])
    titles = X.h2_titles(F.col("body"))
    gone = F.filter(wanted, lambda s: ~F.exists(titles, lambda t: (t == s) | t.startswith(F.concat(s, F.lit(" ("))) | t.startswith(F.concat(s, F.lit(" —")))))
    none = F.array().cast(TEXTS)
    messages = F.when(F.col("known").isNull(), F.array(F.concat(F.lit("unknown type: "), F.coalesce("type", F.lit("none"))))).otherwise(F.concat(F.array_compact(F.coalesce(wrong, none)), F.coalesce(F.transform(gone, lambda s: F.concat(F.lit("missing section: "), s)), none)))
    return issues(rows.select("path", F.explode(messages).alias("_m")), F.col("path"), F.col("_m"), "node_schema")
