"""Declarative rules over records: presence, vocabularies, conditions, placement, and the entry-rule engine.

Rules are rows. They are turned into expressions or small local tables, so a
new rule touches no code and a check stays one pass over its records.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .issues import issues


# -- presence: a record body is a VARIANT, which tells an absent key from a null
def absent(body: Column, key: str) -> Column:
    """The key is not there at all; an explicit null is there (a variant null is not SQL's null)."""
    return F.try_variant_get(body, f"$.{key}", "variant").isNull()


def is_none(body: Column, key: str) -> Column:
    """Absent or null."""
    return F.try_variant_get(body, f"$.{key}", "string").isNull()


def falsy(body: Column, key: str) -> Column:
    """Absent, null, empty, nought or false."""
    return F.coalesce(F.try_variant_get(body, f"$.{key}", "string").isin("", "0", "false", "[]", "{}", "0.0"), F.lit(True))


def blank(body: Column, key: str) -> Column:
    return is_blank(F.try_variant_get(body, f"$.{key}", "string"))


# -- vocabularies, required fields, conditions
def enum_violations(rows: DataFrame, key: Column, vocabularies: dict[str, list[str]], skip_empty: bool = True) -> DataFrame:
    """(key, field, value) of values outside their vocabulary. Empty ones pass unless skip_empty is false; nulls pass."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (F.col(f).isNotNull() & ~F.col(f).cast("string").isin(*v) & (F.lit(not skip_empty) | (F.col(f).cast("string") != ""))).alias("bad")) for f, v in vocabularies.items()]
    return rows.select(key.alias("key"), F.explode(F.filter(F.array(*pairs), lambda p: p["bad"])).alias("p")).select("key", "p.field", "p.value")


def missing_fields(rows: DataFrame, key: Column, required: list[str]) -> DataFrame:
    """(key, field) of required fields that are null or blank."""
    names = F.array_compact(F.array(*[F.when(is_blank(F.col(f).cast("string")), F.lit(f)) for f in required]))
    return rows.select(key.alias("key"), F.explode(names).alias("field"))


def rule_matches(rules: list[dict[str, list[str]]]) -> Column:
    """OR over rules of AND over fields; a field left out is a wildcard, and a rule without fields never matches."""
    each = [reduce(Column.__and__, [F.coalesce(F.col(f).isin(*v), F.lit(False)) for f, v in r.items()]) for r in rules if r]
    return reduce(Column.__or__, each, F.lit(False))


def conditional_required(rows: DataFrame, key: Column, conditions: list[tuple[list[dict[str, list[str]]], Column, str]]) -> DataFrame:
    """(key, rule) where a rule matches and what it requires does not hold. conditions: (rules, what must hold, name)."""
    names = F.array_compact(F.array(*[F.when(rule_matches(r) & ~F.coalesce(holds, F.lit(False)), F.lit(n)) for r, holds, n in conditions]))
    return rows.select(key.alias("key"), F.explode(names).alias("rule"))


def placement(records: DataFrame, present: DataFrame, key: str, rules: dict[str, list[dict[str, list[str]]]]) -> DataFrame:
    """(key, section, problem): a section is present exactly where its rules match. present: (key, section)."""
    wanted = records.select(key, F.explode(F.array_compact(F.array(*[F.when(rule_matches(r), F.lit(s)) for s, r in rules.items()]))).alias("section")).withColumn("due", F.lit(True))
    have = present.select(key, "section").where(F.col("section").isin(*rules)).distinct().withColumn("has", F.lit(True))
    return wanted.join(have, [key, "section"], "full_outer").where("due is null or has is null").select(key, "section", F.when(F.col("due").isNull(), "misplaced").otherwise("missing").alias("problem"))


# -- entries of list sections
@dataclass(frozen=True)
class EntryRule:
    """What each entry of a section must satisfy, besides a unique id and the lifecycle fields.

    enums let an empty value pass, strict_enums flag it, warned_enums only warn; paths give
    the prefix of fields that must have one where they are set; lists are lists of such paths.
    """

    section: str
    required: tuple[str, ...] = ()
    non_blank: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    strict_enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    warned_enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    lists: tuple[str, ...] = ()
    sourced: bool = True
    source_path: bool = False


#: The vocabularies of entries, by section and field; a schema file may give others.
VOCABULARIES = {
    "evidentiary_basis": ("primary-source", "sworn-testimony", "on-record", "self-attested", "secondary"),
    "confidence": ("high", "medium", "low"),
    "rumors.status": ("not-primary-source-established", "primary-source-disputed"),
    "corroboration_items.observation_type": ("testimonial", "instrumented", "government-statement", "documentary"),
    "participants.capacity": ("witness-eyewitness", "witness-whistleblower", "witness-institutional", "committee-member", "observer", "official", "other"),
    "witnesses_testimony.oath_status": ("sworn", "unsworn", "affirmation", "unknown"),
    "media_versioning.aspect": ("duration", "encoding", "metadata", "content", "provenance", "other"),
    "key_personnel.leadership_class": ("director", "deputy", "staff", "advisor", "other"),
    "org_relationships.relationship_type": ("parent", "subsidiary", "predecessor", "successor", "contractor", "contracting-agency", "partner", "other"),
    "naming_quirks.resolution": ("preserve-as-sic-in-quotes", "use-canonical", "disputed", "unresolved"),
    "entities_referenced.entity_type": ("person", "organization", "document", "event", "transcript", "media", "location", "finding", "investigation"),
}
#: The sections whose entries a schema file describes under another name.
_SCHEMA_NAMES = {"rumors.status": "rumor_entry", "corroboration_items.observation_type": "corroboration_item", "participants.capacity": "participant_entry", "witnesses_testimony.oath_status": "witness_testimony_entry", "entities_referenced.entity_type": "entity_reference", "naming_quirks.resolution": "naming_quirk_entry", "org_relationships.relationship_type": "org_relationship_entry"}


def vocabularies_of(schema: dict) -> dict[str, tuple[str, ...]]:
    """The vocabularies with those that a schema of research artifacts gives in their place."""
    out = dict(VOCABULARIES)
    for name in out:
        section, _, key = name.rpartition(".")
        block = schema if not section else next((schema[n] for n in (_SCHEMA_NAMES.get(name, ""), f"{section}_entry", section) if isinstance(schema.get(n), dict)), {})
        if values := block.get(f"{key}_values"):
            out[name] = tuple(map(str, values))
    return out


def entry_rules(vocabulary: dict[str, tuple[str, ...]] = VOCABULARIES) -> list[EntryRule]:
    """The entry rules of the known sections."""
    v = lambda section, key: {key: vocabulary[f"{section}.{key}"]}
    basis = {k: vocabulary[k] for k in ("evidentiary_basis", "confidence")}
    slash = lambda *keys: dict.fromkeys(keys, "/")
    return [
        EntryRule("rumors", ("claim", "status"), strict_enums=v("rumors", "status"), sourced=False),
        EntryRule("timeline", ("date", "event", "source")),
        EntryRule("corroboration_items", ("observer_path", "observation_type", "source"), enums=v("corroboration_items", "observation_type")),
        EntryRule("program_involvement", ("program", "role", "evidentiary_basis", "confidence"), enums=basis),
        EntryRule("publication_record", ("publication", "outlet", "date", "source")),
        EntryRule("vouching_chain", ("voucher_path", "attestation"), enums=basis, paths=slash("voucher_path")),
        EntryRule("affiliations", ("organization_path", "role"), paths=slash("organization_path")),
        EntryRule("relationships", ("person_path", "relationship"), paths=slash("person_path")),
        EntryRule("participants", ("participant_path", "capacity"), enums=v("participants", "capacity"), paths=slash("participant_path")),
        EntryRule("witnesses_testimony", ("witness_path", "oath_status"), enums=v("witnesses_testimony", "oath_status"), paths=slash("witness_path")),
        EntryRule("speakers", non_blank=("name",), paths=slash("node_link")),
        EntryRule("media_versioning", non_blank=("aspect", "parent_form", "this_form"), warned_enums=v("media_versioning", "aspect")),
        EntryRule("key_personnel", ("person_path", "role"), strict_enums=v("key_personnel", "leadership_class"), paths=slash("person_path")),
        EntryRule("org_relationships", ("organization_path", "relationship_type"), strict_enums=v("org_relationships", "relationship_type"), paths=slash("organization_path")),
        EntryRule("contracts", non_blank=("contract_number", "contracting_agency", "period_start"), paths=slash("primary_counterparty_path"), lists=("deliverables",)),
        EntryRule("ownership_timeline", non_blank=("period_start", "owner", "use_status")),
        EntryRule("top_scope_activity", non_blank=("period_start", "activity"), lists=("actor_paths",)),
        EntryRule("location_relationships", ("entity_path", "relationship"), paths=slash("entity_path")),
        EntryRule("hypotheses", non_blank=("statement",), sourced=False),
        EntryRule("cited_findings", non_blank=("finding_path", "relevance"), paths={"finding_path": "/findings/"}, sourced=False),
        EntryRule("open_questions", ("question",), sourced=False),
        EntryRule("closure_path", ("blocking_event",), sourced=False),
        EntryRule("resolution_history", ("date", "event"), sourced=False),
        EntryRule("naming_quirks", ("observed", "canonical", "location", "source_path", "resolution"), strict_enums=v("naming_quirks", "resolution"), sourced=False, source_path=True),
        EntryRule("entities_referenced", ("entity_type", "name", "wrap_path"), enums=v("entities_referenced", "entity_type"), paths=slash("wrap_path"), sourced=False),
    ]


ENTRY_RULES = entry_rules()


def entry_issues(entries: DataFrame, known_paths: DataFrame, rules: list[EntryRule] = ENTRY_RULES) -> DataFrame:
    """Issues of list entries. entries: path, section, idx, entry (VARIANT); known_paths: source_path.

    The rules of a section are one expression, taken for its entries alone, so all sections
    take one pass; only source paths are joined. Entries that are no mapping are left to others.
    """
    e = F.col("entry")
    of = lambda k: F.try_variant_get(e, f"$.{k}", "string")
    rows = entries.where(F.schema_of_variant("entry").startswith("OBJECT"))
    source = F.try_variant_get(e, "$.source", "variant")
    mapping = F.coalesce(F.schema_of_variant(source).startswith("OBJECT"), F.lit(False))
    undated = F.when(absent(e, "added_date"), F.lit("missing added_date"))
    told = lambda level, found: [F.when(x.isNotNull(), F.struct(F.lit(level).alias("level"), x.alias("problem"))) for x in found]
    kept: dict[str, tuple[list[Column], list[Column]]] = {}
    for r in rules:
        problems, warnings = kept.setdefault(r.section, ([undated], []))
        vocabulary = lambda k, v: F.concat(F.lit(f"{k} not in vocabulary: "), of(k))
        problems += [F.when(absent(e, k), F.lit(f"missing {k}")) for k in r.required]
        problems += [F.when(is_blank(of(k)), F.lit(f"blank {k}")) for k in r.non_blank]
        problems += [F.when((of(k) != "") & ~of(k).isin(*v), vocabulary(k, v)) for k, v in r.enums.items()]
        problems += [F.when(~of(k).isin(*v), vocabulary(k, v)) for k, v in r.strict_enums.items()]
        warnings += [F.when(~of(k).isin(*v), vocabulary(k, v)) for k, v in r.warned_enums.items()]
        problems += [F.when((F.trim(of(k)) != "") & ~F.trim(of(k)).startswith(prefix), F.lit(f"{k} must start with {prefix}")) for k, prefix in r.paths.items()]
        for k in r.lists:
            items = F.try_variant_get(e, f"$.{k}", "array<variant>")
            wrong = F.exists(items, lambda x: ~F.coalesce((F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").startswith("/"), F.lit(False)))
            problems.append(F.when(((items.isNull() & ~falsy(e, k)) | F.coalesce(wrong, F.lit(False))), F.lit(f"{k} must be a list of paths that start with /")))
        if r.sourced:
            problems.append(F.when(~mapping, F.lit("source must have path and location")))
            problems.append(F.when(mapping & (falsy(e, "source.path") | absent(e, "source.location")), F.lit("source must include path and location")))
    each = F.when(~F.col("section").isin(*kept), F.array_compact(F.array(*told("error", [undated]))))
    for name, (problems, warnings) in kept.items():
        each = each.when(F.col("section") == name, F.array_compact(F.array(*told("error", problems), *told("warn", warnings))))
    place = F.concat(F.col("section"), F.lit("["), F.col("idx").cast("string"), F.lit("]: "))
    found = rows.select("path", "section", "idx", F.explode_outer(each).alias("f")).where("f is not null")  # explode alone would evaluate all rules three times
    out = issues(found, F.col("path"), F.concat(place, F.col("f.problem")), "entries", F.col("f.level"))
    named = F.when(F.col("section").isin(*[r.section for r in rules if r.sourced]) & mapping, of("source.path")).when(F.col("section").isin(*[r.section for r in rules if r.source_path]), of("source_path"))
    unknown = rows.select("path", "section", "idx", named.alias("source_path")).where("source_path <> ''").join(known_paths, "source_path", "left_anti")
    return out.unionByName(issues(unknown, F.col("path"), F.concat(place, F.lit("source not in manifest: "), F.col("source_path")), "entries"))


def empty_while_derived(artifacts: DataFrame) -> DataFrame:
    """A warning where the target is derived from another medium and nothing says how they differ. artifacts: path, data, derivation_of."""
    size = F.size(F.coalesce(F.try_variant_get("data", "$.media_versioning", "array<variant>"), F.array().cast("array<variant>")))
    bad = artifacts.where(~absent(F.col("data"), "media_versioning") & (F.coalesce("derivation_of", F.lit("")) != "") & (size == 0))
    return issues(bad, F.col("path"), F.lit("media_versioning is empty while derivation_of is set"), "media_versioning", "warn")
