"""Checks of research artifacts against themselves, the manifest, their nodes and their sources.

artifacts: path, data (VARIANT), target_type. Sections of entries are exploded
once each; every reference is an equality join.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .integrity import walk_strings, walk_text
from . import rules
from .issues import Check, each_told, issues
from .rules import absent, blank, falsy
from .verbatim import description_tokens

#: Keys that every artifact has.
TOP_LEVEL = ("id", "type", "schema_version", "target_node", "status", "created", "primary_sources", "document_intrinsic", "context_extrinsic", "quotes", "entities_referenced", "naming_quirks")
OBSERVATIONS = ("direct", "relayed")
TIERS = ("sworn-oath", "sworn-perjury", "dopsr-cleared", "on-record", "self-attested", "secondary-source")
#: Capital words that carry no name.
PLAIN_CAPITALS = (
    "I He She They We You It Me Us Them The A An Per This That These Those Here There When Where Why How But And Or So Yet For Nor In On At By To From With Of About After Before During Since Until "
    "Throughout As If While Though Although Because My Your His Her Their Our Its All Any Each Every Some Most Few Many No Not None Nothing Yes Now Then Also Both Either Neither"
).split()


def entries(artifacts: DataFrame, section: str, keep: tuple[str, ...] = ("path", "target_type")) -> DataFrame:
    """(keep, section, idx, entry): the entries of a list section; none where it is no list."""
    name = f"_entries_{uuid.uuid4().hex}"
    artifacts.createOrReplaceTempView(name)
    cols = ", ".join(f"a.{c}" for c in keep)
    return artifacts.sparkSession.sql(f"SELECT {cols}, '{section}' AS section, e.pos AS idx, e.value AS entry FROM {name} a, LATERAL variant_explode(try_variant_get(a.data, '$.{section}', 'variant')) e WHERE e.key IS NULL")


def all_entries(artifacts: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ("path", "target_type")) -> DataFrame:
    """The entries of several list sections, or of all lists at the top, in one pass: the root is exploded once, and what it holds once more."""
    name = f"_artifacts_{uuid.uuid4().hex}"
    artifacts.createOrReplaceTempView(name)
    cols = ", ".join(f"a.{c}" for c in keep)
    wanted = "" if names is None else f"s.key IN ({', '.join(repr(n) for n in names)}) AND "
    return artifacts.sparkSession.sql(f"SELECT {cols}, s.key AS section, e.pos AS idx, e.value AS entry FROM {name} a, LATERAL variant_explode(a.data) s, LATERAL variant_explode(s.value) e WHERE {wanted}e.key IS NULL")


def of(key: str, body: str = "entry") -> Column:
    return F.try_variant_get(F.col(body), f"$.{key}", "string")


def place() -> Column:
    return F.concat(F.col("section"), F.lit("["), F.col("idx").cast("string"), F.lit("]: "))


def _messages(rows: DataFrame, found: list[Column], check: str, level: str = "error", prefix: Column | None = None) -> DataFrame:
    rows = rows.withColumn("_m", each_told(found))
    return issues(rows.where("_m is not null"), F.col("path"), F.concat(place() if prefix is None else prefix, F.col("_m")), check, level)


#: Words before a colon that name a scheme, not a key.
SCHEMES = ("http", "https", "ftp", "ftps", "mailto", "ssh", "file", "git", "svn", "ws", "wss", "sftp", "rsync")


def raw_line_traps(raw: DataFrame) -> DataFrame:
    """Warnings for unquoted scalars that YAML would cut at a comment sign or read as a mapping. raw: path, raw.

    The value of a line is what follows its key; a comment of three words or
    more, or an inner ``word: `` before two words or more, is likely prose.
    """
    lines = raw.select("path", F.posexplode(F.split("raw", "\n")).alias("idx", "line")).withColumn("section", F.lit("line"))
    value = F.regexp_extract("line", r"^\s*-?\s*[A-Za-z_][\w-]*:\s+([^'\"|>#\s].*)$", 1)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    comment = F.regexp_extract(value, r"^\S.*?\s#(\S.*)$", 1)
    inner = F.regexp_extract(value, r"^.*?(\w+):\s+(\S.+)$", 1)
    rest = F.regexp_extract(value, r"^.*?(\w+):\s+(\S.+)$", 2)
    cut = F.when(words(comment) >= 3, F.lit("text after ' #' is lost; quote the value"))
    colon = F.when((inner != "") & ~F.lower(inner).isin(*SCHEMES) & ~inner.rlike("^[0-9]+$") & (words(rest) >= 2), F.lit("inner ': ' needs quotes"))
    return _messages(lines, [cut, colon], "raw_line_traps", "warn")


def artifact_parse(parsed: DataFrame) -> DataFrame:
    """Fatal: not well formed, or no mapping. parsed: path, body, error."""
    message = F.when(F.col("error").isNotNull(), F.concat(F.lit("parse error: "), F.col("error"))).when(F.col("body").isNull() | ~F.schema_of_variant("body").startswith("OBJECT"), "root is no mapping")
    return issues(parsed.withColumn("_m", message).where("_m is not null"), F.col("path"), F.col("_m"), "artifact_parse", fatal=True)


def artifact_top_level(artifacts: DataFrame, nodes: DataFrame, statuses: tuple[str, ...], described: tuple[str, ...]) -> DataFrame:
    """Keys, id, type, status, target and description. nodes: path."""
    d = F.col("data")
    targets = nodes.select(F.regexp_replace("path", r"\.md$", "").alias("_t")).distinct().withColumn("_there", F.lit(True))
    rows = artifacts.withColumn("_t", of("target_node", "data")).join(targets, "_t", "left")
    found = [F.when(absent(d, k), F.lit(f"missing key: {k}")) for k in TOP_LEVEL]
    found += [
        F.when(~falsy(d, "id") & (of("id", "data") != F.regexp_replace("path", r"\.ya?ml$", "")), F.lit("id does not match the path")),
        F.when(~absent(d, "type") & ~F.coalesce(of("type", "data") == "research-artifact", F.lit(False)), F.lit("type must be research-artifact")),
        F.when(~falsy(d, "status") & ~of("status", "data").isin(*statuses), F.lit("invalid status")),
        F.when(~falsy(d, "target_node") & F.col("_there").isNull(), F.lit("target_node does not exist")),
        F.when(F.col("target_type").isin(*described) & absent(d, "description"), F.lit("missing key: description")),
    ]
    return _messages(rows, found, "artifact_top_level", prefix=F.lit(""))


def lifecycle(rows: DataFrame) -> DataFrame:
    """Ids that are missing or met before, and dates of entry that are missing, in one pass. rows: path, section, idx, entry."""
    before = W.partitionBy("path", "section", "id").orderBy("idx")
    asked = rows.select("path", "section", "idx", of("id").alias("id"), absent(F.col("entry"), "added_date").alias("undated"))
    again = F.col("id").isNotNull() & (F.row_number().over(before) > 1)
    told = asked.withColumn("again", again)
    return _messages(told, [F.when(F.col("id").isNull(), F.lit("missing id")), F.when(F.col("undated"), F.lit("missing added_date")), F.when(F.col("again"), F.concat(F.lit("duplicate id: "), F.col("id")))], "lifecycle")


def primary_sources(artifacts: DataFrame, manifest_paths: DataFrame) -> DataFrame:
    """manifest_paths: source_path."""
    rows = entries(artifacts, "primary_sources")
    base = _messages(rows, [F.when(absent(F.col("entry"), k), F.lit(f"missing {k}")) for k in ("path", "format")], "primary_sources")
    unknown = rows.withColumn("source_path", of("path")).where("source_path <> ''").join(manifest_paths, "source_path", "left_anti")
    return base.unionByName(issues(unknown, F.col("path"), F.concat(place(), F.lit("not in manifest: "), F.col("source_path")), "primary_sources"))


def checksum_at_extraction(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources whose stored digest is no longer the manifest's. manifest: source_path, sha256."""
    rows = entries(artifacts, "primary_sources").select("path", "section", "idx", of("path").alias("source_path"), of("sha256_at_extraction").alias("taken")).where("taken is not null")
    changed = rows.join(manifest, "source_path").where("sha256 <> taken")
    return issues(changed, F.col("path"), F.concat(place(), F.lit("source changed since extraction: "), F.col("source_path")), "checksum_at_extraction", "warn")


def quotes(artifacts: DataFrame, manifest_paths: DataFrame) -> DataFrame:
    """Shape, source, and what persons', transcripts' and findings' quotes need."""
    rows = entries(artifacts, "quotes")
    e, kind = F.col("entry"), F.col("target_type")
    other = kind.isNotNull()
    src_ok = F.schema_of_variant(F.try_variant_get(e, "$.source", "variant")).startswith("OBJECT")
    found = [
        F.when(absent(e, "text"), F.lit("missing text")),
        F.when(~F.coalesce(src_ok, F.lit(False)), F.lit("source must have path and location")),
        F.when(src_ok & (of("source.path").isNull() | of("source.location").isNull()), F.lit("source must include path and location")),
        F.when(src_ok & (kind == "person") & falsy(e, "observation_type"), F.lit("missing observation_type")),
        F.when(src_ok & (kind == "person") & ~falsy(e, "observation_type") & ~of("observation_type").isin(*OBSERVATIONS), F.lit("invalid observation_type")),
        F.when(src_ok & (kind == "person") & blank(e, "context"), F.lit("missing context")),
        F.when(src_ok & (kind == "transcript") & falsy(e, "speaker_id"), F.lit("missing speaker_id")),
        F.when(src_ok & of("attestation_tier").isNotNull() & ~of("attestation_tier").isin(*TIERS), F.lit("invalid attestation_tier")),
    ]
    warned = [
        F.when(src_ok & other & (kind != "person") & ~falsy(e, "observation_type"), F.lit("observation_type is ignored here")),
        F.when(src_ok & other & (kind != "transcript") & ~falsy(e, "speaker_id"), F.lit("speaker_id is ignored here")),
        F.when(src_ok & other & (kind != "finding") & of("attestation_tier").isin(*TIERS), F.lit("attestation_tier is ignored here")),
    ]
    out = _messages(rows, found, "quotes").unionByName(_messages(rows, warned, "quotes", "warn"))
    unknown = rows.withColumn("source_path", of("source.path")).where("source_path <> ''").join(manifest_paths, "source_path", "left_anti")
    out = out.unionByName(issues(unknown, F.col("path"), F.concat(place(), F.lit("source not in manifest: "), F.col("source_path")), "quotes"))
    speakers = entries(artifacts, "speakers").select("path", of("id").alias("sid")).where("sid is not null").distinct()
    lost = rows.where("target_type = 'transcript'").withColumn("sid", of("speaker_id")).where("sid <> ''").join(speakers, ["path", "sid"], "left_anti")
    return out.unionByName(issues(lost, F.col("path"), F.concat(place(), F.lit("unknown speaker: "), F.col("sid")), "quotes"))


def verbatim_quotes(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Quotes that their source does not hold. sources: source_path, text (null for those without text). Each source is normalized once."""
    asked = entries(artifacts, "quotes").select("path", "section", "idx", of("source.path").alias("source_path"), of("text").alias("quote")).where("source_path is not null and quote is not null")
    norm = sources.join(asked.select("source_path").distinct(), "source_path", "left_semi").select("source_path", F.lit(True).alias("there"), X.normalize_for_compare(F.col("text")).alias("norm"))
    rows = asked.join(norm, "source_path", "left").withColumn("q", X.normalize_for_compare(F.col("quote")))
    lost = rows.where("instr(norm, q) = 0")  # an empty quote is found in every text
    gone, mute = rows.where("there is null"), rows.where("there and norm is null")
    out = issues(lost, F.col("path"), F.concat(place(), F.lit("not verbatim in "), F.col("source_path")), "verbatim_quotes")
    out = out.unionByName(issues(gone, F.col("path"), F.concat(place(), F.lit("source file missing: "), F.col("source_path")), "verbatim_quotes"))
    return out.unionByName(issues(mute, F.col("path"), F.concat(place(), F.lit("source has no text: "), F.col("source_path")), "verbatim_quotes", "warn"))


def _held(section: str, key: str) -> Column:
    """What the entries of a list section have for a key, from the artifact's own row; empty where it is no list."""
    each = F.transform(F.try_variant_get("data", f"$.{section}", "array<variant>"), lambda e: F.try_variant_get(e, f"$.{key}", "string"))
    return F.coalesce(F.array_compact(each), F.array().cast("array<string>"))


def _told_of_entries(rows: DataFrame, found: list[Column]) -> DataFrame:
    """The issues of entries in one pass. found: arrays of (check, level, message), or null for none."""
    none = F.array().cast("array<struct<check:string,level:string,message:string>>")
    told = rows.select("path", place().alias("place"), F.explode_outer(F.concat(*[F.coalesce(f, none) for f in found])).alias("f")).where("f is not null")  # explode alone would evaluate all three times
    return issues(told, F.col("path"), F.concat("place", "f.message"), F.col("f.check"), F.col("f.level"))


def _problem(check: str, level: str, message: Column | str) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def reference_checks(artifacts: DataFrame, sections: list[str]) -> DataFrame:
    """References between entries of an artifact: lineage fields against the ids of all sections (a warning), quote ids and evidence ids against quotes.

    An artifact's references are met with the ids that its own row holds, in one pass and without a join. A path names one artifact.
    """
    ids = F.array_distinct(F.concat(*[_held(s, "id") for s in sections])) if sections else F.array().cast("array<string>")
    held_ids = artifacts.select("path", "data", ids.alias("ids"), _held("quotes", "id").alias("quoted"))
    rows = all_entries(held_ids, sorted({*sections, "entities_referenced", "contradictions"}), ("path", "ids", "quoted"))
    many = F.try_variant_get(F.col("entry"), "$.corroborated_by", "array<string>")
    refs = F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array_compact(F.array(of("superseded_by"), of("contradicted_by"))))
    named = F.transform(F.try_variant_get(F.col("entry"), "$.references", "array<struct<quote_id:string>>"), lambda x: x["quote_id"])
    held = F.try_variant_get(F.col("entry"), "$.positions", "array<struct<evidence_id:string>>")
    within = lambda c: F.col("section") == c
    lost = lambda refs, ids, check, level, what: F.transform(F.filter(refs, lambda r: r.isNotNull() & ~F.array_contains(F.col(ids), r)), lambda r: _problem(check, level, F.concat(F.lit(f"reference to no {what}: "), r)))
    return _told_of_entries(rows, [
        F.when(F.col("section").isin(*sections), lost(refs, "ids", "cross_refs", "warn", "entry")),
        F.when(within("entities_referenced"), lost(named, "quoted", "entities_referenced", "error", "quote")),
        F.when(within("contradictions"), lost(F.transform(held, lambda x: x["evidence_id"]), "quoted", "contradictions", "error", "quote")),
        F.when(within("contradictions") & (F.coalesce(F.size(held), F.lit(0)) < 2), F.array(_problem("contradictions", "error", "needs two positions"))),
    ])


def hypothesis_citations(artifacts: DataFrame) -> DataFrame:
    """Evaluations and counter-evidence: hypothesis by id in any case, length of the status, sources with exactly one target each; in one pass within an artifact's row."""
    known = F.transform(_held("hypotheses", "id"), F.lower)
    rows = all_entries(artifacts.select("path", "data", known.alias("known")), ["hypothesis_evaluation", "counter_evidence"], ("path", "known"))
    judged = F.col("section") == "hypothesis_evaluation"
    hid = F.lower(F.when(judged, of("hypothesis_id")).otherwise(of("against_hypothesis_id")))
    size = F.length(F.trim(of("status")))
    src = F.try_variant_get(F.col("entry"), "$.sources", "array<struct<finding_path:string,entity_path:string,anchor:string,description:string>>")
    one = lambda s: (s["finding_path"].isNotNull() != s["entity_path"].isNotNull()) & (s["entity_path"].isNull() | s["anchor"].isNotNull()) & (F.length(F.coalesce(s["description"], F.lit(""))) >= 10)
    told = lambda when, level, message: F.when(when, F.array(_problem("hypothesis_citations", level, message)))
    return _told_of_entries(rows, [
        told(hid.isNotNull() & ~F.array_contains("known", hid), "error", F.concat(F.lit("unknown hypothesis: "), hid)),
        told(judged & ~size.between(10, 300), "warn", "status should have 10 to 300 characters"),
        told(F.coalesce(F.size(src), F.lit(0)) == 0, "error", "needs sources"),
        told(F.exists(src, lambda s: ~F.coalesce(one(s), F.lit(False))), "error", "a source must name one target, its anchor and a description"),
    ])


def layer_references(artifacts: DataFrame) -> DataFrame:
    """Upward references anywhere in a body: findings must not name investigations, entities neither findings nor investigations."""
    rows = artifacts.where("target_type <> 'investigation'").select(F.struct("path", "target_type").alias("k"), "data")
    strings = walk_strings(rows, "k", "data", ("/findings/", "/investigations/")).select("k.path", "k.target_type", F.col("path").alias("at"), "leaf")
    bad = F.when(F.col("target_type") == "finding", F.contains("leaf", F.lit("/investigations/"))).otherwise(True)
    return issues(strings.where(bad), F.col("path"), F.concat(F.col("at"), F.lit(": reference to a higher layer")), "layer_references")


def finding_sources(artifacts: DataFrame) -> DataFrame:
    """Sources of findings' quotes that no entity artifact has among its primary sources."""
    used = entries(artifacts.where("target_type = 'finding'"), "quotes").select("path", "section", "idx", of("source.path").alias("source_path")).where("source_path is not null")
    known = entries(artifacts.where("target_type not in ('finding', 'investigation')"), "primary_sources").select(of("path").alias("source_path")).distinct()
    return issues(used.join(known, "source_path", "left_anti"), F.col("path"), F.concat(place(), F.lit("source is cited by no entity: "), F.col("source_path")), "finding_sources")


def string_lists(artifacts: DataFrame, names: tuple[str, ...] = ("establishes", "does_not_establish")) -> DataFrame:
    """List sections of plain strings: each must be a non-empty string."""
    rows = all_entries(artifacts, list(names))
    text = F.when(F.schema_of_variant("entry") == "STRING", F.trim(F.try_variant_get("entry", "$", "string")))
    return issues(rows.where(F.coalesce(text, F.lit("")) == ""), F.col("path"), F.concat(place(), F.lit("must be a non-empty string")), "string_lists")


def paused_without_path(artifacts: DataFrame) -> DataFrame:
    """Investigations on hold must say what would end it. artifacts also has target_status."""
    has = entries(artifacts, "closure_path").select("path").distinct()
    bad = artifacts.where("target_type = 'investigation' and target_status = 'paused'").join(has, "path", "left_anti")
    return issues(bad, F.col("path"), F.lit("paused without a closure_path"), "paused_without_path")


def speaker_baselines(artifacts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Speakers linked to people of whom there is no baseline image. baselines: slug."""
    rows = entries(artifacts.where("target_type = 'transcript'"), "speakers").withColumn("slug", F.regexp_extract(of("node_link"), r"^/people/([^/]+)$", 1)).where("slug <> ''")
    return issues(rows.join(baselines, "slug", "left_anti"), F.col("path"), F.concat(place(), F.lit("no baseline image of "), F.col("slug")), "speaker_baselines", "warn")


# -- artifact, node and source together. pairs: path, data, target_type, node_body, source_text
def coverage(pairs: DataFrame) -> DataFrame:
    """Quotes that the node's body lacks; each body is normalized once, in its pair's row."""
    bodies = pairs.select("path", "data", X.normalize_for_compare(F.col("node_body")).alias("norm"))
    rows = entries(bodies, "quotes", ("path", "norm")).select("path", "section", "idx", "norm", of("text").alias("quote")).where("quote is not null")
    lost = rows.withColumn("q", X.normalize_for_compare(F.col("quote"))).where("instr(norm, q) = 0")  # an empty quote is found in every text
    return issues(lost, F.col("path"), F.concat(place(), F.lit("not in the node: "), X.truncate(F.col("quote"), 80)), "coverage")


def boundary(pairs: DataFrame, rendered: DataFrame, generated: str = "Associated Nodes") -> DataFrame:
    """Nodes whose body, but for one generated section, is not what rendering gives. rendered: path, body."""
    bare = lambda c: F.trim(F.regexp_replace(c, rf"(?ms)^## {generated}\s*\n.*?(?=^## |\z)", ""), F.lit(" \n"))
    rows = pairs.join(rendered.select("path", F.col("body").alias("_b")), "path")
    return issues(rows.where(bare(F.col("node_body")) != bare(F.col("_b"))), F.col("path"), F.lit("body differs from its rendering"), "boundary")


def stub_linking(pairs: DataFrame) -> DataFrame:
    """Entities that the node does not link to, itself left out."""
    own = F.concat(F.lit("/"), of("target_node", "data"))
    named = F.transform(F.try_variant_get("data", "$.entities_referenced", "array<variant>"), lambda e: F.try_variant_get(e, "$.wrap_path", "string"))
    wanted = F.filter(F.array_except(named, X.links(F.col("node_body"))), lambda x: (x != "") & (x != F.col("own")))
    lost = pairs.withColumn("own", own).select("path", F.explode_outer(wanted).alias("link")).where("link is not null")
    return issues(lost, F.col("path"), F.concat(F.lit("not linked: "), F.col("link")), "stub_linking")


def description_drift(pairs: DataFrame) -> DataFrame:
    """Names, numbers and quoted strings of the description that neither source nor artifact has, one issue each."""
    names = F.transform(F.try_variant_get(F.col("data"), "$.entities_referenced", "array<struct<name:string>>"), lambda x: x["name"])
    quirks = F.transform(F.try_variant_get(F.col("data"), "$.naming_quirks", "array<struct<canonical:string>>"), lambda x: x["canonical"])
    ground = F.concat_ws("\n", F.col("source_text"), of("context_extrinsic", "data"), of("document_intrinsic", "data"), F.array_join(quirks, "\n"), F.array_join(names, "\n"))
    rows = pairs.where("coalesce(source_text, '') <> ''").select("path", "node_body", ground.alias("ground"))  # taken once; normalizing names it again and again
    rows = rows.select("path", X.section(F.col("node_body"), "Description").alias("text"), F.lower(X.normalize_for_compare(F.col("ground"))).alias("norm"))
    tokens = F.filter(description_tokens(F.col("text")), lambda t: (F.length(t) >= 2) & ~t.isin(*PLAIN_CAPITALS))
    rows = rows.where("text is not null").withColumn("token", F.explode_outer(tokens)).where("token is not null").withColumn("q", F.lower(X.normalize_for_compare(F.col("token"))))
    return issues(rows.where("instr(norm, q) = 0"), F.col("path"), F.concat(F.lit("not in source: "), F.col("token")), "description_drift")


def prose_drift(artifacts: DataFrame, sources: DataFrame, top: dict[str, list[str]], listed: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Significant tokens of prose fields that none of the artifact's sources has; an error where it is all of them.

    top and listed give the fields by type; sources: source_path, text.
    """
    used = entries(artifacts, "primary_sources").select("path", of("path").alias("source_path")).where("source_path is not null").distinct()
    texts = sources.join(used.select("source_path").distinct(), "source_path", "left_semi").where("text is not null")
    pool = used.join(texts.select("source_path", F.explode(X.significant_tokens(F.col("text"))).alias("token")), "source_path").select("path", "token").distinct().withColumn("known", F.lit(True))
    parts = [artifacts.where(F.col("target_type") == t).select("path", F.lit(f).alias("place"), of(f, "data").alias("prose")) for t, fs in top.items() for f in fs]
    parts += [entries(artifacts.where(F.col("target_type") == t), s).select("path", F.concat(place(), F.lit(f)).alias("place"), of(f).alias("prose")) for t, fs in listed.items() for s, f in fs]
    prose = reduce(DataFrame.unionByName, parts).select("path", "place", F.explode(X.significant_tokens(F.col("prose"))).alias("token"))
    ready = pool.select("path").distinct()
    judged = prose.join(ready, "path", "left_semi").join(pool, ["path", "token"], "left").groupBy("path", "place").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("token")))).alias("lost")).where(F.size("lost") > 0)
    message = F.concat(F.col("place"), F.lit(": "), F.size("lost").cast("string"), F.lit(" tokens not in source: "), F.array_join(F.slice("lost", 1, 8), ", "))
    whole = F.size("lost") == F.col("n")
    out = issues(judged.where(whole), F.col("path"), message, "prose_drift", tokens=F.col("lost")).unionByName(issues(judged.where(~whole), F.col("path"), message, "prose_drift", "warn", tokens=F.col("lost")))
    mute = used.select("path").distinct().join(ready, "path", "left_anti")
    return out.unionByName(issues(mute, F.col("path"), F.lit("no source text; drift not checked"), "prose_drift", "warn"))


# -- what the checks are run over
#: Formats without text, and the types whose kind counts.
BINARY = ("image", "video", "audio")
KINDED = ("event", "transcript", "organization")


def with_target(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Artifacts with type, archetype, kind, status and derivation of the node they are of. artifacts: path, data; nodes: path, fm (VARIANT)."""
    fm = lambda k: F.try_variant_get("fm", f"$.{k}", "string")
    target = nodes.select(F.regexp_replace("path", r"\.md$", "").alias("_t"), fm("type").alias("target_type"), fm("archetype").alias("target_archetype"), F.when(fm("type").isin(*KINDED), fm("kind")).alias("target_kind"), fm("status").alias("target_status"), fm("derivation_of").alias("derivation_of"))
    return artifacts.withColumn("_t", of("target_node", "data")).join(target, "_t", "left").drop("_t")


def source_text(path: Column, raw: Column, extraction: Column, sibling: Column, extracted: Column) -> Column:
    """The plain text of a source by its extension; null where there is none.

    Of a PDF whose own text is not to be trusted that of the file beside it, else what an outside
    tool took out of it (``extracted``); pages without tags; other text as it is. A hyphen at a
    line's end joins the words around it.
    """
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    trusted = F.coalesce(extraction, F.lit("text-native")) == "text-native"
    text = F.when(ext == "pdf", F.when(trusted, extracted).otherwise(F.coalesce(sibling, extracted))).when(ext.isin("html", "htm"), X.clean_html(raw)).when(ext.isin("txt", "md", "json"), raw)
    return F.regexp_replace(text, r"-\s+", "-")


def gathered(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, source_text, missing): the texts of an artifact's sources in order, and the paths of those that have none. sources: source_path, text."""
    used = entries(artifacts, "primary_sources").select("path", "idx", of("path").alias("source_path"), of("format").alias("format")).where("source_path <> ''")
    used = used.where(~F.coalesce(F.col("format").isin(*BINARY), F.lit(False)))
    rows = used.join(sources.select("source_path", "text"), "source_path", "left")
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("idx", value.alias("v"))))), lambda x: x["v"])
    return rows.groupBy("path").agg(F.array_join(in_order(F.col("text").isNotNull(), F.col("text")), "\n").alias("source_text"), in_order(F.col("text").isNull(), F.col("source_path")).alias("missing"))


def phase_inputs(artifacts: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Fatal: no target node. Sources that are not there, and (a warning) those without text. nodes: path; sources: source_path, text."""
    there = nodes.select(F.regexp_replace("path", r"\.md$", "").alias("_t")).distinct().withColumn("_there", F.lit(True))
    each = F.transform(F.try_variant_get("data", "$.primary_sources", "array<variant>"), lambda e: F.struct(F.try_variant_get(e, "$.path", "string").alias("source_path"), F.try_variant_get(e, "$.format", "string").alias("format")))
    rows = artifacts.select("path", of("target_node", "data").alias("_t"), F.filter(each, lambda s: (s["source_path"] != "") & ~F.coalesce(s["format"].isin(*BINARY), F.lit(False))).alias("used"))
    asked = rows.join(there, "_t", "left").select("path", "_t", "_there", F.explode_outer(F.when(F.col("_there"), F.col("used"))).alias("s")).select("path", "_t", "_there", "s.source_path")
    held = sources.select("source_path", F.col("text").isNotNull().alias("has_text"))  # no text is moved
    told = asked.join(held, "source_path", "left").where("_there is null or source_path is not null and not coalesce(has_text, false)")
    lost, gone = F.col("_there").isNull(), F.col("has_text").isNull()
    message = F.when(lost, F.concat(F.lit("target_node does not exist: "), F.coalesce("_t", F.lit("none")))).when(gone, F.concat(F.lit("source is not there: "), F.col("source_path"))).otherwise(F.concat(F.lit("source has no text: "), F.col("source_path")))
    return issues(told, F.col("path"), message, "phase_iii_inputs", F.when(lost | gone, "error").otherwise("warn"), lost)


#: Of lists at the top the fields that hold text, texts at the top, and keys that hold none.
TEXT_FIELDS = {"quotes": ("text", "significance", "context"), "entities_referenced": ("name", "wrap_path", "context_summary"), "naming_quirks": ("observed", "canonical", "note"), "rumors": ("claim", "note")}
PROSE = ("description", "background", "top_relevance", "credibility_notes", "pattern_statement")
NO_TEXT = ("id", "type", "schema_version", "target_node", "status", "created", "updated", "primary_sources")


def strings(artifacts: DataFrame) -> DataFrame:
    """(path, text): the text that an artifact's author has typed, one string a line, keys by code point and list items by number.

    Of quotes, entities, quirks and rumors the fields of text and a rumor's observed sources; texts at the top; every string of all other keys but those that hold no text.
    """
    listed = re.compile("|".join([*(rf"{k}\[\d+\]\.({'|'.join(v)})" for k, v in TEXT_FIELDS.items()), r"rumors\[\d+\]\.observed_sources\[\d+\]", *PROSE]), re.ASCII)
    top, others = re.compile(r"\$\.([^.\[]+)"), {*TEXT_FIELDS, *PROSE, *NO_TEXT}

    def taken(at: str) -> bool:
        first = top.match(at)
        return first is not None and (first[1] not in others or listed.fullmatch(at, 2) is not None)

    return walk_text(artifacts, "path", "data", taken)


def artifact_checks(statuses: tuple[str, ...], described: tuple[str, ...], sections: list[str], entry_rules: list[rules.EntryRule] = rules.ENTRY_RULES) -> list[Check]:
    """The ordered registry over the tables ``artifacts`` (see with_target), ``nodes``, ``manifest`` (source_path, sha256), ``sources`` (source_path, text) and ``baselines`` (slug)."""
    named = lambda t: t["manifest"].select("source_path")
    fns = [
        ("artifact_top_level", lambda t: artifact_top_level(t["artifacts"], t["nodes"], statuses, described)), ("primary_sources", lambda t: primary_sources(t["artifacts"], named(t))),
        ("checksum_at_extraction", lambda t: checksum_at_extraction(t["artifacts"], t["manifest"])), ("lifecycle", lambda t: lifecycle(all_entries(t["artifacts"], sections))),
        ("entries", lambda t: rules.entry_issues(all_entries(t["artifacts"], [r.section for r in entry_rules]), named(t), entry_rules)), ("quotes", lambda t: quotes(t["artifacts"], named(t))),
        ("verbatim_quotes", lambda t: verbatim_quotes(t["artifacts"], t["sources"])), ("references", lambda t: reference_checks(t["artifacts"], sections)), ("hypothesis_citations", lambda t: hypothesis_citations(t["artifacts"])),
        ("layer_references", lambda t: layer_references(t["artifacts"])), ("finding_sources", lambda t: finding_sources(t["artifacts"])), ("string_lists", lambda t: string_lists(t["artifacts"])),
        ("paused_without_path", lambda t: paused_without_path(t["artifacts"])), ("speaker_baselines", lambda t: speaker_baselines(t["artifacts"], t["baselines"])), ("media_versioning", lambda t: rules.empty_while_derived(t["artifacts"])),
    ]
    return [Check(name, k, fn) for k, (name, fn) in enumerate(fns)]


def coverage_checks() -> list[Check]:
    """The ordered registry over the tables ``pairs`` (path, data, target_type, node_body, source_text), ``rendered`` (path, body), ``nodes`` and ``sources``; a missing target cuts the rest."""
    fns = [("phase_iii_inputs", lambda t: phase_inputs(t["pairs"], t["nodes"], t["sources"])), ("coverage", lambda t: coverage(t["pairs"])), ("boundary", lambda t: boundary(t["pairs"], t["rendered"])), ("stub_linking", lambda t: stub_linking(t["pairs"])), ("description_drift", lambda t: description_drift(t["pairs"]))]
    return [Check(name, k, fn) for k, (name, fn) in enumerate(fns)]
