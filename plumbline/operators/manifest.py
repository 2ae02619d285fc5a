"""The manifest of archived items: nesting, flattening, folding, upserts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import flag_status
from .issues import issues
from .rules import absent


def nest(rows: DataFrame, url: str, fields: list[str], order: list[str]) -> DataFrame:
    """(url, artifacts): the rows of each url as an array in order."""
    return rows.groupBy(url).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("artifacts"))


def flatten(nested: DataFrame, url: str) -> DataFrame:
    """One row for each artifact; urls without any vanish."""
    return nested.select(url, F.inline("artifacts"))


def fold(flat: DataFrame, url: str, position: str, first: list[str], artifact: list[str]) -> DataFrame:
    """Flat rows to nested ones: of the url's own fields the first value wins, and differing ones are counted as conflicts.

    A row is shuffled once, with its fields alone; first values and conflicts are told from a url's rows, in order.
    """
    rows = flat.select(url, F.struct(F.col(position).alias("_at"), F.struct(*first).alias("first"), F.struct(*artifact).alias("artifact")).alias("_row")).repartition(url)
    held = rows.groupBy(url).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    picks = [F.element_at("_rows", 1)["first"][f].alias(f) for f in first]
    several = lambda f: F.size(F.array_distinct(F.array_compact(F.transform("_rows", lambda x: x["first"][f])))) - 1
    conflict = sum((several(f) for f in first), F.lit(0)).cast("long")
    return held.select(url, *picks, F.sort_array(F.transform("_rows", lambda x: x["artifact"])).alias("artifacts"), conflict.alias("n_conflicts"))


def upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (url, path, format) rows: new urls come in, known ones gain artifacts, known pairs change nothing. manifest: url, artifacts<path, format>.

    A path that another url holds already is not taken over.
    """
    taken = flatten(manifest, "url").select("path", F.col("url").alias("_owner"))
    fresh = new.join(taken, "path", "left").where(F.col("_owner").isNull()).groupBy("url").agg(F.array_sort(F.collect_set(F.struct("path", "format"))).alias("_new"))
    none = F.array().cast("array<struct<path:string,format:string>>")
    return manifest.join(fresh, "url", "full_outer").select("url", F.concat(F.coalesce("artifacts", none), F.coalesce("_new", none)).alias("artifacts"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value, largest first, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


# -- checks of the manifest. manifest: url, status, archive_status, wayback_date, wayback_skip, artifacts<format, path, sha256, extraction_type>
#: The vocabularies of the manifest.
STATUSES = ("archived", "403-blocked", "402-blocked", "pending")
FORMATS = ("pdf", "html", "txt", "audio", "image", "video", "transcript")
EXTRACTIONS = ("text-native", "ocr-scan", "extraction-lossy")


def archive_status(rows: DataFrame) -> DataFrame:
    """Flag bits against what is archived, and a snapshot of what is to be skipped."""
    local = (F.col("status") == "archived") & (F.coalesce(F.size("artifacts"), F.lit(0)) > 0)
    remote = F.coalesce(F.col("wayback_date"), F.lit("")) != ""
    flag = flag_status(F.col("archive_status"), F.coalesce(local, F.lit(False)), remote)
    both = F.when(F.coalesce("wayback_skip", F.lit(False)) & remote & F.col("archive_status").between(0, 3), "skipped but has a snapshot")
    found = rows.withColumn("_m", F.explode(F.array_compact(F.array(flag, both))))
    return issues(found, F.col("url"), F.concat(F.lit("archive_status: "), F.col("_m")), "manifest_archive_status")


def value_enums(rows: DataFrame) -> DataFrame:
    """status, format and extraction_type in their vocabularies, where they are set."""
    each = rows.select("url", F.explode_outer("artifacts").alias("a"))
    out = issues(rows.where(~F.col("status").isin(*STATUSES)), F.col("url"), F.concat(F.lit("invalid status: "), F.col("status")), "manifest_value_enums")
    for name, allowed in (("format", FORMATS), ("extraction_type", EXTRACTIONS)):
        bad = each.where(~F.col(f"a.{name}").isin(*allowed))
        out = out.unionByName(issues(bad, F.col("url"), F.concat(F.lit(f"invalid {name}: "), F.col(f"a.{name}")), "manifest_value_enums"))
    return out


def extraction_types(rows: DataFrame) -> DataFrame:
    """Artifacts whose extraction_type is there and not in the vocabulary; an explicit null is not. rows: url, data (VARIANT)."""
    each = rows.select("url", F.explode(F.try_variant_get("data", "$.artifacts", "array<variant>")).alias("a"))
    value = F.try_variant_get("a", "$.extraction_type", "string")
    bad = each.where(~absent(F.col("a"), "extraction_type") & ~F.coalesce(value.isin(*EXTRACTIONS), F.lit(False)))
    return issues(bad, F.col("url"), F.concat(F.lit("invalid extraction_type: "), F.coalesce(value, F.lit("null")), F.lit(" of "), F.coalesce(F.try_variant_get("a", "$.path", "string"), F.lit("no path"))), "manifest_extraction_type")


def parse_gate(parsed: DataFrame) -> DataFrame:
    """Fatal: a manifest that can't be read or is no list of entries. parsed: path, body (VARIANT), error."""
    message = F.when(F.col("error").isNotNull(), F.concat(F.lit("parse error: "), F.col("error"))).when(F.col("body").isNull() | ~F.schema_of_variant("body").startswith("ARRAY"), "root is no list")
    return issues(parsed.withColumn("_m", message).where("_m is not null"), F.col("path"), F.col("_m"), "manifest_parse", fatal=True)


def load(parsed: DataFrame) -> DataFrame:
    """(url, data, position) of the entries of manifests that are lists. parsed: path, body."""
    rows = parsed.where(F.col("body").isNotNull() & F.schema_of_variant("body").startswith("ARRAY"))
    return rows.select(F.posexplode(F.try_variant_get("body", "$", "array<variant>")).alias("position", "data")).select(F.try_variant_get("data", "$.url", "string").alias("url"), "data", "position")


def ordered_entries(entries: DataFrame) -> DataFrame:
    """(url, json): entries with their artifacts in order of path and format, as they are saved; ``sources.store.save_manifest`` puts them in order of url. entries: url, data."""
    key = lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.path", "string"), F.lit("")).alias("p"), F.coalesce(F.try_variant_get(x, "$.format", "string"), F.lit("")).alias("f"), F.to_json(x).alias("j"))
    held = F.array_sort(F.transform(F.coalesce(F.try_variant_get("data", "$.artifacts", "array<variant>"), F.array().cast("array<variant>")), key))
    rest = F.map_filter(F.try_variant_get("data", "$", "map<string,variant>"), lambda k, v: ~k.isin("url", "artifacts"))
    body = F.concat(F.lit('{"url": '), F.to_json(F.to_variant_object(F.array("url"))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array("url")))) - 2), F.lit(', "artifacts": ['), F.array_join(F.transform(held, lambda x: x["j"]), ", "), F.lit("]"), F.when(F.size(rest) > 0, F.concat(F.lit(', "fields": '), F.to_json(rest))).otherwise(""), F.lit("}"))
    return entries.select("url", body.alias("json"))


def artifact_shape(rows: DataFrame) -> DataFrame:
    """One row a url, one artifact a path (one url naming it twice counts), artifacts exactly where it is archived."""
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    paths = rows.select("url", F.explode("artifacts.path").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where("n > 1")
    has = F.coalesce(F.size("artifacts"), F.lit(0)) > 0
    odd = rows.where(has != F.coalesce(F.col("status") == "archived", F.lit(False)))
    out = issues(urls, F.col("url"), F.lit("url occurs more than once"), "manifest_artifact_shape")
    out = out.unionByName(issues(paths, F.col("url"), F.concat(F.lit("path occurs more than once: "), F.col("p")), "manifest_artifact_shape"))
    return out.unionByName(issues(odd, F.col("url"), F.lit("artifacts do not agree with status"), "manifest_artifact_shape"))


def checksums(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts that are missing, have no digest, or another one. files: path, sha256."""
    each = rows.select("url", F.explode("artifacts").alias("a")).select("url", F.col("a.path").alias("path"), F.col("a.sha256").alias("stored"))
    live = files.select("path", F.col("sha256").alias("live"), F.lit(True).alias("there"))
    message = F.when(F.col("there").isNull(), "file missing").when(F.col("stored").isNull(), "no sha256").when(F.col("stored") != F.col("live"), "sha256 mismatch")
    bad = each.join(live, "path", "left").withColumn("_m", message).where("_m is not null")
    return issues(bad, F.col("url"), F.concat(F.col("path"), F.lit(": "), F.col("_m")), "manifest_checksums")


def refreshed(rows: DataFrame) -> DataFrame:
    """The rows with their flag bits recomputed."""
    local = F.coalesce((F.col("status") == "archived") & (F.size("artifacts") > 0), F.lit(False))
    return rows.withColumn("archive_status", local.cast("int") + 2 * (F.coalesce(F.col("wayback_date"), F.lit("")) != "").cast("int"))
