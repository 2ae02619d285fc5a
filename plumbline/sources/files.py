"""Sources and sinks: strict YAML and JSON, Markdown nodes, captions, segments, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import seconds_of, short_clock

FRONT = r"(?sd)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?\z"


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"duplicate key: {k}")
        out[k] = v
    return out


def strict_json(text: str) -> str:
    """The document again as JSON; raises on a repeated key."""
    return json.dumps(json.loads(text, object_pairs_hook=_no_repeats), ensure_ascii=False)


def strict_yaml(text: str) -> str:
    """A YAML document as JSON; raises on a repeated key. Needs PyYAML where it runs."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode, deep: bool = False) -> dict:
        return _no_repeats([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value])

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return json.dumps(yaml.load(text, Loader), default=str, ensure_ascii=False)


def _parsed(parse):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            body, error = [], []
            for text in frame["raw"]:
                try:
                    body.append(parse(text) if text is not None else None)
                    error.append(None)
                except Exception as e:  # a document that can't be read is a row with its error
                    body.append(None)
                    error.append(str(e).split("\n")[0][:200])
            yield pd.DataFrame({"path": frame["path"], "json": body, "error": error})

    return run


def parse_documents(rows: DataFrame, kind: str = "yaml") -> DataFrame:
    """(path, body VARIANT, error) of documents (path, raw); error is set where one is not well formed."""
    parsed = rows.select("path", "raw").mapInPandas(_parsed(strict_yaml if kind == "yaml" else strict_json), "path string, json string, error string")
    return parsed.select("path", F.try_parse_json("json").alias("body"), "error")


def read_documents(spark: SparkSession, folder: str, glob: str = "*.yaml", kind: str = "yaml") -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return parse_documents(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")), kind)


def split_nodes(rows: DataFrame) -> DataFrame:
    """(path, raw_frontmatter, body) of Markdown nodes (path, raw); both null where there is no header."""
    ok = F.col("raw").rlike(FRONT)
    return rows.select("path", F.when(ok, F.regexp_extract("raw", FRONT, 1)).alias("raw_frontmatter"), F.when(ok, F.regexp_extract("raw", FRONT, 2)).alias("body"))


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return split_nodes(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def captions(rows: DataFrame) -> DataFrame:
    """(path, line, ts, ts_display, text) of lines ``[ts] text`` of documents (path, raw); others and blank ones are left out."""
    lines = rows.select("path", F.posexplode(F.split("raw", "\n")).alias("line", "raw"))
    pattern = r"^\[([0-9:.]+)\]\s*(.*?)\s*$"
    rows = lines.select("path", "line", F.regexp_extract("raw", pattern, 1).alias("ts_display"), F.regexp_extract("raw", pattern, 2).alias("text"))
    return rows.where("ts_display <> '' and text <> ''").select("path", "line", seconds_of(F.col("ts_display")).alias("ts"), "ts_display", "text")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return captions(spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("raw"))).drop("path")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Labelled intervals; a malformed row fails the read."""
    return spark.read.csv(path, header=True, mode="FAILFAST", schema="start_seconds double, end_seconds double, duration_seconds double, speaker string")


def caption_events(events: DataFrame) -> DataFrame:
    """(text, start, duration) of caption events (tStartMs, dDurationMs, segs<utf8>); blank ones are left out."""
    text = F.trim(F.array_join(F.transform("segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return events.select(text.alias("text"), (F.col("tStartMs") / 1000).alias("start"), (F.coalesce("dDurationMs", F.lit(0)) / 1000).alias("duration")).where("text <> ''")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, length) of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"), "length")


def write_segments(segments: DataFrame, path: str) -> None:
    """CSV with times to three places. segments: start, end, speaker."""
    f = lambda c: F.format_string("%.3f", c)
    segments.select(f(F.col("start")).alias("start_seconds"), f(F.col("end")).alias("end_seconds"), f(F.col("end") - F.col("start")).alias("duration_seconds"), "speaker").write.mode("overwrite").csv(path, header=True)


def transcript_documents(segments: DataFrame) -> DataFrame:
    """(path, raw): for each slug its segments as a document of lines ``[ts] text`` under a heading. segments: slug, url, start, text."""
    line = F.concat(F.lit("["), short_clock(F.col("start")), F.lit("] "), F.trim("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("l")))), lambda x: x["l"]), "\n")
    head = F.concat(F.lit("# Transcript — "), F.col("slug"), F.lit("\n\nSource URL: "), F.min("url"), F.lit("\n\n"))
    return segments.groupBy("slug").agg(F.concat(head, body, F.lit("\n")).alias("raw")).select(F.concat("slug", F.lit(".md")).alias("path"), "raw")


def speaker_maps(turns: DataFrame) -> DataFrame:
    """(path, raw): for each slug a CSV of its speakers by time spoken, longest first, with an empty place for the name. turns: slug, speaker, start, end."""
    total = turns.groupBy("slug", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("t"), F.count(F.lit(1)).alias("n"))
    row = F.concat(F.col("speaker"), F.lit(",,"), F.format_string("%.3f", F.col("t")), F.lit(","), F.col("n").cast("string"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("o"), "speaker", row.alias("l")))), lambda x: x["l"]), "\n")
    return total.groupBy("slug").agg(F.concat(F.lit("speaker,name,total_seconds,segments\n"), rows, F.lit("\n")).alias("raw")).select(F.concat("slug", F.lit("-speakers.csv")).alias("path"), "raw")
