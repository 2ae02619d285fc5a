"""Referential integrity: uniqueness, keys, layers, links, checksums, flag bits, parity."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def later_occurrences(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The second and later rows of each key, with ``occurrence``. Keys that occur once leave before the ranking."""
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    ranked = rows.join(several, keys, "left_semi").withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("occurrence > 1")


def dangling(rows: DataFrame, target: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose non-null reference names nothing in the target."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def registry(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(dst, referrers, n): unresolved targets with the sorted distinct sources that name them. edges: src, dst; known: dst."""
    broken = edges.join(known.select("dst").distinct(), "dst", "left_anti").distinct()
    return broken.groupBy("dst").agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("referrers"), F.count(F.lit(1)).alias("n"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of only one of two one-column sets, with the side that has them."""
    name = left.columns[0]
    right = right.toDF(name)
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def same_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two tables do not have equally often; empty for a lossless rewrite."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def checksum_status(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """(key, status): ok, missing (no live content), absent (no stored sha256) or mismatch. stored: key, sha256; live: key, content."""
    actual = live.select(key, F.sha2(F.col("content").cast("binary"), 256).alias("_actual"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("sha256").isNull(), "absent").when(F.col("sha256") != F.col("_actual"), "mismatch").otherwise("ok")
    return stored.join(actual, key, "left").select(key, state.alias("status"))


def flag_status(flags: Column, local: Column, remote: Column) -> Column:
    """What is wrong with a two-bit flag: bit 0 says local, bit 1 says remote. Null where all is right."""
    want = F.when(local, 1).otherwise(0) + F.when(remote, 2).otherwise(0)
    bits = F.concat_ws("; ", F.when(flags.bitwiseAND(1) != want.bitwiseAND(1), "local bit"), F.when(flags.bitwiseAND(2) != want.bitwiseAND(2), "remote bit"))
    return F.when(flags.isNull(), "missing").when(~flags.between(0, 3), "out of range").when(flags != want, bits)


def leaves_of(document) -> Iterator[tuple[str, str]]:
    """(path, string) of a parsed document in order: keys by code point, list items by number. However deep, as the way lies on a stack of its own."""
    stack = [("$", document)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, str):
            yield path, value
        elif isinstance(value, dict):
            stack += [(f"{path}.{k}", value[k]) for k in sorted(value, reverse=True)]
        elif isinstance(value, list):
            stack += [(f"{path}[{k}]", value[k]) for k in range(len(value) - 1, -1, -1)]


def walk_places(rows: DataFrame, key: str, body: str, holding: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, leaf, place) for every string in a VARIANT body, however deep and however many; place numbers the strings of a body in order.

    With ``holding`` only strings that hold one of these are given. They must read the same in JSON: no quotes, backslashes or control characters.

    One narrow pass in batches: every body is parsed once, and nothing is stored between levels.
    """
    names = [key, "path", "leaf", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, text in enumerate(batch.column("_json").to_pylist()):
                if text is None or holding and not any(h in text for h in holding):
                    continue
                found = [(*x, n) for n, x in enumerate(leaves_of(json.loads(text))) if not holding or any(h in x[1] for h in holding)]
                of += [k] * len(found)
                out += found
            path, leaf, place = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of, pa.int64())), pa.array(path, pa.string()), pa.array(leaf, pa.string()), pa.array(place, pa.int64())], names)

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("path", T.StringType()), T.StructField("leaf", T.StringType()), T.StructField("place", T.LongType())])
    return rows.select(key, F.to_json(body).alias("_json")).mapInArrow(run, schema)


def walk_strings(rows: DataFrame, key: str, body: str, holding: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, leaf) for every string in a VARIANT body, or for those that hold one of these."""
    return walk_places(rows, key, body, holding).drop("place")


def walk_text(rows: DataFrame, key: str, body: str, taken: Callable[[str], bool]) -> DataFrame:
    """(key, text): the strings of a VARIANT body at the paths that are taken, in order and one a line; no row for a body without. Nothing leaves the body's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = functools.lru_cache(1 << 14)(taken)  # bodies are alike in their paths
        for batch in batches:
            of, out = [], []
            for k, text in enumerate(batch.column("_json").to_pylist()):
                found = [] if text is None else [leaf for path, leaf in leaves_of(json.loads(text)) if wanted(path)]
                if found:
                    of.append(k)
                    out.append("\n".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of, pa.int64())), pa.array(out, pa.string())], [key, "text"])

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("text", T.StringType())])
    return rows.select(key, F.to_json(body).alias("_json")).mapInArrow(run, schema)


def cross_references(ids: DataFrame, refs: DataFrame) -> DataFrame:
    """References to ids that no section of the same path has. ids: path, id; refs: path, section, idx, field, ref."""
    return refs.join(ids.select("path", F.col("id").alias("ref")).distinct(), ["path", "ref"], "left_anti")
