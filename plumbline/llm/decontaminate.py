"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of the benchmark items. A
block is two words. The shift table tells, for the block that ends at a text
position, how far the search may jump because no pattern can end any sooner;
where the shift is nought, the hash of the window's suffix block selects the
few patterns to compare, and a direct comparison of their bytes confirms.
Items shorter than a window are patterns of their own length; each length is
searched with its own tables.

The benchmark is cut into groups of at most ``group_words`` words, longer items
into pieces that overlap by a window less a word. One group is collected,
broadcast and searched for at a time and let go again, so neither the driver
nor a worker ever holds more than one group. With a single group the verdicts
come from one narrow pass; with more, each pass gives the hits of its group by
row, and the rows' hits are put together.

Defined results: a null or word-less text has no hits and is not
contaminated; a null or word-less item never occurs; repeated rows are judged
row by row; an empty documents table gives no rows, an empty benchmark none
contaminated; further columns, of any name, are not looked at, or pass through
``clean_documents`` untouched.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize, with_row_ids

WINDOW = 13
GROUP_WORDS = 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_HITS = "row long, spans array<int>, items array<string>"


class Text:
    """The words of one text: their keys, and their bytes where asked for."""

    __slots__ = ("raw", "starts", "ends", "keys")

    def __init__(self, raw: memoryview, starts: np.ndarray, ends: np.ndarray, keys: list[int]):
        self.raw, self.starts, self.ends, self.keys = raw, starts, ends, keys

    def joined(self, a: int, b: int) -> bytes:
        """The words from a to b, lower-cased, with one space between."""
        return b" ".join([bytes(self.raw[x:y]).lower() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())])


def _texts(column: pa.Array) -> Iterator[tuple[int, list[Text]]]:
    for lo, hi, data, offsets in K.slices(column):
        words = K.find_words(data, offsets, K.ALNUM)
        keys = K.segment_hashes(data, words.starts, words.ends, K.FOLDED_BYTES).view(np.int64)
        cut = [slice(words.first[k], words.first[k + 1]) for k in range(hi - lo)]
        raw = memoryview(data)
        yield lo, [Text(raw, words.starts[c], words.ends[c], keys[c].tolist()) for c in cut]


class Tables:
    """Shift table and suffix buckets of the patterns of one length; a bucket holds the patterns' bytes and who has them."""

    def __init__(self, width: int):
        self.width, self.block = width, min(2, width)
        self.longest = width - self.block + 1
        self.shift: dict[int, int] = {}
        self.suffix: dict[int, dict[bytes, list[str]]] = {}

    def add(self, item: str, text: Text, at: int) -> None:
        keys = text.keys[at : at + self.width]
        for end in range(self.block, self.width + 1):
            b = hash(tuple(keys[end - self.block : end]))
            self.shift[b] = min(self.width - end, self.shift.get(b, self.longest))
        who = self.suffix.setdefault(b, {}).setdefault(text.joined(at, at + self.width), [])
        if not who or who[-1] != item:
            who.append(item)

    def search(self, text: Text, hits: list[tuple[int, int, list[str]]]) -> None:
        """Adds (first word, word after the last, items) for every occurrence."""
        width, block, shift, longest, words = self.width, self.block, self.shift.get, self.longest, text.keys
        n, end = len(words), width
        while end <= n:
            b = hash(tuple(words[end - block : end]))
            s = shift(b, longest)
            if s:
                end += s
                continue
            bucket = self.suffix.get(b)
            if bucket:
                who = bucket.get(text.joined(end - width, end))  # compares bytes, whatever the keys were
                if who:
                    hits.append((end - width, end, who))
            end += 1


def build(pieces: list[tuple[str, str]], window: int = WINDOW) -> list[Tables]:
    """pieces: (item, text). One set of tables for each pattern length."""
    by: dict[int, Tables] = {}
    for item, raw in pieces:
        for _, (text,) in _texts(pa.array([raw], pa.string())):
            width = min(window, len(text.keys))
            for k in range(len(text.keys) - width + 1 if width else 0):
                by.setdefault(width, Tables(width)).add(item, text, k)
    return [by[w] for w in sorted(by)]


_BUILT: dict[str, list[Tables]] = {}


def _built(token: str, pieces: list[tuple[str, str]], window: int) -> list[Tables]:
    """The tables of one group, built once in each worker process; those of another group make way."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build(pieces, window)
    return _BUILT[token]


class Groups:
    """The benchmark in groups of a bounded number of words, in the shared folder."""

    def __init__(self, benchmark: DataFrame, group_words: int = GROUP_WORDS, window: int = WINDOW):
        self.spark, self.window = benchmark.sparkSession, window
        most = max(window, group_words // 4)
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Items of no more than ``most`` words as they are, longer ones cut so that every window is whole in a piece."""
            for batch in batches:
                out = []
                for lo, texts in _texts(batch.column("text")):
                    for k, t in enumerate(texts):
                        item = batch.column("item")[lo + k].as_py()
                        for a in range(0, max(1, len(t.keys) - window + 1), max(1, most - window + 1)):
                            b = min(len(t.keys), a + most)
                            if b > a:
                                out.append((item, t.joined(a, b).decode(), b - a))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], ["item", "text", "n"])

        cut = materialize(items.mapInArrow(pieces, "item string, text string, n long").distinct(), "pieces")
        total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # groups follow from running sums within hashed bins, never from partitions: a group begins every three quarters
        # of group_words, and no piece is longer than the last quarter
        bins = max(1, math.ceil(total / (8 * group_words)))
        before = F.sum("n").over(Window.partitionBy("bin").orderBy("item", "text")) - F.col("n")
        number = F.col("bin") * (1 << 32) + F.floor(before / max(1, group_words - most)).cast("long")
        self.pieces = materialize(cut.withColumn("bin", F.pmod(F.xxhash64("item", "text"), F.lit(bins))).select("item", "text", number.alias("group")), "benchmark")
        self.count = self.pieces.select("group").distinct().count()

    def each(self) -> Iterator[list[tuple[str, str]]]:
        """One group after the other; the number of a group is all the driver keeps of those to come."""
        last = None
        while True:
            left = self.pieces if last is None else self.pieces.where(F.col("group") > last)
            last = left.agg(F.min("group")).first()[0]
            if last is None:
                return
            yield sorted((r["item"], r["text"]) for r in self.pieces.where(F.col("group") == last).collect())


def _hits(text: Text, tables: list[Tables]) -> tuple[list[tuple[int, int]], set[str]]:
    hits: list[tuple[int, int, list[str]]] = []
    for t in tables:
        t.search(text, hits)
    return [(a, b) for a, b, _ in hits], {x for _, _, who in hits for x in who}


def _verdict(n: int, spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, int, str, bool]:
    n_hit = done = 0
    for a, b in sorted(spans):
        n_hit += max(0, b - max(a, done))
        done = max(done, b)
    return n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]


def _passes(rows: DataFrame, groups: Groups) -> DataFrame:
    """(row, spans, items) of the rows that hold windows of any group: one pass for each group, written before the next."""

    def run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        tables = build(shared.value, groups_window)
        for batch in batches:
            number, out = batch.column("row").to_pylist(), []
            for lo, texts in _texts(batch.column("text")):
                for k, t in enumerate(texts):
                    spans, items = _hits(t, tables)
                    if spans:
                        out.append((number[lo + k], [x for s in spans for x in s], sorted(items)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))], ["row", "spans", "items"])

    found, groups_window = None, groups.window
    for pieces in groups.each():
        shared = rows.sparkSession.sparkContext.broadcast(pieces)  # at most group_words words
        part = materialize(rows.select("row", "text").mapInArrow(functools.partial(run, shared=shared), _HITS), "hits")
        shared.destroy()
        found = part if found is None else found.union(part)
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _judged(rows: DataFrame, groups: Groups) -> DataFrame:
    """(row, doc_id and the verdict) from the hits of all groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column("text")):
                n = K.find_words(data, offsets, K.ALNUM).counts
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64())], ["row", "doc_id", "n"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, flat, items in zip(*(batch.column(c).to_pylist() for c in ("n", "spans", "items"))):
                flat = flat or []
                out.append(_verdict(n, list(zip(flat[::2], flat[1::2])), set(items or ())))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *_columns(out)], ["row", *[f.split()[0] for f in RESULT.split(", ")]])

    sized = rows.mapInArrow(count, "row long, doc_id long, n long")
    return sized.join(_passes(rows, groups), "row", "left").select("row", "doc_id", "n", "spans", "items").mapInArrow(judge, "row long, " + RESULT)


def _narrow(docs: DataFrame, text: str, groups: Groups, result, schema) -> DataFrame:
    """One pass with the only group: ``result`` makes the rows of a part of a batch and its verdicts."""
    shared = docs.sparkSession.sparkContext.broadcast(next(groups.each(), []))
    window, token = groups.window, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _built(token, shared.value, window)
        for batch in batches:
            for lo, texts in _texts(batch.column(text)):
                yield result(batch.slice(lo, len(texts)), [_verdict(len(t.keys), *_hits(t, tables)) for t in texts])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per document its words, hit words, occurring items and verdict."""
    groups = Groups(benchmark, group_words)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if groups.count > 1:
        return _judged(with_row_ids(docs, "row"), groups).drop("row")
    names = [f.split()[0] for f in RESULT.split(", ")]
    return _narrow(docs, "text", groups, lambda part, rows: pa.RecordBatch.from_arrays([part.column("doc_id"), *_columns(rows)], names), RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    groups, names = Groups(benchmark, group_words), docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index('text')}"
    if groups.count > 1:
        rows = with_row_ids(own, "row")
        plain = rows.select("row", F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        bad = _judged(plain, groups).where("contaminated").select("row")
        return rows.join(bad, "row", "left_anti").drop("row").toDF(*names)
    return _narrow(own, text, groups, lambda part, rows: part.filter(pa.array([not r[4] for r in rows], pa.bool_())), own.schema).toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
lens AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
pat AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
win AS (
  SELECT rid, i, k, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)
),
occ AS (SELECT rid, i, win.k AS k, item_id FROM win JOIN pat ON win.k = pat.k AND win.g = pat.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
