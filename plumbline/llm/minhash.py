"""Near-duplicate groups by one-permutation MinHash, bands and star edges.

A document's set is its distinct shingles of ``width`` words (two by
default). One permutation hashes them into 128 bins whose minima are the
signature; empty bins are filled by optimal densification (each probes bins in
a pseudo-random order of its own until a filled one is met). 32 bands of 4 bins
name buckets. Documents with equal sets are folded into one representative
before any bucket is formed, so a group of copies costs one row.

In a bucket every member has one edge to the bucket's hub, its smallest id,
so the number of candidates is that of the members. Candidates are confirmed
on the full sets. A star can miss a link between two members that are both
unlike the hub. What the stars leave open in buckets that still hold different
groups is settled exactly: blocks of the members of a bucket are compared with each other
on full sets, skipping pairs of one group, so that only the members of buckets
that stay mixed cost more than their number.

Shingles are told apart by 64-bit hashes modulo a 61-bit prime; two given
different shingles agree with a chance of about 2**-50.

Defined results: a text without words has an empty set, is linked with
nothing and stays; one word is a set of one; a null doc_id is in the group of
its equals and stays; repeated rows are equal documents; an empty table gives
no rows; further columns, of any name, are not looked at, or pass through
``drop_duplicates`` untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
PERCENT = 80
#: Members of a block; what the stars leave open is compared block by block.
CROWD = 512
_U = np.uint64
_EDGES = np.arange(BINS, dtype=_U) << _U(57)
_PROBES = 1024
_BAND_SALT = K.mix64(np.arange(1, BANDS + 1, dtype=_U) * _U(0xA24BAED4963EE407))


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (K.mix64(bins.astype(_U) * _U(_PROBES) + _U(attempt)) >> _U(57)).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct shingle keys of each text of a slice; of a text with fewer words the whole sequence is one."""
    words = K.find_words(data, offsets, K.SPACED)
    hashes = K.segment_hashes(data, words.starts, words.ends, K.FOLDED_BYTES)
    runs = K.grams(hashes, width)
    first = words.first
    for k in range(len(offsets) - 1):
        a, b = first[k], first[k + 1]
        if b == a:
            yield hashes[:0]
        elif b - a < width:
            yield K.mix64(K.grams(hashes[a:b], int(b - a)) + _U(1))
        else:
            yield K.distinct(runs[a : b - width + 1])


def signature(keys: np.ndarray) -> np.ndarray:
    """128 bin minima of a sorted non-empty set, densified."""
    at = np.searchsorted(keys, _EDGES)
    filled = at < np.append(at[1:], len(keys))
    sig = np.zeros(BINS, _U)
    sig[filled] = keys[at[filled]]
    empty = np.flatnonzero(~filled)
    for attempt in range(_PROBES):
        if not len(empty):
            break
        to = _probe(empty, attempt)
        ok = filled[to]
        sig[empty[ok]] = sig[to[ok]]
        empty = empty[~ok]
    if len(empty):
        sig[empty] = keys[0]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = _BAND_SALT.copy()
    for k in range(ROWS):
        out = K.mix64(out ^ rows[:, k])
    return out


@K.frees
def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch.column("text")):
            n, a, b, keys = [], [], [], []
            for s in shingle_sets(data, offsets, width):
                n.append(len(s))
                a.append(int(K.mix64(s).sum(dtype=_U).view(np.int64)) if len(s) else 0)
                b.append(int(K.mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)) if len(s) else 0)
                keys.append(bands(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), flat], schema=schema)


@K.frees
def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch.column("text")):
            sets = [s.tobytes() for s in shingle_sets(data, offsets, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "keys"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if PERCENT * large > 100 * small:
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= PERCENT * (small + large - common)


@K.frees
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ka, kb = batch.column("ka"), batch.column("kb")
        ok = [_alike(np.frombuffer(ka[i].as_buffer(), _U), np.frombuffer(kb[i].as_buffer(), _U)) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose full sets are alike."""
    a = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    b = sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    return edges.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ka", "kb").mapInArrow(_confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), for every id in a link.

    Labels fall to the smallest of the neighbours and then jump along
    themselves, so long chains take few rounds. Each round is written to the
    shared folder; only a count comes to the driver.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label")
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = lower.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = materialize(lower.join(top, "label", "left").select("id", "old", F.least("label", "jump").alias("label")), "labels")
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def _settle(table: pa.Table) -> pa.Table:
    """Links between groups among the members of one or two blocks of a bucket, by full sets."""
    ids, comp, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
    _, once = np.unique(ids, return_index=True)
    ids, comp, block = ids[once], comp[once], block[once]
    column = table.column("keys")
    sets = [np.frombuffer(column[int(k)].as_buffer(), _U) for k in once]
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    within = len(set(block.tolist())) == 1
    out: list[tuple[int, int]] = []
    for i in range(len(ids)):
        for j in range(i):
            if (within or block[i] != block[j]) and (x := find(int(comp[i]))) != (y := find(int(comp[j]))) and _alike(sets[i], sets[j]):
                root[x] = y
                out.append((int(ids[i]), int(ids[j])))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def between(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of members of a bucket that are of different groups, block against block. members: bucket, id, component."""
    size = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("blocks"))
    rows = members.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    rows = rows.withColumn("pair", F.explode(pairs)).join(sets, "id").select("bucket", "pair", "block", "id", "component", "keys")
    return rows.groupBy("bucket", "pair").applyInArrow(_settle, "a long, b long")


class Groups:
    """The component of each id, as a chain of tables: each after the first says which components have since become one."""

    def __init__(self, links: DataFrame):
        self.tables = [components(links)]

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the component of a column's ids as ``name``; an id without a link is its own."""
        df = df.withColumn(name, F.col(column))
        for t in self.tables:
            g = t.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
            df = df.join(g, df[name] == F.col("_id"), "left").withColumn(name, F.coalesce("_component", name)).drop("_id", "_component")
        return df

    def merge(self, links: DataFrame) -> bool:
        """Takes in further links; only the components they connect are looked at. Whether any were apart."""
        ends = self.of(self.of(links, "a", "ga"), "b", "gb").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
        ends = materialize(ends, "links")
        if not ends.limit(1).count():
            return False
        self.tables.append(components(ends))
        return True


def duplicate_groups(docs: DataFrame, width: int = 2) -> DataFrame:
    """Per document n_shingles, component_id and kept."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = materialize(texts.mapInArrow(functools.partial(_signatures, width=width), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    reps = sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    banded = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(banded.join(hubs, "bucket").select("bucket", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "size"), "members")
    near = F.expr(f"100 * least(n, hub_n) >= {PERCENT} * greatest(n, hub_n)")
    stars = members.where("id <> hub").where(near).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    crowds = members.where("size > 2")
    wanted = stars.select("a").union(stars.select("b")).union(crowds.select("id")).distinct().withColumnRenamed("a", "wanted")
    sets = materialize(texts.join(wanted, texts["doc_id"] == wanted["wanted"], "left_semi").mapInArrow(functools.partial(_full_sets, width=width), "id long, keys binary").dropDuplicates(["id"]), "sets")
    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    groups = Groups(materialize(confirm(first, sets), "links"))
    rest = groups.of(groups.of(stars.join(first, ["a", "b"], "left_anti"), "a", "ga"), "b", "gb").where("ga <> gb")
    groups.merge(materialize(confirm(rest, sets), "links"))
    open_ = groups.of(crowds.select("bucket", "id"), "id", "component")
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_ = open_.join(mixed, "bucket")
    groups.merge(materialize(between(open_.select("bucket", "id", "component"), sets), "links"))
    rep_of = groups.of(reps.select(*same, "rep"), "rep", "component_id")
    out = sigs.join(rep_of, same, "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id").eqNullSafe(found) | F.col("doc_id").isNull()).alias("kept"))


def drop_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest id."""
    names = docs.columns
    doc_id = f"c{names.index('doc_id')}"
    gone = duplicate_groups(docs, width).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return own.join(gone, own[doc_id] == gone["gone"], "left_anti").toDF(*names)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1]) END) AS g FROM d
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
