"""Hard negatives by a pivot table.

Every row gets one more component, sqrt(M2 - |x|^2) with M2 the largest squared
norm, and an anchor gets 0: then |a - x|^2 = |a|^2 + M2 - 2 a.x, so a larger
inner product is a smaller distance. The distances of all rows to a few pivots
are stored. By the triangle inequality those of an anchor and of a row bracket
their distance, hence their score, from both sides; only rows whose bracket
allows an answer are scored exactly, in whole numbers.

Rows lie in groups of blocks: a block holds rows of like labels near one pivot,
so that the extremes of its pivot distances may rule it out as a whole. Anchors are
the stated query set; their blocks go to every group and stream past it one at
a time. A task holds one group (``GROUP_ROWS`` rows) and one block of anchors;
it returns at most the wanted number of rows of each anchor, which are merged
by ranking. The first pass finds the positives, the second, with their scores
as bounds, the negatives.

Defined results: rows with a null label, a null vector or a component that is
null or not finite take no part; shorter vectors count as if nought followed;
an empty vector scores 0 with all; ties go to the smaller vec_id, a null one
last; an anchor's other rows are those of another vec_id; an anchor row that is
repeated returns its rows as often; scores are exact, and those beyond a long
stop at its ends; an anchor without positives or without negatives in the range
gives no rows; an empty table gives none; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

PIVOTS = 16
#: Rows among which the pivots are chosen, each as far from the others as may be.
PIVOT_SAMPLE = 512
BLOCK_ROWS = 1024
ANCHOR_ROWS = 256
GROUP_ROWS = 1 << 16
POSITIVES, NEGATIVES = 5, 5
#: Below this squared norm sums of products are exact in doubles.
EXACT = float(1 << 53)
#: What rounding may take from a distance, as a share.
SLACK = 1e-12
#: Components beyond this count as this, so that squares stay finite.
LARGEST = 1e140
_LONG = (1 << 63) - 1
_NONE = np.iinfo(np.int64).max  # stands for a null id

#: A block as a row: 0 of rows or 1 of anchors, its group and least row number, and its arrays.
BLOCK = "kind int, group long, place long, ids binary, rows binary, labels binary, vectors binary, distances binary, bounds binary"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q, the components as floor(256 x) in doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # floor gives a long, which very large components do not fit; those have no fraction
    q = F.transform(x, lambda v: F.when(F.abs(v) < 1e15, F.floor(v * 256).cast("double")).otherwise(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)) * 256))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), q.alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width, with noughts after the shorter."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _square(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def pivot_distances(m: np.ndarray, squares: np.ndarray, pivots: np.ndarray, largest: float, augmented: bool) -> np.ndarray:
    """Distances of rows, or of anchors (not augmented), to pivots; the last component of a pivot is its added one."""
    more = np.sqrt(np.maximum(largest - squares, 0)) if augmented else np.zeros(len(m))
    d2 = squares[:, None] + _square(pivots[:, :-1])[None, :] - 2 * (m @ pivots[:, :-1].T) + (more[:, None] - pivots[None, :, -1]) ** 2
    return np.sqrt(np.maximum(d2, 0))


def farthest(m: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the rows, each the farthest from those before it."""
    if not len(m):
        return m
    taken = [0]
    near = _square(m - m[0])
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _square(m - m[taken[-1]]))
    return m[taken]


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number inner products of two lists of rows that stand opposite each other."""
    if exact:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    whole = lambda r: [int(x) for x in r.tolist()]
    return np.array([max(-_LONG, min(_LONG, sum(x * y for x, y in zip(whole(r), whole(s))))) for r, s in zip(a, b)], np.int64)


class _Space:
    """What all tasks know: the width, the largest squared norm, the pivots."""

    def __init__(self, width: int, largest: float, pivots: np.ndarray):
        self.width, self.largest, self.pivots = width, largest, pivots
        self.exact = largest < EXACT
        # distances carry an error of about the root of that of their squares
        self.slack = 2 * math.sqrt(4 * largest * SLACK) if largest else 0.0

    def distances(self, m: np.ndarray, augmented: bool) -> np.ndarray:
        return pivot_distances(m, _square(m), self.pivots, self.largest, augmented)


def _space(rows: DataFrame) -> tuple[_Space, int] | None:
    """The space and the number of rows; one row of figures and a bounded sample of vectors come to the driver."""
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    n, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).first()
    if not n:
        return None
    sample = rows.select("q").orderBy(F.xxhash64("vec_id", "q")).limit(PIVOT_SAMPLE).collect()
    m = np.zeros((len(sample), width + 1))
    for k, r in enumerate(sample):
        m[k, : len(r["q"])] = r["q"]
    m[:, -1] = np.sqrt(np.maximum(largest - _square(m[:, :-1]), 0))
    return _Space(width, float(largest), farthest(m, PIVOTS)), n


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _packed(space: _Space, size: int, kind: int):
    """Blocks of at most ``size`` rows of a batch and group, in order of label and nearest pivot; the pivot distances of anchors are without the added component."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").fill_null(_NONE).to_numpy()
            row, label, group = (batch.column(c).to_numpy() for c in ("row", "label", "group"))
            m = _matrix(batch.column("q"), space.width)
            d = space.distances(m, kind == 0)
            order = np.lexsort((d.min(1), d.argmin(1), label, group))
            cuts = [0]
            while cuts[-1] < len(order):
                inside = group[order[cuts[-1] : cuts[-1] + size]]
                cuts.append(cuts[-1] + int((inside == inside[0]).sum()))
            out = []
            for a, b in zip(cuts, cuts[1:]):
                o = order[a:b]
                o = o[np.argsort(ids[o], kind="stable")]  # so that ties are met in order of ids
                out.append((kind, int(group[o[0]]), int(row[o].min()), *map(_blob, (ids[o], row[o], label[o], m[o], d[o], np.stack([d[o].min(0), d[o].max(0)])))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], _NAMES)

    return pack


class _Block:
    def __init__(self, batch: pa.RecordBatch, k: int, space: _Space):
        get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_py(), kind)
        self.ids, self.rows, self.labels = get("ids", np.int64), get("rows", np.int64), get("labels", np.int64)
        n = len(self.ids)
        self.vectors = get("vectors", np.float64).reshape(n, space.width)
        self.distances = get("distances", np.float64).reshape(n, len(space.pivots))
        self.low, self.high = get("bounds", np.float64).reshape(2, -1)


def brackets(anchors: np.ndarray, near: np.ndarray, far: np.ndarray, squares: np.ndarray, space: _Space) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors (their pivot distances, a row each) with rows whose pivot distances lie from near to far."""
    least = np.zeros((len(anchors), len(near)))
    most = np.full((len(anchors), len(near)), np.inf)
    for p in range(anchors.shape[1]):
        a = anchors[:, p, None]
        np.maximum(least, np.maximum(near[None, :, p] - a, a - far[None, :, p]), out=least)
        np.minimum(most, a + far[None, :, p], out=most)
    least = np.maximum(least - space.slack, 0)
    most += space.slack
    base = squares[:, None] + space.largest
    return (base - most**2) / 2 - 1, (base - least**2) / 2 + 1


class _Best:
    """The best so far of each query: (query, score, id), at most ``keep`` a query."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.floor = keep, np.full(queries, -np.inf)
        self.q, self.s, self.i = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.append(self.q, q), np.append(self.s, s), np.append(self.i, i)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.keep
        last = rank == self.keep - 1
        self.floor[q[last]] = s[last]
        self.q, self.s, self.i = q[top], s[top], i[top]


#: A tile whose brackets leave more than this share open is scored as one matrix product.
DENSE = 1 / 16


def _scored(a: _Block, x: _Block, open_: np.ndarray, exact: bool) -> np.ndarray:
    """The exact scores of the pairs left open; the least number elsewhere."""
    out = np.full(open_.shape, -_LONG - 1)
    if exact and open_.mean() > DENSE:
        return np.where(open_, (a.vectors @ x.vectors.T).astype(np.int64), out)
    i, j = np.nonzero(open_)
    for lo in range(0, len(i), 1 << 15):
        p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        out[p, q] = scores(a.vectors[p], x.vectors[q], exact)
    return out


def _tops(s: np.ndarray, keep: int) -> np.ndarray:
    """Of each row the places of its ``keep`` greatest numbers, the first of equal ones; the least number is never taken."""
    some = s > -_LONG - 1
    if s.shape[1] <= keep:
        return some
    last = np.partition(s, -keep, axis=1)[:, -keep, None]
    above, equal = s > last, (s == last) & some
    return above | (equal & (np.cumsum(equal, 1) <= keep - above.sum(1, keepdims=True)))


class _Queries:
    """What is asked of a block of anchors: of each query its anchor's place, and the positive that bounds it."""

    def __init__(self, of: np.ndarray, number: np.ndarray, ids: np.ndarray, points: np.ndarray, second: bool):
        self.of, self.number, self.ids, self.points, self.second = of, number, ids, points, second
        n = len(of)
        if second:
            self.top = points
            self.bottom = np.array([-(-4 * p // 5) for p in points.tolist()], np.int64)  # 80 positive <= 100 negative
            self.best = _Best(n, NEGATIVES)
        else:
            self.top, self.bottom, self.best = np.full(n, _LONG), np.full(n, -_LONG), _Best(n, POSITIVES)

    def wanted(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of queries and columns, where the bracket of the query's anchor allows an answer."""
        floor = np.maximum(self.bottom.astype(float), self.best.floor)
        return (most[self.of] >= floor[:, None]) & (least[self.of] <= self.top.astype(float)[:, None])


def _answer(a: _Block, asked: _Queries, held: list[_Block], space: _Space) -> pa.RecordBatch:
    """The best rows of one group for each query: of the anchor's own label, or of others between the bounds that the positive sets."""
    squares = _square(a.vectors)
    least, most = brackets(a.distances, np.array([x.low for x in held]), np.array([x.high for x in held]), squares, space)
    for k in np.argsort(-most.max(0, initial=-np.inf)).tolist():  # the most promising block first
        x = held[k]
        same = a.labels[:, None] == x.labels[None, :]
        fits = ~same if asked.second else same
        ask = np.flatnonzero(fits.any(1)[asked.of] & asked.wanted(least[:, [k]], most[:, [k]])[:, 0])
        if not len(ask):
            continue
        wanted = asked.wanted(*brackets(a.distances, x.distances, x.distances, squares, space))[ask]
        open_ = np.zeros(same.shape, bool)
        np.logical_or.at(open_, asked.of[ask], wanted)
        exact = _scored(a, x, open_ & fits & (a.ids[:, None] != x.ids[None, :]), space.exact)
        s = exact[asked.of[ask]]
        s[(s < asked.bottom[ask, None]) | (s > asked.top[ask, None])] = -_LONG - 1
        q, j = np.nonzero(_tops(s, asked.best.keep))
        asked.best.add(ask[q], s[q, j], x.ids[j])
    best = asked.best
    q, w = best.q, asked.of[best.q]
    cols = [a.rows[w], a.ids[w], asked.number[q], asked.ids[q], asked.points[q], best.i, best.s]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _FOUND)


_FOUND = ["anchor_row", "anchor_id", "number", "positive_id", "positive_score", "id", "score"]


def _search(space: _Space, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Block] = []
        group = None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("group")[k].as_py() != group:
                    group, held = batch.column("group")[k].as_py(), []
                block = _Block(batch, k, space)
                if batch.column("kind")[k].as_py() == 0:
                    held.append(block)
                elif held:
                    n = len(block.ids)
                    asked = [np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in QUERY] if second else [np.arange(n), *np.zeros((3, n), np.int64)]
                    yield _answer(block, _Queries(*asked, second), held, space)

    return run


def _ranked(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The best of what the groups found, with rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


#: Of the queries of a block of anchors: the anchor's place in it, the number, id and score of the positive.
QUERY = ["query_of", "query_number", "query_ids", "query_scores"]


def _anchor_blocks(space: _Space):
    """Blocks of anchors with the positives found for them."""
    pack = _packed(space, ANCHOR_ROWS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ANCHOR_ROWS):
                part = batch.slice(lo, ANCHOR_ROWS)
                (block,) = pack(iter([part]))
                place = {r: k for k, r in enumerate(np.frombuffer(block.column("rows")[0].as_py(), np.int64).tolist())}
                asked = [(place[r], k, _NONE if p["id"] is None else p["id"], p["score"]) for r, found in zip(part.column("row").to_pylist(), part.column("positives").to_pylist()) for k, p in enumerate(found or ())]
                columns = zip(*asked) if asked else [()] * len(QUERY)
                more = [pa.array([_blob(np.array(c, np.int64))], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([*block.columns, *more], [*_NAMES, *QUERY])

    return run


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, of the anchors whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = storage.with_row_ids(storage.materialize(quantised(vectors), "vectors"), "row")
    found = _space(rows)
    if found is None:
        return spark.createDataFrame([], result)
    space, n = found
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-n // GROUP_ROWS))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).repartition(groups, "group").sortWithinPartitions("group", "row")
    blocks = storage.materialize(dealt.mapInArrow(_packed(space, BLOCK_ROWS, 0), BLOCK), "blocks")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("group", F.lit(0).cast("long"))

    def search(queries: DataFrame, second: bool) -> DataFrame:
        gathered = queries.repartitionByRange(F.col("row")).mapInArrow(_anchor_blocks(space), ", ".join([BLOCK, *(f"{c} binary" for c in QUERY)]))
        sent = storage.materialize(gathered, "anchors").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        both = blocks.unionByName(sent, allowMissingColumns=True)
        return both.repartition(groups, "group").sortWithinPartitions("group", "kind", "place").mapInArrow(_search(space, second), ", ".join(f"{c} long" for c in _FOUND))

    first = search(anchors.withColumn("positives", F.expr("cast(null as array<struct<id: bigint, score: bigint>>)")), False)
    best = _ranked(first, ["anchor_row"], POSITIVES).groupBy("anchor_row").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    second = search(anchors.join(best, anchors["row"] == best["anchor_row"]).drop("anchor_row"), True)
    out = _ranked(second, ["anchor_row", "number"], NEGATIVES)
    no = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return out.select("anchor_id", no("positive_id").alias("positive_id"), F.col("rank").cast("int"), no("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k
  FROM s WHERE label = own QUALIFY k <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND s.label <> s.own AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
