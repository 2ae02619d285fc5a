"""Bit hashes, Hamming distance, nearest baselines, greedy near-duplicate removal."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from .verbatim import blocks

BITS = 64
#: Flipped values of one hash, all blocks together.
PROBES = 1 << 13
#: Above this share of all pairs, meeting on blocks costs more than comparing all.
MEETING_SHARE = 1 / 256
#: Hashes of a group, of which two are compared in one step of a task.
GROUP = 1 << 14
#: Hashes that a step of the walk settles in one task.
HEAD = 1 << 15
#: Pairs compared at once, and pairs in a batch of results.
AT_ONCE = 1 << 16


def mean_bits(values: Column) -> Column:
    """One character a value, 1 where it lies above the mean of all."""
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(values))
    bits = lambda m: F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > m, "1").otherwise("0")), "")
    return F.transform(F.array(mean), bits)[0]  # the mean is taken once for a row, not for each value


def as_long(bits: Column) -> Column:
    """64 characters as a signed 64-bit number, first character highest."""
    half = lambda a: F.conv(F.substring(bits, a, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def plan_blocks(most: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the blocks on which hashes at most so many bits apart meet.

    If every block differed by more than its radius, the hashes would by more than ``most``: the radii and one
    for each block make up most + 1. Of the cuts whose balls of flipped bits hold at most ``PROBES`` values together, the widest.
    """
    for n in range(1, most + 2):
        cuts = [BITS * k // n for k in range(n + 1)]
        each, more = divmod(most + 1 - n, n)
        widest = sorted(range(n), key=lambda k: cuts[k] - cuts[k + 1])
        plan = [(cuts[k], cuts[k + 1] - cuts[k], each + (k in widest[:more])) for k in range(n)]
        if sum(math.comb(w, i) for _, w, r in plan for i in range(r + 1)) <= PROBES:
            return plan
    raise ValueError("most must be below the number of bits")


def _block(h: Column, a: int, w: int) -> Column:
    return h if w == BITS else F.shiftrightunsigned(h, BITS - a - w).bitwiseAND(F.lit((1 << w) - 1))


def _flips(width: int, radius: int) -> list[int]:
    signed = lambda b: -(1 << b) if b == BITS - 1 else 1 << b
    return [sum(map(signed, bits)) for i in range(radius + 1) for bits in itertools.combinations(range(width), i)]


def _meetings(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(x.id, x.h, y.id, y.h, k) of hashes whose block k differs by at most its radius; the left side's values are flipped. Both: id, bits."""
    plan = plan_blocks(most)
    spark = left.sparkSession
    masks = F.broadcast(spark.createDataFrame([(k, m) for k, (_, w, r) in enumerate(plan) for m in _flips(w, r)], "k int, flip long"))  # at most PROBES rows
    keyed = lambda df: df.select("id", as_long(F.col("bits")).alias("h")).select("id", "h", F.posexplode(F.array(*[_block(F.col("h"), a, w) for a, w, _ in plan])).alias("k", "block"))
    x = keyed(left).join(masks, "k").select("id", "h", "k", F.col("block").bitwiseXOR(F.col("flip")).alias("block")).alias("x")
    return x.join(keyed(right).alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.block") == F.col("y.block")))


def _met_once(most: int) -> Column:
    """Of the blocks on which two hashes meet, the first alone counts."""
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    near = [F.bit_count(_block(differ, a, w)) <= r for a, w, r in plan_blocks(most)]
    first = F.lit(len(near))
    for k in reversed(range(len(near))):
        first = F.when(near[k], k).otherwise(first)
    return first == F.col("x.k")


def _share(most: int) -> float:
    """Of random pairs, those that meet."""
    return sum(math.comb(w, i) / 2**w for _, w, r in plan_blocks(most) for i in range(r + 1))


def _grouped(hashes: DataFrame) -> DataFrame:
    """(part, held) with the (id, h) of about ``GROUP`` hashes in a row, stored; null ids and bits are near to nothing."""
    rows = written(hashes.select("id", as_long(F.col("bits")).alias("h")).where("id is not null and h is not null"), "hashes")
    n = max(1, math.ceil(rows.count() / GROUP))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("part")).agg(F.collect_list(F.struct("id", "h")).alias("held"))
    return written(held, "groups")


def _side_by_side(x: DataFrame, y: DataFrame | None, fn, schema: str) -> DataFrame:
    """What ``fn`` gives for groups of the hashes of x beside groups of those of y, every two groups in one row; without y of those of x, each two once."""
    left = _grouped(x)
    right = left if y is None else _grouped(y)
    parts = left.select(F.col("part").alias("i")).crossJoin(right.select(F.col("part").alias("j")))
    if y is None:
        parts = parts.where("i <= j")
    both = parts.join(left.select(F.col("part").alias("i"), F.col("held").alias("x")), "i").join(right.select(F.col("part").alias("j"), F.col("held").alias("y")), "j")
    return both.repartition("i", "j").mapInArrow(fn, schema)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(i, ids and hashes of x, j, ids and hashes of y) of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            i, j = (batch.column(c)[k].as_py() for c in ("i", "j"))
            x, y = (batch.column(c)[k].values for c in ("x", "y"))
            yield (i, x.field("id"), _bits_of(x), j, y.field("id"), _bits_of(y))


def _bits_of(held: pa.StructArray) -> np.ndarray:
    return held.field("h").to_numpy().view(np.uint64)


def _near(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in x, place in y, distance) of hashes at most so many bits apart, from bands of about ``AT_ONCE`` pairs in the same memory."""
    step = max(1, AT_ONCE // max(1, len(y)))
    differ, dist, near = (np.empty((step, len(y)), t) for t in (np.uint64, np.uint8, np.bool_))
    for k in range(0, len(x), step):
        n = len(x[k : k + step])
        np.bitwise_xor(x[k : k + step, None], y, out=differ[:n])
        np.bitwise_count(differ[:n], out=dist[:n])
        np.less_equal(dist[:n], most, out=near[:n])
        at = np.flatnonzero(near[:n])
        yield k + at // len(y), at % len(y), dist[:n].ravel()[at]


def _pairs_of(most: int, within: bool):
    """A function over batches that gives the pairs of two groups; within one set the lower id comes first and none is its own neighbour."""

    def batch_of(found: list[tuple], xi: pa.Array, yi: pa.Array) -> pa.RecordBatch:
        i, j, d = (np.concatenate(c) for c in zip(*found))
        a, b, d = xi.take(pa.array(i)), yi.take(pa.array(j)), pa.array(d.astype(np.int32))
        if within:
            a, b, d = (c.filter(pc.not_equal(a, b)) for c in (a, b, d))
            low = pc.less(a, b)
            a, b = pc.if_else(low, a, b), pc.if_else(low, b, a)
        return pa.RecordBatch.from_arrays([a, b, d], ["a", "b", "dist"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gi, xi, x, gj, yi, y in _sides(batches):
            found, n = [], 0
            for i, j, d in _near(x, y, most):
                if within and gi == gj:
                    once = i < j
                    i, j, d = i[once], j[once], d[once]
                if len(i):
                    found.append((i, j, d))
                    n += len(i)
                if n >= AT_ONCE:
                    yield batch_of(found, xi, yi)
                    found, n = [], 0
            if found:
                yield batch_of(found, xi, yi)

    return fn


def _pair_schema(hashes: DataFrame) -> str:
    t = hashes.schema["id"].dataType.simpleString()
    return f"a {t}, b {t}, dist int"


def close_pairs(hashes: DataFrame, most: int) -> DataFrame:
    """(a, b, dist) of pairs a < b at most so many bits apart. hashes: id, bits.

    Within a small radius pairs meet on a few wide blocks, of which one side's values are flipped, and the distance confirms. Where that
    would bring together more than ``MEETING_SHARE`` of all pairs (7 % at 16 of 64 bits), groups of hashes are compared side by side instead:
    that is all pairs, some nanoseconds each, two groups at a time in memory.
    """
    if _share(most) > MEETING_SHARE:
        return _side_by_side(hashes, None, _pairs_of(most, True), _pair_schema(hashes))
    met = _meetings(hashes, hashes, most).where(F.col("x.id") < F.col("y.id"))
    return met.withColumn("dist", hamming(F.col("x.h"), F.col("y.h"))).where((F.col("dist") <= most) & _met_once(most)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "dist")


def nearest(items: DataFrame, baselines: DataFrame, most: int) -> DataFrame:
    """Each item with its nearest baseline within so many bits; the first listed wins ties. items: id, bits; baselines: ord, identity, bits.

    Baselines are a stated set; every item is compared with each of them, a
    bounded block of them at a time.
    """
    base = baselines.select("ord", "identity", as_long(F.col("bits")).alias("bh"))
    each = items.select("id", as_long(F.col("bits")).alias("h"))
    found = None
    for part in blocks(base, "ord"):
        near = each.join(part, hamming(F.col("h"), F.col("bh")) <= most)
        found = near if found is None else found.union(near)
    if found is None:
        return items.select("id", F.lit(None).cast("string").alias("identity"), F.lit(None).cast("int").alias("dist"))
    best = found.groupBy("id").agg(F.min(F.struct(hamming(F.col("h"), F.col("bh")).alias("dist"), "ord", "identity")).alias("b"))
    return items.select("id").join(best, "id", "left").select("id", F.col("b.identity").alias("identity"), F.col("b.dist").alias("dist"))


def greedy_keep(ids: DataFrame, pairs: DataFrame, write) -> DataFrame:
    """(id, kept) of the filter that walks the ids in order and drops one that is near to a kept one before it. pairs: a < b.

    The walk need not be serial: an id all of whose earlier neighbours are
    dropped is kept, one with a kept earlier neighbour is dropped; each round
    settles all ids that can be. ``write`` stores a round's table.
    """
    state = write(ids.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(F.max(F.coalesce("ka", F.lit(False)).cast("int")).alias("some"), F.max(F.col("ka").isNull().cast("int")).alias("open"))
        settled = F.when(F.col("some") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = write(state.join(before, state["id"] == before["b"], "left").select("id", F.coalesce("kept", settled).alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state


def _ids_near(most: int):
    """A function over batches that gives the ids of x that are near to something of y."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, _, _, y in _sides(batches):
            near, at = np.zeros(len(x), np.bool_), np.arange(len(x))
            for h in y:  # what is near needs no further comparison
                far = np.bitwise_count(x ^ h) > most
                if not far.all():
                    near[at[~far]] = True
                    x, at = x[far], at[far]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(near))], ["id"])

    return fn


def far_from(hashes: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """The hashes more than so many bits from all of the others; null bits are. Both: id, bits; ids of the first are not null where bits are not."""
    near = _side_by_side(hashes.select("id", "bits"), others.select("id", "bits"), _ids_near(most), f"id {hashes.schema['id'].dataType.simpleString()}")
    return hashes.join(near.distinct(), "id", "left_anti")


def _walked(most: int):
    """A function over the batches of one task that gives what the walk over them keeps."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("h", "ascending")])
            h, at, kept = rows.column("h").to_numpy().view(np.uint64), np.arange(rows.num_rows), []
            while len(h):
                kept.append(at[0])
                far = np.bitwise_count(h ^ h[0]) > most
                h, at = h[far], at[far]
            yield from rows.select(["id", "bits"]).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    return fn


def greedy_walk(hashes: DataFrame, most: int, write) -> DataFrame:
    """(id, bits) that the filter of ``greedy_keep`` keeps of hashes that are near at so many bits or less, without their pairs. hashes: id, bits.

    The first ``HEAD`` hashes of those left are walked in one task, and what is near to those it keeps leaves the rest, groups of the rest beside groups
    of them. So the comparisons are hashes times kept ones, and what is stored is never more than the hashes. Null ids and bits are near to nothing.
    """
    rows = write(hashes.select("id", "bits"))
    odd = F.col("id").isNull() | as_long(F.col("bits")).isNull()
    kept, left = rows.where(odd), rows.where(~odd)
    n = left.count()
    while n:
        head = left.orderBy("id").limit(HEAD).select("id", "bits", as_long(F.col("bits")).alias("h"))
        won = write(head.repartition(1).mapInArrow(_walked(most), left.schema))
        kept = kept.unionByName(won)
        if n <= HEAD:
            break
        left = write(far_from(left, won, most))
        n = left.count()
    return kept


# -- an index of crops that lives on: id, bits, identity (null until known)
def close_between(known: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """(a, b, dist) of a known and a fresh hash at most so many bits apart, found as in ``close_pairs``. Both: id, bits."""
    if _share(most) > MEETING_SHARE:
        return _side_by_side(known, fresh, _pairs_of(most, False), _pair_schema(known))
    met = _meetings(fresh, known, most).withColumn("dist", hamming(F.col("x.h"), F.col("y.h")))
    return met.where((F.col("dist") <= most) & _met_once(most)).select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), "dist")


def detect(index: DataFrame, batch: DataFrame, baselines: DataFrame, most: int, near: int, write) -> DataFrame:
    """The index after a batch of crops (id, bits): those that are near to nothing kept before them come in, with the identity of their nearest baseline.

    Ids of a batch follow those of the index, so batches one after the other give what one batch of all gives: what the
    index holds is kept, and only fresh crops near to none of it are walked.
    """
    fresh = write(greedy_walk(far_from(batch, index, most), most, write))
    named = fresh.join(nearest(fresh.select("id", "bits"), baselines, near).select("id", "identity"), "id").select("id", "bits", "identity")
    return write(index.select("id", "bits", "identity").unionByName(named))


def register(index: DataFrame, names: DataFrame) -> DataFrame:
    """The index with the identities that a contributor has given. names: id, identity."""
    return index.join(names.select("id", F.col("identity").alias("_given")), "id", "left").select("id", "bits", F.coalesce("_given", "identity").alias("identity"))


def prune(index: DataFrame, baselines: DataFrame, near: int) -> DataFrame:
    """The index without the crops that are near to no baseline; a crop's given identity does not save it, as its baseline would."""
    return index.join(nearest(index.select("id", "bits"), baselines, near).where("identity is not null").select("id"), "id", "left_semi").select("id", "bits", "identity")
