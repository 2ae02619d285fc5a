"""Removal of repeated byte strings with a sampled suffix array.

A byte is removed where a 200-byte string that covers it also starts anywhere
else. Sorting every suffix of a corpus would move each byte 200 times over,
so the suffixes are sampled by content: of the 121 leads of 80 bytes in a
200-byte window, the smallest by hash is the window's anchor. Equal windows
have equal anchors at equal offsets, so suffixes at anchors suffice, about
one in sixty, and each window belongs to one anchor.

1. Every anchor's entry (lead hash, digest of the bytes all its windows span,
   place) goes to the bucket of its lead. The lead hash only finds entries that
   may be alike. Entries of equal digest (128 bits of BLAKE2b over the bytes) are
   folded before anything is sorted, so of a group of copies, however large, a task
   sends one entry in HELD and a bucket one.
2. In a bucket, leads with unlike entries (the ends of a repeated passage) ask
   for their bytes. A lead with more than ``HOT`` unlike entries in its bucket, or
   more than ``SPREAD`` among those that a task holds, is hot. Such a task keeps its
   entries out of the bucket and sends one mark, so a bucket holds at most
   ``SPREAD`` entries of a hot lead from each of them.
3. The asked-for suffixes are range-partitioned by their leading bytes with
   Spark's sampled splitters. Splitters never divide equal leading bytes, and a
   run that goes on into the next batch is carried over. Of each run the
   suffixes at all its window starts are sorted by multikey quicksort, and two
   neighbours in that order whose common prefix is 200 bytes are a repeat.
4. The suffixes of hot leads are not brought together by their leading bytes, which
   all share. Their windows are taken in ranges of ``RANGE`` by their distance from
   the anchor. A range whose bytes agree with another's is settled as a whole; one
   of which not even the core agrees, the bytes that all its windows share, drops
   out; the windows of the others are sorted among those that a task holds, and of
   each one unlike window goes on, as a digest that partial sums count.

Defined results: a null text is empty and keeps the hash of no bytes; texts
shorter than 200 bytes are kept whole; repeated rows repeat each other and
lose all bytes that 200-byte strings cover; an empty table gives no rows;
further columns are not looked at, or pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import input_bytes, materialize, with_row_ids

LENGTH = 200
LEAD = 80
SPAN = LENGTH - LEAD + 1
#: Bytes of the input files for a bucket; packed files make more entries than their bytes say.
BUCKET_BYTES = 1 << 19
#: Entries of one lead that are compared together.
HOT = 1024
#: Unlike entries of one lead, among those that a task holds, that still go to the lead's bucket.
SPREAD = 64
#: Windows of a hot lead that are looked at together first.
RANGE = 11
#: Spans of hot leads that a task holds at once.
HELD_SPANS = 1 << 13
#: Window starts that are sorted at once, beyond one lead.
CROWD = 1 << 16
#: Entries that a task holds at once.
HELD = 1 << 16
#: Bytes of a text whose windows are looked at together.
LONGEST = 1 << 17
_U = np.uint64
#: What an entry is to its bucket: alone so far, first of some that agree, settled, asked for, a mark that its lead is hot.
LONE, ALIKE, COVER, ASKED, MARK = range(5)
ENTRY = np.dtype([("lead", "<u8"), ("span", "<u8"), ("span2", "<u8"), ("row", "<i8"), ("at", "<i4"), ("back", "u1"), ("more", "u1"), ("whole", "u1")])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The entries of a slice: at is the first window's start in its text, back the anchor's distance from it, more the number of further windows."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, ENTRY)
    if n > LONGEST and len(offsets) == 2:  # a long text in stretches of windows, so that memory does not follow it
        parts = []
        for a in range(0, n - LENGTH + 1, LONGEST - LENGTH):
            piece = data[a : a + LONGEST - 1]
            part = anchors(piece, np.array([0, len(piece)]), rows)
            part["at"] += a
            parts.append(part)
        return np.concatenate(parts)
    power, inverse = K.powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(K.RAW[data] * power[:n], out=total[1:])
    leads = K.mix64((total[LEAD:] - total[:-LEAD]) * inverse[: n - LEAD + 1])
    bits = int(n).bit_length()
    low = _U((1 << bits) - 1)
    key = (leads & ~low) | np.arange(len(leads), dtype=_U)  # ties go to the first place
    pad = -len(key) % SPAN
    grid = np.append(key, np.full(pad, ~_U(0))).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n_windows = n - LENGTH + 1
    anchor = (np.minimum(behind[:n_windows], ahead[SPAN - 1 : SPAN - 1 + n_windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n_windows]
    inside = np.arange(n_windows) + LENGTH <= offsets[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.zeros(0, ENTRY)
    a, t = anchor[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], a[first]
    out = np.zeros(len(first), ENTRY)
    out["lead"] = leads[at]
    raw, digest = memoryview(data), hashlib.blake2b
    spans = b"".join([digest(raw[x:y], digest_size=16, salt=z.to_bytes(2, "little")).digest() for x, y, z in zip(lo.tolist(), (hi + LENGTH).tolist(), ((hi - lo) * 256 + at - lo).tolist())])
    out["span"], out["span2"] = np.frombuffer(spans, "<u8").reshape(-1, 2).T
    out["row"] = rows[t[first]]
    out["at"] = lo - offsets[t[first]]
    out["back"] = at - lo
    out["more"] = hi - lo
    return out


def _in_order(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by lead and span, with the marks where a lead and where a span begins."""
    e = e[np.lexsort((e["span2"], e["span"], e["lead"]))]
    lead = np.ones(len(e), bool)
    lead[1:] = e["lead"][1:] != e["lead"][:-1]
    span = lead.copy()
    span[1:] |= (e["span"][1:] != e["span"][:-1]) | (e["span2"][1:] != e["span2"][:-1])
    return e, lead, span


def _entries(n_buckets: int):
    """Packed entries by bucket; of HELD neighbours in a task those that agree are settled and sent on, spread over the buckets, as covers."""
    shift = _U(64 - 32)

    def bucket(lead: np.ndarray) -> np.ndarray:
        return ((lead >> shift) * _U(n_buckets) >> shift).astype(np.int64)

    @K.frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for lo, hi, data, offsets in K.slices(batch.column("text")):
                found.append(anchors(data, offsets, rows[lo:hi]))
                held += len(found[-1])
                if held >= HELD:
                    e = np.concatenate(found)
                    found, held = [], 0
                    yield from packed(e)
        if held:
            yield from packed(np.concatenate(found))

    def packed(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e, lead, span = _in_order(e)
        size = np.bincount(np.cumsum(span) - 1)
        group = np.cumsum(lead) - 1
        first = e[span]
        first["whole"] = np.where(size > 1, ALIKE, LONE)  # of a group that agrees the first goes on, the others are settled here already
        hot = np.bincount(group[span]) > SPREAD
        away = hot[group[span]]
        cover = np.concatenate([e[~span], first[away & (size > 1)]])
        cover["whole"] = COVER
        asked, mark = first[away], e[lead][hot]
        asked["whole"], mark["whole"] = ASKED, MARK
        bound, free = np.concatenate([first[~away], mark]), np.concatenate([cover, asked])
        for part, where in ((bound, bucket(bound["lead"])), (free, (np.abs(free["row"]) + free["at"]) % n_buckets)):
            order = np.argsort(where, kind="stable")
            part, where = part[order], where[order]
            cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
            ends = np.append(cuts[1:], len(where)).astype(np.int64) if len(where) else []
            if len(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts]), pa.array([part[x:y].tobytes() for x, y in zip(cuts, ends)], pa.binary())], ["bucket", "entries"])

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """Of one bucket: covers (ask false) and the entries whose bytes are asked for."""
    e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("entries")])
    done, asked, marks = e[e["whole"] == COVER], e[e["whole"] == ASKED], e["lead"][e["whole"] == MARK]
    e, lead, span = _in_order(e[e["whole"] <= ALIKE])
    group, sort = np.cumsum(lead) - 1, np.cumsum(span) - 1
    n_sorts = np.bincount(group[span], minlength=group[-1] + 1) if len(e) else group
    many = np.bincount(sort) if len(e) else sort
    whole = (many[sort] > 1) | (e["whole"] == ALIKE)
    alone = np.bincount(group[~whole], minlength=group[-1] + 1) if len(e) else group
    marked = np.isin(e["lead"], marks)
    ask = span & (marked | (n_sorts[group] > 1) & (alone[group] > 0))
    hot = marked | (n_sorts[group] > HOT)
    cover = np.concatenate([done, e[whole]])
    both = np.concatenate([cover, e[ask], asked])
    hot = np.concatenate([np.zeros(len(cover), bool), hot[ask], np.ones(len(asked), bool)])
    K.give_back()
    return pa.table([pa.array(both["row"]), pa.array(both["at"]), pa.array(both["back"].astype(np.int32)), pa.array(both["more"].astype(np.int32)), pa.array(np.arange(len(both)) >= len(cover)), pa.array(hot)], ["row", "at", "back", "more", "ask", "hot"])


@K.frees
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the asked-for windows span, keyed by their lead, a hot one by nothing; back is the lead's place in them."""
    for batch in _parts(batches):
        key, span, row, at, back = [], [], [], [], []
        texts, asked, rows = batch.column("text"), batch.column("asked"), batch.column("row").to_numpy()
        for i in range(batch.num_rows):
            raw = memoryview(texts[i].as_buffer() if texts[i].is_valid else b"")
            for x in asked[i].as_py():
                a = x["at"]
                key.append(None if x["hot"] else bytes(raw[a + x["back"] : a + x["back"] + LEAD]))
                span.append(bytes(raw[a : a + x["more"] + LENGTH]))
                at.append(a)
                row.append(rows[i])
                back.append(x["back"])
        for lo in range(0, len(key), 4096):
            hi = lo + 4096
            yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi], pa.binary()), pa.array(span[lo:hi], pa.binary()), pa.array(row[lo:hi], pa.int64()), pa.array(at[lo:hi], pa.int32()), pa.array(back[lo:hi], pa.int32())], ["key", "span", "row", "at", "back"])


def symbols(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; past the end stand zeros."""
    out = np.append(data, np.zeros(8, np.uint8)).astype(_U)
    for step in (1, 2, 4):
        out = (out[:-step] << _U(8 * step)) | out[step:]
    return out[: len(data)]


def multikey_quicksort(symbol: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts``, by their first ``depth`` symbols, and the symbols each shares with the one before it.

    Bentley and Sedgewick's three-way partitioning on one symbol at a time, the median of
    three its pivot. All open partitions are split in one pass: those below and above the
    pivot stay at their symbol, those equal to it go on to the next one.
    """
    n = len(starts)
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    place, part = np.arange(n), np.zeros(n, np.int64)  # of the open suffixes their places and partitions
    level = np.zeros(min(n, 1), np.int64)  # of the open partitions their symbols
    while len(place) > 1:
        at = starts[order[place]] + 8 * level[part]
        value = symbol[at]
        size = np.bincount(part, minlength=len(level))
        first = np.cumsum(size) - size
        a, b, c = value[first], value[first + size // 2], value[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        new = part * 3 + side
        by = np.argsort(new, kind="stable")
        order[place] = order[place[by]]
        new = new[by]
        begins = np.append(True, new[1:] != new[:-1])
        own = np.cumsum(begins) - 1
        kind = new[begins]
        level = level[kind // 3] + (kind % 3 == 1)
        inner = ~begins  # neighbours in one partition share at least its symbols
        common[place[inner]] = level[own[inner]]
        count = np.bincount(own)
        open_ = (count > 1) & (level < depth)
        go = open_[own]
        place = place[go]
        part = (np.cumsum(open_) - 1)[own[go]]
        level = level[open_]
    return order, common


def sorted_windows(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, place) of all windows in the order of their bytes, and which are equal to the one before them: their common prefix fills a window."""
    size = np.array([len(s) for s in spans])
    data = np.frombuffer(b"".join(spans), np.uint8)
    n = size - LENGTH + 1
    which = np.repeat(np.arange(len(n)), n)
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(size) - size)[which] + window
    depth = LENGTH // 8
    order, common = multikey_quicksort(symbols(data), starts, depth)
    same = common == depth
    same[:1] = False
    return which[order], window[order], same


def repeated_windows(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(span, place) of the windows that occur at more than one place of the spans."""
    which, window, same = sorted_windows(spans)
    twice = same | np.append(same[1:], False)
    return which[twice], window[twice]


def _runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows, none of which holds another's start and end, joined where they touch."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], start[first], stop[last]


@K.frees
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers from spans that arrive in the order of their keys; the last key of a batch is carried to the next."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        which, window = repeated_windows([r[1] for r in rows])
        at = np.array([r[3] for r in rows], np.int64)[which] + window
        row, start, stop = _runs(np.array([r[2] for r in rows], np.int64)[which], at, at + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["row", "from", "to"])

    held: list[tuple] = []
    windows = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if windows >= CROWD and row[0] != held[-1][0]:
                yield settle(held)
                held, windows = [], 0
            held.append(row)
            windows += len(row[1]) - LENGTH + 1
    if held:
        yield settle(held)


def _hot_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows with spans of at most 320 bytes, so many at once."""
    held, n = [], 0
    for batch in batches:
        for part in _parts([batch], most):
            if n and n + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _digest(raw: bytes, *salt: int) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=bytes(salt)).digest()


def _equal(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each 16-byte key the number of its kind, and of each kind its first place."""
    half = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    order = np.lexsort((half[:, 1], half[:, 0]))
    new = np.append(True, (half[order][1:] != half[order][:-1]).any(axis=1))[: len(order)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new]


@K.frees
def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of hot leads in ranges of windows: what agrees here is settled (``to`` given), but for one; what goes on has its core's digest.

    A window begins so many bytes before the lead's anchor; equal windows do so by as many, thus ranges meet ranges of the same distance.
    """
    for held in _hot_batches(batches, HELD_SPANS):
        row, at, part, start, stop, core, span = [], [], [], [], [], [], []
        for raw, r, a, back in zip(*(held.column(c).to_pylist() for c in ("span", "row", "at", "back"))):
            least = back - (len(raw) - LENGTH)
            for k in range(least // RANGE, back // RANGE + 1):
                lo, hi = max(k * RANGE, least), min(k * RANGE + RANGE - 1, back)
                row.append(r)
                at.append(a)
                part.append(k)
                start.append(a + back - hi)
                stop.append(a + back - lo + LENGTH)
                core.append(_digest(raw[back - k * RANGE : back - (k * RANGE + RANGE - 1) + LENGTH], k))
                span.append(_digest(raw[back - hi : back - lo + LENGTH], lo, hi))
        row, at, part, start, stop = (np.array(x, np.int64) for x in (row, at, part, start, stop))
        kind, first = _equal(span)
        alike = np.bincount(kind)[kind] > 1
        cover = _runs(row[alike], start[alike], stop[alike])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cover[0]), pa.binary()), pa.array(cover[0]), pa.array(cover[1], pa.int32()), pa.array(cover[2], pa.int32()), pa.nulls(len(cover[0]), pa.int32()), pa.nulls(len(cover[0]), pa.bool_())], RANGES)
        cores, _ = _equal([core[i] for i in first])
        meets = np.bincount(cores)[cores] > 1
        for x in range(0, len(first), 4096):
            f = first[x : x + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([core[i] for i in f], pa.binary()), pa.array(row[f]), pa.array(at[f], pa.int32()), pa.nulls(len(f), pa.int32()), pa.array(part[f], pa.int32()), pa.array(meets[x : x + 4096])], RANGES)


RANGES = ["core", "row", "at", "to", "part", "meets"]


@K.frees
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of ranges whose cores meet: those that the sort finds equal here are settled (``to`` given), and one of each kind goes on by its digest."""
    for held in _hot_batches(batches, HELD_SPANS // 4):
        spans, row, at = [], [], []
        for raw, r, a, back, parts in zip(*(held.column(c).to_pylist() for c in ("span", "row", "at", "back", "parts"))):
            least = back - (len(raw) - LENGTH)
            for k in parts:
                lo, hi = max(k * RANGE, least), min(k * RANGE + RANGE - 1, back)
                spans.append(raw[back - hi : back - lo + LENGTH])
                row.append(r)
                at.append(a + back - hi)
        which, window, same = sorted_windows(spans)
        row, at = np.array(row, np.int64)[which], np.array(at, np.int64)[which] + window
        twice = same | np.append(same[1:], False)
        cover = _runs(row[twice], at[twice], at[twice] + LENGTH)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cover[0]), pa.binary()), pa.array(cover[0]), pa.array(cover[1], pa.int32()), pa.array(cover[2], pa.int32())], WINDOWS)
        first = np.flatnonzero(~same)
        for x in range(0, len(first), 4096):
            f = first[x : x + 4096]
            digests = [_digest(spans[i][j : j + LENGTH]) for i, j in zip(which[f].tolist(), window[f].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(row[f]), pa.array(at[f], pa.int32()), pa.nulls(len(f), pa.int32())], WINDOWS)


WINDOWS = ["digest", "row", "at", "to"]


def _hot_covers(spans: DataFrame) -> DataFrame:
    """(row, from, to) of the repeated windows of hot leads. spans: span, row, at, back.

    Counts of cores and of windows are partial sums, and a task sends one row of each kind for those it holds, so no task gathers a lead.
    """
    spans = spans.select("span", "row", "at", "back")
    ranges = materialize(spans.mapInArrow(_ranges, "core binary, row long, at int, to int, part int, meets boolean"), "ranges")
    known = ranges.where("core is not null")
    common = known.groupBy("core").count().where("count > 1").select("core")
    go = known.where("meets").union(known.where("not meets").join(common, "core", "left_semi").select(*RANGES))
    parts = go.groupBy("row", "at").agg(F.collect_list("part").alias("parts"))
    windows = materialize(spans.join(parts, ["row", "at"]).select("span", "row", "at", "back", "parts").mapInArrow(_windows, "digest binary, row long, at int, to int"), "windows")
    left = windows.where("digest is not null")
    again = left.groupBy("digest").count().where("count > 1").select("digest")
    met = left.join(again, "digest", "left_semi").select("row", F.col("at").alias("from"), (F.col("at") + LENGTH).alias("to"))
    settled = [df.where("to is not null").select("row", F.col("at").alias("from"), "to") for df in (ranges, windows)]
    return settled[0].union(settled[1]).union(met)


def covers(rows: DataFrame) -> DataFrame:
    """(row, spans): for each text with removed bytes its covered (from, to) stretches, in no order. rows: row, text."""
    n_buckets = max(64, math.ceil(input_bytes(rows) * 1.2 / BUCKET_BYTES))
    entries = rows.select("row", "text").mapInArrow(_entries(n_buckets), "bucket long, entries binary")
    found = materialize(entries.groupBy("bucket").applyInArrow(_resolve, "row long, at int, back int, more int, ask boolean, hot boolean"), "suffixes")
    settled = found.where("not ask").select("row", F.col("at").alias("from"), (F.col("at") + F.col("more") + LENGTH).alias("to"))
    asked = found.where("ask").groupBy("row").agg(F.collect_list(F.struct("at", "back", "more", "hot")).alias("asked"))
    suffixes = rows.select("row", "text").join(asked, "row").select("row", "text", "asked").mapInArrow(_fetch, "key binary, span binary, row long, at int, back int")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    suffixes = materialize(suffixes, "asked")
    ordered = suffixes.where("key is not null").select("key", "span", "row", "at").repartitionByRange(parts, "key").sortWithinPartitions("key")
    all_ = settled.union(ordered.mapInArrow(_compare, "row long, `from` int, `to` int"))
    hot = suffixes.where("key is null")
    if not hot.isEmpty():
        all_ = all_.union(_hot_covers(hot))
    return all_.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["from"], x["to"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: memoryview, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut small, as each text of a part is copied more than once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[tuple[int, int]]]]:
    texts, spans = batch.column("text"), batch.column("spans")
    for i in range(batch.num_rows):
        yield memoryview(texts[i].as_buffer() if texts[i].is_valid else b""), _merged(spans[i].as_py())


@K.frees
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        n, gone, runs, sha = [], [], [], []
        for raw, spans in _texts(batch):
            n.append(len(raw))
            gone.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            sha.append(hashlib.sha256(_kept(raw, spans)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_covers(docs: DataFrame, text: str) -> DataFrame:
    """The rows, whose columns have names of this module's own, with their covered stretches as ``spans``."""
    rows = with_row_ids(docs, "_row")
    spans = covers(rows.select(F.col("_row").alias("row"), F.col(text).cast("string").alias("text")))
    return rows.join(spans.withColumnRenamed("row", "_row"), "_row", "left")


def repeats(docs: DataFrame) -> DataFrame:
    """Per document its bytes, removed bytes and runs, and the sha256 of what is left."""
    rows = _with_covers(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text")
    return materialize(rows.select("doc_id", "text", "spans").mapInArrow(_digests, RESULT), "digests")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, whatever their names, the repeated bytes cut out of the text; a character cut in two goes whole."""
    schema, names = docs.schema, docs.columns
    own = [f"c{k}" for k in range(len(names))]
    text = own[names.index("text")]

    @K.frees
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            given = batch.column(text)
            batch_ = pa.RecordBatch.from_arrays([given, batch.column("spans")], ["text", "spans"])
            left = [_kept(raw, spans).decode("utf-8", "ignore") if given[i].is_valid else None for i, (raw, spans) in enumerate(_texts(batch_))]
            cols = [pa.array(left, pa.string()) if c == text else batch.column(c) for c in own]
            if "n_chars" in names and schema["n_chars"].dataType.typeName() == "long":
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in left], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = _with_covers(docs.toDF(*own), text)
    return rows.select(*own, "spans").mapInArrow(cut, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT rid, h, unnest(generate_series(0, n - 200)) AS i FROM d WHERE n >= 200)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
sp AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY rid, run),
seg AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM sp UNION ALL SELECT rid, max(b), max(n) FROM sp JOIN d USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kh FROM seg JOIN d USING (rid) GROUP BY rid),
g AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM sp GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN g USING (rid)
"""
