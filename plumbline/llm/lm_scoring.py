"""Scoring texts by online logistic mixing of hashed-context bit predictors.

A token's bytes and a closing space are coded bit by bit. Four predictors
each look up a hashed context (the one to four letters before, the first with
the place in the word) in tables of counts gathered from all training texts,
where distinct words count once for each chunk of texts. The stretched
predictions are mixed with weights chosen by a gate. The weights are learned
online while a chunk's counts are gathered, on every word that is counted, and
averaged over the chunks.

Beside the mix stand four predictors of whole tokens: how often a token
occurs in the training texts, how often among texts of the same ``tongue``
(the commonest of a text's first words), how often after the token before it,
and how often so far in its own text. A second mixer combines the five; its
weights start from a prior and are refined along each text from what the tokens
before have shown. Every predictor is a probability over tokens and every weight
depends on what came before, so the result is the probability of the text.

Which chunk a text is in follows from its id and text, and within a chunk texts
stand in order of their ids, so scores do not depend on files, partitions or
the order of rows. Exact counts of tokens and of pairs of neighbours are
gathered by bucketed merging: each chunk sends its distinct keys with their
training counts to the buckets of the keys and gets back the totals, so no task
holds the vocabulary. The bit tables have a fixed size.

Defined results: a null or empty text is its end token alone; a null id is
hashed as the empty text; with no training texts all counts are nought and
the scores finite; repeated rows score alike; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

_U = np.uint64
#: Bytes of a chunk on average. Which chunk a text is in depends on its id and text alone.
CHUNK_BYTES = 11 << 20
#: Bytes of text whose tokens are looked at together, and those of a chunk that are held at once.
PIECE = 2 << 20
HELD = 16 << 20
BUCKET_BYTES = 2 << 20
#: Slots of each predictor's table, as powers of two.
SIZES = (18, 18, 19, 20)
RANGES = 32
OPENING = 64
TONGUES = 64
GATES = 24
BLOCK = 16
PRIOR = np.array([0.07, 0.55, 0.15, 0.08, 0.15])  # token, token in tongue, letters, token in this text, token after the one before
_FIXED = 1 << 20  # weights are summed as whole numbers of this unit, so that no order of summing shows
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

#: Bits of the key of a pair of neighbours. It is a hashed context: pairs that share a key are counted as one.
PAIR_BITS = 48
_END = _U(0x1234567)
_LOW = _U((1 << 63) - 1)
_TOP = _U(1 << 63)
#: The key of the total of each tongue.
_TOTALS = K.mix64(np.arange(TONGUES, dtype=_U) + _U(0xABCDEF)) | _TOP
_BASES = np.concatenate([[0], np.cumsum([1 << s for s in SIZES])]).astype(np.int64)
_SLOTS = int(_BASES[-1])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Bytes from the commonest of plain text downwards; the rest follow by number.
_COMMON = b" etnaiorshdlucmgpfbwyvkqxzj.,0123456789*$&%#!|-\xc3\xa9\xb3\xa8\xbc\xa4\xb6\xaa\xa7\xa0\xb1\xa1\xad\x9f'\"@:;()/_+=?"


def _prefix_code() -> tuple[np.ndarray, np.ndarray]:
    """Code words and lengths of the bytes: Huffman's over weights that fall with the rank."""
    ranked = list(_COMMON) + [b for b in range(256) if b not in _COMMON]
    heap = [(1 / (k + 2.0) if k < len(_COMMON) else 2.0**-14, b, (b,)) for k, b in enumerate(ranked)]
    heapq.heapify(heap)
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    while len(heap) > 1:
        (w0, n0, a), (w1, n1, b) = heapq.heappop(heap), heapq.heappop(heap)
        for one, group in ((0, a), (1, b)):
            for x in group:
                code[x] |= one << size[x]
                size[x] += 1
        heapq.heappush(heap, (w0 + w1, min(n0, n1), a + b))
    return code, size


_CODE, _SIZE = _prefix_code()


class Tokens:
    """The tokens of a slice of texts: words and one end for each text, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = K.find_words(data, offsets, K.SPACED)
        n = len(offsets) - 1
        self.data, self.n_texts, self.sizes = data, n, np.diff(offsets)
        self.first = w.first + np.arange(n + 1)  # each text before has one end
        total = int(self.first[-1])
        ends = self.first[1:] - 1
        word = np.ones(total, bool)
        word[ends] = False
        self.starts, self.stops = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.starts[word], self.stops[word] = w.starts, w.ends
        self.keys = np.full(total, _END, _U)
        self.keys[word] = K.segment_hashes(data, w.starts, w.ends, K.FOLDED_BYTES) & _LOW
        self.text = np.repeat(np.arange(n), np.diff(self.first))
        self.at = np.arange(total) - self.first[self.text]
        self.tongue = self._tongues()
        self.pairs = (K.mix64(self.keys * _U(64) + self.tongue.astype(_U) + _U(7)) | _TOP)
        self.before = np.append(_END, self.keys[:-1]) if total else self.keys  # the token before; an end stands before the first
        self.bigrams = K.mix64(K.mix64(self.before * _U(0x9E3779B97F4A7C15) + _U(11)) + self.keys) >> _U(64 - PAIR_BITS)

    def _tongues(self) -> np.ndarray:
        """Of each token the tongue of its text, 1 to 63, once the opening is over; before that 0."""
        early = np.flatnonzero((self.at < OPENING) & (self.keys != _END))
        out = np.zeros(len(self.keys), np.int64)
        if len(early):
            order = early[np.lexsort((self.keys[early], self.text[early]))]
            t, k = self.text[order], self.keys[order]
            new = np.ones(len(order), bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(order)))
            best = np.lexsort((k[at], -count, t[at]))
            lead = best[np.append(True, t[at][best][1:] != t[at][best][:-1])]
            by_text = np.zeros(self.n_texts, np.int64)
            by_text[t[at][lead]] = (k[at][lead] % _U(TONGUES - 1)).astype(np.int64) + 1
            out = np.where(self.at >= OPENING, by_text[self.text], 0)
        return out


class Spelling:
    """The bytes of some tokens, each with a closing space, and their contexts."""

    def __init__(self, tokens: Tokens, which: np.ndarray):
        starts, stops = tokens.starts[which], tokens.stops[which]
        size = stops - starts + 1
        self.token = np.repeat(np.arange(len(which)), size)
        self.first = np.cumsum(size) - size
        self.size = size
        at = np.arange(int(size.sum())) - self.first[self.token]
        place = starts[self.token] + at
        last = at == size[self.token] - 1
        raw = np.full(len(at), 32, np.uint8)
        raw[~last] = _FOLD[tokens.data[place[~last]]]
        self.bytes = raw
        c = raw.astype(_U) + _U(1)
        one, two, three, four = (np.where(at >= d, np.roll(c, d), _U(0)) for d in range(1, 5))
        back = one + two * _U(257)
        far = back + three * _U(66049)
        self.contexts = [K.mix64(x) * _U(0x9E3779B97F4A7C15) for x in (one * _U(8) + np.minimum(at, 7).astype(_U), back + _U(1 << 40), far + _U(1 << 50), far + four * _U(16974593) + _U(1 << 60))]
        # in order of the length of their codes, so that the bytes that reach a depth are the first ones
        length = _SIZE[raw]
        self.order = np.argsort((255 - length).astype(np.uint8), kind="stable")
        self.length, self.code = length[self.order], _CODE[raw][self.order]
        self.contexts = [c[self.order] for c in self.contexts]
        self.gate = (np.minimum(at, 5) * 4)[self.order]

    def bits(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """For each depth of the code: how many bytes reach it, their slots in each predictor's table, and their bits."""
        node = np.ones(len(self.code), _U)
        reach = np.cumsum(np.bincount(self.length, minlength=1)[::-1])[::-1]  # of each depth the bytes whose code is at least so long
        for k in range(len(reach) - 1):
            m = int(reach[k + 1])
            bit = (self.code[:m] >> (self.length[:m] - 1 - k)) & 1
            salt = node[:m] * _U(0xD6E8FEB86659FD93 * 0x9E3779B97F4A7C15 % (1 << 64))
            yield m, [((c[:m] + salt) >> _U(64 - size_)).view(np.int64) for c, size_ in zip(self.contexts, SIZES)], bit
            node[:m] = (node[:m] << _U(1)) | bit.astype(_U)


def _by_context(table: np.ndarray, width: int = 1) -> list[np.ndarray]:
    """The part of each predictor in a table of all slots."""
    return [table[width * a : width * b] for a, b in zip(_BASES[:-1], _BASES[1:])]


class BitModel:
    """The stretched predictions of all slots, how sure the longest context is, and the gated weights."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray | None = None):
        self.stretch = self.stretched(zeros, ones)
        self.sure = self.sureness(zeros + ones)
        self.weights = np.full((GATES, len(SIZES)), 0.3) if weights is None else weights

    @staticmethod
    def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))

    @staticmethod
    def sureness(n: np.ndarray) -> np.ndarray:
        return (n >= 0.5).view(np.uint8) + (n >= 4).view(np.uint8) + (n >= 64).view(np.uint8)

    def log_bytes(self, s: Spelling) -> np.ndarray:
        """The log probability of each byte."""
        out = np.ones(len(s.bytes))  # in order of the codes' lengths
        tables, weights = _by_context(self.stretch), np.ascontiguousarray(self.weights.T.astype(np.float32))
        sure = self.sure[_BASES[-2] :]
        for m, slots, bit in s.bits():
            gate = s.gate[:m] + sure[slots[-1]]
            dot = tables[0][slots[0]] * weights[0][gate]
            for k in range(1, len(slots)):
                dot += tables[k][slots[k]] * weights[k][gate]
            dot = np.clip(dot, -30, 30)
            out[:m] /= 1 + np.exp(np.where(bit == 1, -dot, dot))
        back = np.empty(len(out))
        back[s.order] = np.log(out)
        return back

    def log_words(self, tokens: Tokens, which: np.ndarray) -> np.ndarray:
        """The log probability of each token's spelling."""
        out = np.zeros(len(which))
        for lo in range(0, len(which), 5_000):
            s = Spelling(tokens, which[lo : lo + 5_000])
            out[lo : lo + 5_000] = np.add.reduceat(self.log_bytes(s), s.first)
        return out


class Learner:
    """A task's counts of bits, and gated weights learned online: each word is first predicted from the counts so far, then counted."""

    def __init__(self) -> None:
        self.counts = np.zeros(2 * _SLOTS, np.float32)
        self.weights = np.full((GATES, len(SIZES)), 0.3)
        self.seen = 0

    def take(self, tokens: Tokens, which: np.ndarray) -> None:
        """Learns from and counts the spelling of each of the words once: what is left to be spelt are rare words, which distinct words resemble more than running text does."""
        for lo in range(0, len(which), 5_000):
            self._learn(Spelling(tokens, which[lo : lo + 5_000]))
        self.seen += len(which)

    def _learn(self, s: Spelling) -> None:
        tables = _by_context(self.counts, 2)
        for m, slots, bit in s.bits():
            pairs = [t.view(np.complex64)[i] for t, i in zip(tables, slots)]  # the counts of noughts and of ones, fetched as one
            x = [BitModel.stretched(p.real, p.imag) for p in pairs]
            gate = s.gate[:m] + BitModel.sureness(pairs[-1].real + pairs[-1].imag)
            weights = np.ascontiguousarray(self.weights.T.astype(np.float32))
            dot = x[0] * weights[0][gate]
            for k in range(1, len(x)):
                dot += x[k] * weights[k][gate]
            err = bit.astype(np.float32) - 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
            power = np.bincount(gate, sum(v * v for v in x), GATES) / len(x)  # one step size for the predictors of a gate
            for k in range(len(x)):
                self.weights[:, k] += 0.4 * np.bincount(gate, err * x[k], GATES) / (power + 20)
            for table, i in zip(tables, slots):
                np.add.at(table, 2 * i + bit, np.float32(1))


class Piece:
    """A slice of texts with its distinct (token, tongue) pairs and its distinct pairs of neighbours."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.tokens = Tokens(data, offsets)
        self.pair, self.once, self.back = K.unique(self.tokens.pairs)
        # of the pairs the distinct words, where each first stands, and each pair's word
        self.word, first, self.word_of = K.unique(self.tokens.keys[self.once])
        self.stands = self.once[first]
        self.next, at, self.next_of = K.unique(self.tokens.bigrams)
        # the place among the words of the token before each pair's first; before the first of all stands an end
        self.before = np.where(at == 0, np.searchsorted(self.word, _END), self.word_of[self.back[at - 1]])
        self.tongue = self.tokens.tongue[self.once]
        self.size = len(data)

    def keys(self) -> np.ndarray:
        """The distinct keys whose counts the piece needs, but for those of neighbours."""
        return K.distinct(np.concatenate([self.word, self.pair, _TOTALS[np.flatnonzero(np.bincount(self.tongue, minlength=TONGUES))]]))


def _fresh(pieces: list[Piece]) -> Iterator[tuple[Piece, np.ndarray]]:
    """Each piece with its words that no earlier one has."""
    seen = np.zeros(0, _U)
    for p in pieces:
        new = np.append(seen, ~_U(0))[np.searchsorted(seen, p.word)] != p.word  # keys of words stay below the last number
        yield p, np.flatnonzero(new)
        seen = K.distinct(np.append(seen, p.word[new])) if len(pieces) > 1 else seen


def _training(ids: list) -> np.ndarray:
    return K.crc_of_ids(ids) % 7 != 2


def _fan(n_chunks: int) -> int:
    """Into how many sums the tasks' tables are gathered first, so that neither step sums many."""
    return max(8, math.isqrt(n_chunks))


def _gather(n_buckets: int, fan: int):
    """Per chunk and bucket the distinct keys with their training counts; per task the bit counts of its training texts and its weights.

    Rows come in order of chunk and document. A chunk is taken up whole, from empty tables, so what it gives does not depend on the task or batches it comes in.
    """
    names = ["bucket", "chunk", "keys", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def keyed(chunk: int, keys: list[np.ndarray], counts: list[np.ndarray], bits: int) -> pa.RecordBatch:
        """Those of neighbours, of ``bits`` PAIR_BITS, go to buckets of their own after the others."""
        k, c = merge(np.concatenate(keys), np.concatenate(counts))
        bucket = ((k >> _U(bits - 32)) * _U(n_buckets) >> _U(32)).astype(np.int64)  # rises with the key
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(k))
        first = n_buckets * (bits == PAIR_BITS)
        rows = [(first + int(bucket[a]), chunk, packed(k[a:b]), packed_counts(c[a:b])) for a, b in zip(cuts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def absorb(held: list[tuple[Piece, np.ndarray, np.ndarray]], keys: list[np.ndarray], counts: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], learner: Learner) -> None:
        """Takes in some pieces of a chunk: each distinct word is spelt once for all of them."""
        if not held:
            return
        own = [np.bincount(p.word_of, n, len(p.word)).astype(np.int64) for p, n, _ in held]
        word, often = merge(np.concatenate([p.word for p, _, _ in held]), np.concatenate(own))
        keys.append(word)
        counts.append(often)
        for p, n, after in held:
            there = np.flatnonzero(np.bincount(p.tongue, minlength=TONGUES))
            keys += [p.pair, _TOTALS[there]]
            counts += [n, np.bincount(p.tongue, n, TONGUES).astype(np.int64)[there]]
            pairs.append((p.next, after))
        if often.any():
            for p, new in _fresh([p for p, _, _ in held]):
                new = new[often[np.searchsorted(word, p.word[new])] > 0]
                learner.take(p.tokens, p.stands[new])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, weights, seen = None, np.zeros(GATES * len(SIZES), np.int64), 0
        for chunk, ids, texts in _chunks(batches):
            learner, keys, counts, pairs = Learner(), [], [], []
            held: list[tuple[Piece, np.ndarray, np.ndarray]] = []
            train = _training(ids)
            for lo, hi, data, offsets in K.slices(texts, PIECE):
                p = Piece(data, offsets)
                weight = train[lo:hi][p.tokens.text]
                held.append((p, np.bincount(p.back, weight, len(p.once)).astype(np.int64), np.bincount(p.next_of, weight, len(p.next)).astype(np.int64)))
                if sum(q.size for q, _, _ in held) > HELD:
                    absorb(held, keys, counts, pairs, learner)
            absorb(held, keys, counts, pairs, learner)
            yield keyed(chunk, keys, counts, 64)
            yield keyed(chunk, *zip(*pairs), PAIR_BITS)
            if learner.seen:
                bits = learner.counts if bits is None else bits + learner.counts
                weights += np.rint(learner.weights.ravel() * _FIXED).astype(np.int64) * learner.seen
                seen += learner.seen
        if bits is not None:
            part = TaskContext.get().partitionId() % fan
            parts = [(-1 - r * fan - part, 0, b"", zlib.compress(x.tobytes(), 1)) for r, x in enumerate(bits.reshape(RANGES, -1))]
            parts.append((-1 - RANGES * fan - part, 0, b"", zlib.compress(np.append(weights, seen).tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), types)], names)

    return run


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, highest bytes first; bytes that are nought in all are left out."""
    planes = np.diff(keys, prepend=_U(0)).astype(">u8").view(np.uint8).reshape(-1, 8)
    first = np.diff(keys[:1], prepend=_U(0))
    planes[0] = 0
    used = int(np.flatnonzero(planes.any(axis=0))[0]) if planes.any() else 8
    return bytes([8 - used]) + first.tobytes() + np.ascontiguousarray(planes[:, used:].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1) if width else np.zeros((0, 1), np.uint8)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    steps = out.view(">u8").ravel().astype(_U)
    steps[0] = np.frombuffer(raw, _U, 1, 1)[0]
    return np.cumsum(steps, dtype=_U)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, with 255 for those beyond, which follow."""
    large = counts >= 255
    return zlib.compress(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.uint32).tobytes(), 1)


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    out = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
    out[out == 255] = np.frombuffer(raw, np.uint32, offset=n)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, pa.Array]]:
    """(chunk, ids, texts) of rows that come in order of their chunks, each chunk whole."""
    now, ids, texts = None, [], []
    for batch in batches:
        number = batch.column("chunk").to_numpy()
        for a, b in _stretches(number):
            if now is not None and number[a] != now:
                yield now, ids, pa.concat_arrays(texts)
                ids, texts = [], []
            now = int(number[a])
            ids += batch.column("doc_id").slice(a, b - a).to_pylist()
            texts.append(batch.column("text").slice(a, b - a).cast(pa.large_string()))
    if now is not None:
        yield now, ids, pa.concat_arrays(texts)


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal neighbours, as (first, after the last)."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
    return list(zip(cuts, np.append(cuts[1:], len(values)))) if len(values) else []


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    ranked = keys[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else order
    return ranked[at], np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else at


def _merge_bucket(fan: int, n_buckets: int):
    """Of one bucket: the totals of the asked keys, chunk by chunk, and the bucket's share of N and V; or the sum of a range of bit counts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            rows = [(bucket, -1, _sum_tables(table, (-1 - bucket) // fan), 0, 0)]
        else:
            keys = [unpacked(x.as_py()) for x in table.column("keys")]
            counts = [unpacked_counts(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys)]
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.uint64)
            base = (distinct < _TOP) & (total > 0) & (bucket < n_buckets)
            answers = np.split(total[back].astype(np.uint32), np.cumsum([len(k) for k in keys])[:-1])
            rows = [(bucket, c, packed_counts(a), 0, 0) for c, a in zip(table.column("chunk").to_pylist(), answers)]
            rows.append((bucket, -1, b"", int(total[base].sum()), int(base.sum())))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["bucket", "chunk", "counts", "n", "v"])

    return run


def _sum_tables(table: pa.Table, range_: int) -> bytes:
    """The sum of tables of whole numbers, which is the same in any order."""
    total = None
    for x in table.column("counts"):
        part = np.frombuffer(zlib.decompress(x.as_buffer()), np.int64 if range_ == RANGES else np.float32)
        total = part.copy() if total is None else total + part
    return zlib.compress(total.tobytes(), 1)


def _sum_range(table: pa.Table) -> pa.Table:
    r = table.column("range")[0].as_py()
    return pa.table([pa.array([r], pa.int64()), pa.array([_sum_tables(table, r)], pa.binary())], ["range", "counts"])


def _mixed(tokens: Tokens, experts: np.ndarray) -> np.ndarray:
    """The log probability of each token under the adaptive mix of the experts (probabilities, tokens x experts).

    The weights of a text start at the prior and, after every block of its
    tokens, move to the experts' shares of what has been explained so far.
    """
    n = np.diff(tokens.first)
    out = np.zeros(len(experts))
    credit = np.tile(PRIOR * BLOCK / 2, (len(n), 1))
    block = tokens.at // BLOCK
    order = np.argsort(block.astype(np.uint16) if len(block) and int(block.max()) < 1 << 16 else block, kind="stable")  # sixteen bits are sorted by their digits
    cuts = np.searchsorted(block[order], np.arange(int(block.max()) + 2 if len(block) else 1))
    for b in range(len(cuts) - 1):
        at = order[cuts[b] : cuts[b + 1]]
        text = tokens.text[at]
        share = experts[at] * (credit / credit.sum(axis=1, keepdims=True))[text]
        p = share.sum(axis=1)
        out[at] = np.log(p)
        share /= p[:, None]
        for m in range(experts.shape[1]):
            credit[:, m] += np.bincount(text, share[:, m], len(n))
    return out


def _score_chunk(model, n_train: int, n_types: int, n_buckets: int):
    floor = math.log10(n_train + n_types + 1)

    def one(tokens: Tokens, back: np.ndarray, word: np.ndarray, n_words: int, c: np.ndarray, pair: np.ndarray, total: np.ndarray, spelt: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        n = len(tokens.keys)
        # tokens by text and word, in order: as one number with the place, or by sorting twice where that has too many bits
        place = max(1, n.bit_length())
        own, last = tokens.text * n_words + word[back], tokens.n_texts * n_words
        if last.bit_length() + place < 64:
            ranked = np.sort(own << place | np.arange(n))
            order, ranked = ranked & ((1 << place) - 1), ranked >> place
        else:
            order = np.lexsort((word[back], tokens.text))
            ranked = own[order]
        same = np.zeros(n, bool)
        same[1:] = ranked[1:] == ranked[:-1]
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        before = np.zeros(n)
        before[order] = np.arange(n) - start
        experts = np.column_stack([(c / max(n_train, 1))[back], (pair / np.maximum(total, 1))[back], spelt[back], before / np.maximum(tokens.at, 1), after])
        score = np.add.reduceat(_mixed(tokens, experts), tokens.first[:-1]) / math.log(10)
        base = np.add.reduceat((np.log10(c + 1) - floor)[back], tokens.first[:-1])
        return [np.diff(tokens.first), np.add.reduceat((c > 0).astype(np.int64)[back], tokens.first[:-1]), base, score]

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids: list = texts.column("doc_id").to_pylist()

        def pieces() -> Iterator[list[Piece]]:
            held: list[Piece] = []
            for batch in texts.to_batches():
                for _, _, data, offsets in K.slices(batch.column("text"), PIECE):
                    held.append(Piece(data, offsets))
                    if sum(p.size for p in held) > HELD:
                        yield held
                        held = []
            yield held

        # the chunk's distinct keys in order, as they were sent to the buckets, and their totals
        parts, pairs, kept = [], [], []
        for k, group in enumerate(pieces()):
            parts += [p.keys() for p in group]
            pairs += [p.next for p in group]
            kept = [group] if k == 0 else []
        keys, pairs = K.distinct(np.concatenate(parts)), K.distinct(np.concatenate(pairs))
        sent = answers.sort_by("bucket")
        number = sent.column("bucket").to_numpy()
        at = [((k >> _U(b - 32)) * _U(n_buckets) >> _U(32)).astype(np.int64) + n_buckets * (b == PAIR_BITS) for k, b in ((keys, 64), (pairs, PAIR_BITS))]
        held = dict(zip(*np.unique(np.concatenate(at), return_counts=True)))
        totals = np.concatenate([unpacked_counts(x.as_py(), int(held[b])) for b, x in zip(number, sent.column("counts"))]).astype(np.float64)
        counts, after_counts = totals[: len(keys)], totals[len(keys) :]
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        sizes = []
        for group in kept or pieces():  # a chunk of long texts is not held but read twice
            known, log_p = np.zeros(0, _U), np.zeros(0)
            for p, new in _fresh(group):
                known, log_p = np.append(known, p.word[new]), np.append(log_p, model.value.log_words(p.tokens, p.stands[new]))
            order = np.argsort(known)
            known, log_p = known[order], log_p[order]
            for p in group:
                t = p.tokens
                c, pair = (counts[np.searchsorted(keys, k)] for k in (p.word, p.pair))
                total = np.append(counts, 0)[np.searchsorted(keys, _TOTALS)][p.tongue]
                spelt = np.exp(np.maximum(log_p[np.searchsorted(known, p.word)], -600))
                sizes.append(t.sizes)
                after, prior = after_counts[np.searchsorted(pairs, p.next)], c[p.before]
                for col, v in zip(out, one(t, p.back, p.word_of, len(p.word), c[p.word_of], pair, total, spelt[p.word_of], (after / np.maximum(prior, 1))[p.next_of])):
                    col.append(v)
        n_tokens, n_known, base, score = (np.concatenate(x) for x in out)
        bits = -score * math.log2(10) / np.maximum(np.concatenate(sizes), 1)
        cols = [pa.array(ids, pa.int64()), pa.array(~_training(ids)), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(base), pa.array(score), pa.array(bits)]
        return pa.table(cols, [f.split()[0] for f in RESULT.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per document its tokens, the base score and the model's log10 probability of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks, n_buckets = max(1, math.ceil(size / CHUNK_BYTES)), max(32, math.ceil(size / BUCKET_BYTES))
    fan, own = _fan(n_chunks), F.xxhash64("doc_id", "text")
    rows = rows.withColumn("own", own).withColumn("chunk", F.pmod("own", F.lit(n_chunks)))
    in_order = rows.repartition("chunk").sortWithinPartitions("chunk", "doc_id", "own").select("chunk", "doc_id", "text")
    found = in_order.mapInArrow(_gather(n_buckets, fan), "bucket long, chunk long, keys binary, counts binary")
    merged = materialize(found.groupBy("bucket").applyInArrow(_merge_bucket(fan, n_buckets), "bucket long, chunk long, counts binary, n long, v long"), "counts")
    total = merged.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    tables = merged.where("bucket < 0").select(F.floor((-1 - F.col("bucket")) / fan).cast("long").alias("range"), "counts").groupBy("range").applyInArrow(_sum_range, "range long, counts binary").collect()
    parts = {r["range"]: zlib.decompress(r["counts"]) for r in tables}  # of a fixed size in all
    counts = np.concatenate([np.frombuffer(parts[r], np.float32) if r in parts else np.zeros(2 * _SLOTS // RANGES, np.float32) for r in range(RANGES)])
    learned = np.frombuffer(parts[RANGES], np.int64) if RANGES in parts else None
    weights = None if learned is None else (learned[:-1] / learned[-1] / _FIXED).reshape(GATES, -1)
    ready = spark.sparkContext.broadcast(BitModel(counts[::2], counts[1::2], weights))
    chunked = rows.select("doc_id", "text", "chunk")
    answers = merged.where("bucket >= 0 and chunk >= 0").select("chunk", "bucket", "counts")
    scored = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(ready, int(total[0]), int(total[1]), n_buckets), RESULT)
    return materialize(scored, "scores")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
