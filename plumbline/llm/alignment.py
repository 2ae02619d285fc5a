"""Alignment of the tokens of two tokenizers by their bytes.

A stretch of documents is one run of bytes: each text after one space, with the
documents' byte offsets. Counting the ends of A's and of B's tokens at every
byte once gives all there is: a document is cut into groups where both end;
every byte where one of them ends closes the overlap of just one A and one B
token, a link; prefix sums, taken at the documents' offsets, count tokens,
groups and links of each document.

Tokens are looked up by piece: a piece starts at a space after a character that
is no white space. No token of either vocabulary crosses such a place (A is cut
there by its pattern; for B this is checked when it is opened), so the tokens of
a text are those of its pieces, and each distinct piece is tokenised once.

How often an id pair is linked in the whole corpus is summed in two steps: each
task sends its distinct pairs with their counts, Spark adds them up by pair and
takes the greatest of each B id, and each task's pairs get their totals back. No
task holds the pairs of the corpus.

Defined results: a null or empty text, and one whose tokens do not give back its
bytes, has no tokens, noughts and an empty digest; strings of special tokens are
plain text; a null id stays null; repeated rows count and are returned each; an
empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import storage

#: Where the tokenizers' files are, on every executor.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once.
SLICE = 2 << 20
#: Distinct pieces a worker remembers; past that it starts anew.
REMEMBERED = 400_000
#: Pieces that are tokenised in one call.
AT_ONCE = 1 << 14
SPACE = 0x20
#: Fixed value: how a byte-level vocabulary cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The greatest first byte of characters below U+0280, whose classes have not changed for long.
LATIN = 0xC9

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: What the first pass writes: a slice of documents (kind 1), or pairs of the task (kind 0).
PART = "kind int, task long, place long, pair binary, times binary, doc_id binary, known binary, n_a binary, n_b binary, n_groups binary, n_links binary, links binary, digests array<string>"
_NAMES = [x.split()[0] for x in PART.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 9, pa.list_(pa.string())]


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others are numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Stream(NamedTuple):
    """The tokens of some documents one after the other."""

    ids: np.ndarray
    ends: np.ndarray  # the byte before which each token ends


class Pair:
    """The two tokenizers of a worker, and the pieces met so far."""

    def __init__(self, folder: str):
        import sentencepiece
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = tokenizers.Tokenizer.from_file(f"{folder}/{A_FILE}")
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        for text, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters.get(c, 0) for c in text)
        self.fast = ranked(json.loads(self.a.to_str())["model"]["merges"], vocabulary, self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a token of B crosses from a word to the space after it, so texts cannot be cut there")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.whole = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.counts = [np.zeros(0, np.int64)] * 2

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The place of each distinct piece among those met; its tokens, and whether they give back its bytes, stand there."""
        if len(self.number) > REMEMBERED:
            self.forget()
        new = [p for p in pieces if p not in self.number]
        for lo in range(0, len(new), AT_ONCE):
            self._meet(new[lo : lo + AT_ONCE])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def _meet(self, new: list[bytes]) -> None:
        texts = [p.decode() for p in new]
        lists = self._encode(new, texts), self.b.encode([t[1:] for t in texts], num_threads=1)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        whole = np.ones(len(new), bool)
        for k, (found, names, size) in enumerate(zip(lists, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size))):
            count = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum()))
            whole &= K.sums(size[ids], np.concatenate([[0], np.cumsum(count)])) == sizes
            if not whole.all() or b"".join(map(names.__getitem__, ids.tolist())) != b"".join(new):  # then piece by piece
                whole &= np.fromiter((b"".join(map(names.__getitem__, x)) == p for x, p in zip(found, new)), bool, len(new))
            self.ids[k], self.counts[k] = np.append(self.ids[k], ids), np.append(self.counts[k], count)
        self.whole = np.append(self.whole, whole)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))

    def _encode(self, new: list[bytes], texts: list[str]) -> list[list[int]]:
        """A's ids. Characters beyond Latin may be letters to one library and not yet to another, so only the tokenizer itself sees them."""
        if self.fast is None:
            return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        out: list = [self.fast.encode_ordinary(t) if max(p) <= LATIN else None for p, t in zip(new, texts)]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.a.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = x.ids
        return out

    def stream(self, k: int, number: np.ndarray) -> Stream:
        """The tokens of pieces one after the other."""
        count = self.counts[k]
        each = count[number]
        at = np.repeat((np.cumsum(count) - count)[number] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ids = self.ids[k][at]
        return Stream(ids, np.cumsum((self.a_size, self.b_size)[k][ids]))


def ranked(merges: list, vocabulary: dict[str, int], as_bytes: list[bytes]):
    """The same vocabulary as a tokenizer by ranks, which is several times faster, if every merge makes the token of its rank; else none."""
    import tiktoken

    singles = len(vocabulary) - len(merges)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
    if any(vocabulary.get("".join(m)) != singles + k for k, m in enumerate(pairs)):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={as_bytes[i]: i for i in vocabulary.values()}, special_tokens={})


@functools.cache
def pair_of(folder: str) -> Pair:
    return Pair(folder)


#: Whether a byte, as the last of a character, may be the end of white space that is not ASCII's space: U+0085, U+00A0, and those of three bytes.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each after a space, and their offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, SPACE, np.uint8)
    moved = offsets + np.arange(n + 1)
    inside = np.ones(len(out), bool)
    inside[moved[:-1]] = False
    out[inside] = data
    return out, moved


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at every document, and at each space after a character that is certainly no white space."""
    start = np.zeros(len(data), bool)
    space = np.flatnonzero(data[2:] == SPACE) + 2
    before, second = data[space - 1], data[space - 2]
    start[space[_PLAIN[before] | (_TAIL[before] & _LEAD[second])]] = True
    start[offsets[1:] - 1] = False  # a space that ends a text stays with the piece before, as B adds no space to an empty piece
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


class Aligned(NamedTuple):
    """Per document the counts; per link the tokens; per token of either kind its group."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a: Stream
    b: Stream
    group_a: np.ndarray
    group_b: np.ndarray


def align(a: Stream, b: Stream, offsets: np.ndarray) -> Aligned:
    """Everything from the ends of the tokens at every byte, counted once for all documents."""
    n = int(offsets[-1])
    at_a, at_b = (np.bincount(x.ends - 1, minlength=n).astype(np.int8) for x in (a, b))  # a token ends with its last byte
    both = at_a & at_b
    either = np.flatnonzero(at_a | at_b)
    so_far = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    sum_a, sum_b, sum_both = so_far(at_a), so_far(at_b), so_far(both)
    per = lambda s: np.diff(s[offsets])
    n_a, n_b, n_groups = per(sum_a), per(sum_b), per(sum_both)
    # the byte that closes an overlap belongs to the token of which as many others have ended before
    return Aligned(n_a, n_b, n_groups, n_a + n_b - n_groups, sum_a[either], sum_b[either], a, b, sum_both[a.ends - 1], sum_both[b.ends - 1])


#: Of each number below a million its digits, the last first; vocabularies are smaller than that.
_DIGITS = 6
_DIGIT = [(np.arange(10**_DIGITS, dtype=np.int32) // 10**k % 10 + ord("0")).astype(np.uint8) for k in range(_DIGITS)]


def group_texts(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;a3|b2`` of all documents, and where each document's lie: a mark after each token, which of a document's last one is left out."""
    ids = np.concatenate([x.a.ids, x.b.ids])
    group = np.concatenate([x.group_a, x.group_b])
    # A's tokens of a group stand before B's: the place of a token follows from how many of both kinds stand before it
    n_groups = int(x.n_groups.sum())
    in_a, in_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    place = np.concatenate([np.arange(len(x.a.ids)) + first_b[x.group_a], np.arange(len(x.b.ids)) + (first_a + in_a)[x.group_b]])
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[(first_a + in_a - 1)] = ord("|")
    mark[len(x.a.ids) + first_b + in_b - 1] = ord(";")
    ordered, marks = np.empty(len(ids), np.int32), np.empty(len(ids), np.uint8)
    ordered[place], marks[place] = ids, mark
    size = np.searchsorted(10 ** np.arange(1, _DIGITS), ordered, "right") + 1
    ends = np.cumsum(size + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    for k in range(len(str(int(ordered.max(initial=0))))):  # the k-th digit from the right
        some = np.flatnonzero(size > k)
        out[ends[some] - 2 - k] = _DIGIT[k][ordered[some]]
    tokens = np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])
    return out, np.concatenate([[0], ends])[tokens]


class Slice(NamedTuple):
    known: np.ndarray  # of each document whether it has tokens
    aligned: Aligned
    digests: list[str]


def align_texts(data: np.ndarray, offsets: np.ndarray, pair: Pair) -> Slice:
    """Tokenises and aligns the texts of a slice; those that have no tokens are left out of what is aligned."""
    n = len(offsets) - 1
    some = np.diff(offsets) > 0
    data, offsets = spaced(data, offsets)
    starts = piece_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    number = K.classes(data, starts, ends)
    _, first = np.unique(number, return_index=True)
    raw = data.tobytes()
    number = pair.numbers([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])[number]
    # a document is known if all its pieces are
    rows = np.searchsorted(offsets, starts, "right") - 1
    known = some & (np.bincount(rows, ~pair.whole[number], n) == 0)
    number = number[known[rows]]
    kept = np.concatenate([[0], np.cumsum(np.where(known, np.diff(offsets), 0))])
    x = align(pair.stream(0, number), pair.stream(1, number), kept)
    text, where = group_texts(x)
    view = memoryview(text)
    digests = [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(where.tolist(), where[1:].tolist())]
    return Slice(known, x, digests)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(_blob(x), "zstd", asbytes=True)


def _first_pass(folder: str):
    """Slices with the places of their links among the slice's distinct pairs, and at the end of the task its distinct pairs with their counts."""

    @K.frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(folder)
        width = len(pair.b_bytes)
        task = TaskContext.get().partitionId()
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = 0
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column("text"), SLICE):
                ids = batch.column("doc_id").slice(lo, hi - lo)
                found = align_texts(data, offsets, pair)
                x = found.aligned
                own, _, number = K.unique(x.a.ids[x.link_a].astype(np.int64) * width + x.b.ids[x.link_b])
                n = np.bincount(number, minlength=len(own))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                row = (1, task, place, _squeezed(own), None, _blob(ids.fill_null(0).to_numpy()), _blob(known), _blob(x.n_a), _blob(x.n_b), _blob(x.n_groups), _blob(x.n_links), _squeezed(number.astype(np.int32)), found.digests)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)
                place += 1
                merged, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
                keys, times = merged, np.bincount(at, np.concatenate([times, n]), len(merged)).astype(np.int64)
        for lo in range(0, len(keys), 1 << 16):
            row = (0, task, place, _squeezed(keys[lo : lo + (1 << 16)]), _squeezed(times[lo : lo + (1 << 16)]), *[None] * 8)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)
            place += 1

    return run


def _opened(blob: pa.Scalar, kind=np.int64) -> np.ndarray:
    """What ``_squeezed`` packed; zstd frames know their size."""
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), kind)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, pair, times) of the packed pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            keys, times = _opened(batch.column("pair")[k]), _opened(batch.column("times")[k])
            task = np.full(len(keys), batch.column("task")[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(keys), pa.array(times)], ["task", "pair", "times"])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each document's links; a task's pairs with their totals come before its slices."""
    task, parts = None, []
    table: tuple | None = None
    for batch in batches:
        tasks, kinds = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 1)]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            if tasks[a] != task:
                task, parts, table = tasks[a], [], None
            if kinds[a] == 0:
                parts.append([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("key", "total", "best")])
                continue
            if table is None:
                table = tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            get = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[a].as_py(), kind)  # noqa: B023, E731
            at = np.searchsorted(table[0], _opened(batch.column("pair")[a]))
            links = _opened(batch.column("links")[a], np.int32)
            ids = pa.array(get("doc_id"), pa.int64(), mask=~get("known", bool))
            n_links = get("n_links")
            where = np.concatenate([[0], np.cumsum(n_links)])
            cols = [ids, *(pa.array(get(c)) for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(K.sums(table[k][at][links].astype(np.int64), where)) for k in (2, 1)), batch.column("digests")[a].values]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in RESULT.split(", ")])


def pair_counts(parts: DataFrame, b_size: int) -> DataFrame:
    """pair, b, total and best (no pair of the B id has more), over the whole corpus."""
    spread = parts.where("kind = 0").select("task", "pair", "times").mapInArrow(_spread, "task long, pair long, times long")
    totals = spread.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.col("pair") % b_size)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row a document: tokens of both kinds, groups, links, and how its links stand among those of the corpus."""
    b_size = len(pair_of(folder).b_bytes)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = storage.materialize(read.mapInArrow(_first_pass(folder), PART), "aligned")
    counts = storage.materialize(pair_counts(parts, b_size), "pairs")
    spread = parts.where("kind = 0").select("task", "pair", "times").mapInArrow(_spread, "task long, pair long, times long")
    asked = spread.select("task", "pair").join(counts.select("pair", "total", "best"), "pair")
    asked = asked.select(F.lit(0).alias("kind"), "task", F.lit(0).cast("long").alias("place"), F.col("pair").alias("key"), "total", "best")
    slices = parts.where("kind = 1").drop("times")
    both = slices.unionByName(asked, allowMissingColumns=True)
    return both.repartition("task").sortWithinPartitions("task", "kind", "place", "key").mapInArrow(_second_pass, RESULT)


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
