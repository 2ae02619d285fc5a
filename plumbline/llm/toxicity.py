"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel of two words compares their gapped subsequences of three and four
letters, a subsequence that spans d letters weighing DECAY**d, so an insult
still matches with letters put in or left out. Only letters count: ``i-d.i o t``
is read as one word, as are runs of three or more one-letter words.

A text is as toxic as its worst word, together with how many and what share of
its words are on the toxic side. Labels mark whole texts, and a sentence of a
toxic text need not hold the insult; so the units the machine is trained on are
not sentences but the words of labelled texts, and those that bear the label are
found by turns, as in multiple-instance learning: words that several toxic texts
and no other hold, or toxic ones LIKELIER times as often as others, then those
that the machine fitted on them puts clearly on their side. Words of fewer
than three letters have no subsequence and teach nothing. Words are counted over
the labelled texts by the executors; only a bounded number of words and three
figures for each text that sets the scale come to the driver, never a text.
The fitted function is linear in the kernel values at the landmarks, so it
folds into one weight per subsequence, and scoring a word is a few dozen
table look-ups for each letter.

Defined results: a null or empty text has the lowest score any text can have;
without labels of both kinds every score is the same, below the threshold;
null labels or ids teach nothing; repeated rows get equal scores; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

#: Bounds of the sample the machine is fitted on: labelled texts of each kind, smallest hash first,
SAMPLE = 2000
#: words that may bear the label, likeliest first, and those of them it is trained on,
BEARERS = 4096
WITNESSES = 960
#: clean words, half of them the commonest and half those of the smallest hash,
NEGATIVES = 24_000
#: Nystrom landmarks, a half of them witnesses, and witnesses that are trained on with a letter put in or left out.
LANDMARKS = 320
SPOILT = 16
#: One labelled text in so many is kept back to set the scale of the scores, once there are enough.
KEPT_BACK = 4
ENOUGH = 200
#: How much likelier a word is in toxic texts than in others that are not without it.
LIKELIER = 8
SHORTEST = 3
DECAY = 0.75
REACH = 6
THRESHOLD = 0.7
PIECE = 24
RESULT = "doc_id long, held_out boolean, score double, predicted int"



def _letter_codes() -> np.ndarray:
    """Letters are 1 to 26, accented Latin ones 27 to 62, which other scripts share; all else is left out."""
    code = np.zeros(256, np.uint8)
    code[65:91] = code[97:123] = np.arange(1, 27)
    code[0x80:] = 27 + np.arange(128) % 36
    code[0xA0:0xC0] = code[0x80:0xA0]  # in U+00C0 to U+00FF, capitals as small letters
    code[0xC3] = 0  # the first byte of each of these
    return code


_CODE = _letter_codes()
_GAPS = [(0, *g) for k in (2, 3) for g in itertools.combinations(range(1, REACH + 1), k)]
_TABLE = 1 << 20
_START = 63


def _norms(longest: int = 4096) -> np.ndarray:
    """The kernel's norm of a word by its number of letters."""
    out = np.zeros(longest + 1)
    n = np.arange(longest + 1)
    for g in _GAPS:
        out += np.maximum(0, n - g[-1]) * DECAY ** (2 * g[-1])
        if len(g) == 3:
            out += (n > g[-1]) * DECAY ** (2 * g[-1] + 2)
    return np.sqrt(np.maximum(out, 1e-9))


_NORM = _norms()


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, start, end, text) of the letter runs to judge; long runs come in overlapping pieces."""
    words = K.find_words(data, offsets, K.SPACED)
    codes = _CODE[data]
    keep = codes > 0
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    letters = codes[keep]
    starts, ends, rows = at[words.starts], at[words.ends], words.rows()
    ok = ends > starts
    starts, ends, rows = starts[ok], ends[ok], rows[ok]
    single = ends - starts == 1
    if single.any():  # runs of one-letter words are words spelled out
        new = np.ones(len(starts), bool)
        new[1:] = ~(single[1:] & single[:-1] & (rows[1:] == rows[:-1]))
        first = np.flatnonzero(new & single)
        cut = np.append(np.flatnonzero(new)[1:], len(starts))
        last = cut[np.searchsorted(cut, first, "right")] - 1
        far = last - first >= 2
        starts, ends, rows = np.append(starts, starts[first[far]]), np.append(ends, ends[last[far]]), np.append(rows, rows[first[far]])
    long = ends - starts > PIECE
    if long.any():
        extra = [(x, min(x + PIECE, b), r) for a, b, r in zip(starts[long], ends[long], rows[long]) for x in range(a, b - PIECE // 2, PIECE // 2)]
        a, b, r = (np.array(c, np.int64) for c in zip(*extra))
        starts, ends, rows = np.append(starts[~long], a), np.append(ends[~long], b), np.append(rows[~long], r)
    return letters, starts, ends, rows


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each segment its place and its segment."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[which], which


def _slot(code: np.ndarray) -> np.ndarray:
    """The table slot of a subsequence of up to four 6-bit letters."""
    return (code * 0x9E3779B1 & 0xFFFFFFFF) >> 12


def _subsequences(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(segment, subsequence code, weight) for one pattern of gaps at a time; codes are hashed to the slots of the weight table."""
    place, which = _places(starts, ends)
    end = ends[which]
    wide = letters.astype(np.int64)
    for g in _GAPS:
        ok = place + g[-1] < end
        p = place[ok]
        code = wide[p]
        for d in g[1:]:
            code = (code << 6) | wide[p + d]
        yield which[ok], _slot(code), DECAY ** g[-1]
        if len(g) == 3:  # the start of a word counts as a letter before its first
            first = p == starts[which[ok]]
            yield which[ok][first], _slot(code[first] | (_START << 18)), DECAY ** (g[-1] + 1)


class Model:
    """One weight per subsequence, a bias, and the scale from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: np.ndarray, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts))
        for which, code, weight in _subsequences(letters, starts, ends):
            out += np.bincount(which, self.weights[code], len(starts)) * weight
        return out / _NORM[ends - starts] + self.bias

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the largest margin of its words (the bias where there are none), the log of the number of words on the toxic side, and their share."""
        n = len(offsets) - 1
        out = np.zeros((n, 3))
        out[:, 0] = self.bias
        letters, starts, ends, rows = segments(data, offsets)
        if len(starts):
            _, once, back = np.unique(K.segment_hashes(letters, starts, ends, K.RAW_BYTES), return_index=True, return_inverse=True)
            margin = self.margins(letters, starts[once], ends[once])[back]
            np.maximum.at(out[:, 0], rows, margin)
            bad = np.bincount(rows[margin > 0], minlength=n)
            out[:, 1] = np.log1p(bad)
            out[:, 2] = 10 * bad / np.maximum(20, np.bincount(rows, minlength=n))
        return out

    def scores(self, judged: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip(judged, -2, 4) @ self.slope + self.shift, -35, 35)))


#: The model of no labels: every text scores the same, below the threshold.
FLAT = Model(np.zeros(_TABLE, np.float32), -1.0, np.array([1.0, 0.0, 0.0]), -1.0)


def _features(words: list[bytes]) -> list[dict[int, float]]:
    """The unit feature vector of each word of letter codes."""
    out: list[dict[int, float]] = [{} for _ in words]
    ends = np.cumsum([len(w) for w in words])
    letters = np.frombuffer(b"".join(words), np.uint8)
    starts = ends - np.array([len(w) for w in words])
    for which, code, weight in _subsequences(letters, starts, ends):
        for i, c in zip(which.tolist(), code.tolist()):
            out[i][c] = out[i].get(c, 0.0) + weight / _NORM[len(words[i])]
    return out


def _kernel(words: list[bytes], landmarks: list[dict[int, float]]) -> np.ndarray:
    """Kernel values of the words at the landmarks."""
    used = sorted({c for l in landmarks for c in l})
    column = np.full(_TABLE, len(used), np.int64)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j, l in enumerate(landmarks):
        for c, v in l.items():
            table[column[c], j] += v
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    letters = np.frombuffer(b"".join(words), np.uint8)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for which, code, weight in _subsequences(letters, ends - size, ends):
        hit = column[code] < len(used)
        np.add.at(out, which[hit], table[column[code[hit]]] * np.float32(weight))
    return out / _NORM[size][:, None].astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Squared-hinge support vector machine with a bias, by Newton steps on the violators."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    inside = None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        a = x[inside] * c[inside, None]
        w = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
    return w


def _spoilt(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a letter put in at each place in turn, twice, doubled at one, or left out at one."""
    k = int(rng.integers(1, len(word)))
    out = [word[:j] + bytes([int(rng.integers(1, 27))]) + word[j:] for j in range(1, min(len(word), 12)) for _ in range(2)]
    return out + [word[:k] + word[k - 1 : k] + word[k:]] + ([word[:k] + word[k + 1 :]] if len(word) > 5 else [])


def train(bearers: dict[bytes, int], good: list[bytes], n_bad: int) -> Model:
    """Fits the machine. bearers: words that may bear the label and how many toxic texts hold each; good: clean words, the commonest first; n_bad: toxic texts."""
    rng = np.random.default_rng(5)
    few = max(2 if n_bad < 60 else 3, round(0.01 * n_bad))
    ranked = sorted(bearers, key=lambda w: (-bearers[w], w))
    witness = [w for w in ranked if bearers[w] >= few][: LANDMARKS // 2] or ranked[:20]
    if not witness or not good:
        return FLAT
    known = {*bearers, *good}
    near = good[: LANDMARKS // 4] + [good[int(k)] for k in rng.choice(len(good), min(len(good), LANDMARKS // 4), replace=False)]
    chosen_words = list(dict.fromkeys(witness + near))
    landmarks = _features(chosen_words)
    gram = _kernel(chosen_words, landmarks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    ok = values > 1e-6 * values[-1]
    root = (vectors[:, ok] / np.sqrt(values[ok])).astype(np.float32)
    x_good = _kernel(good, landmarks) @ root
    bad_words = sorted(bearers)
    for turn in range(3):
        spoilt = [s for w in [w for w in witness if len(w) > SHORTEST][:SPOILT] for s in _spoilt(w, rng) if len(s) >= 4 and s not in known]
        x = np.vstack([_kernel(witness + spoilt, landmarks) @ root, x_good])
        sign = np.concatenate([np.ones(len(witness) + len(spoilt)), -np.ones(len(x_good))])
        cost = np.concatenate([np.full(len(witness), 8.0), np.full(len(spoilt), 8.0), np.full(len(x_good), 4.0)])
        w = _svm(x, sign, cost)
        model = Model(folded(root @ w[:-1], landmarks), float(w[-1]), np.array([3.0, 0.0, 0.0]), 0.0)
        joined = np.frombuffer(b"".join(bad_words), np.uint8)
        ends = np.cumsum([len(v) for v in bad_words])
        margin = model.margins(joined, ends - [len(v) for v in bad_words], ends)
        # further witnesses: words that bear the label and that the machine puts clearly on that side unseen
        grown = sorted({*witness, *(v for v, m in zip(bad_words, margin) if m > 1.5)}, key=lambda v: (-bearers[v], v))[:WITNESSES]
        if set(grown) == set(witness):
            break
        witness = grown
    return model


def folded(alpha: np.ndarray, landmarks: list[dict[int, float]]) -> np.ndarray:
    """The weight of each subsequence in the sum of the landmarks' kernels times alpha."""
    weights = np.zeros(_TABLE, np.float32)
    for a, l in zip(alpha, landmarks):
        for c, v in l.items():
            weights[c] += a * v
    return weights


def _platt(judged: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The logistic curve from what is judged of a text to its chance, with Platt's softened targets; kinds weigh alike."""
    n1, n0 = y.sum(), (~y).sum()
    goal = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y, 0.5 / n1, 0.5 / n0)
    x = np.column_stack([judged, np.ones(len(judged))])
    b = np.zeros(x.shape[1])
    ridge = np.array([1e-3] * judged.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (p - goal)) + ridge * b)
        b = b - step / max(1.0, float(np.abs(step).max()) / 2)
    b[:-1] = np.maximum(b[:-1], 0.0)
    logit = x @ b
    low, high = np.quantile(logit[~y], 0.999), np.quantile(logit[y], 0.05)
    if high > low:  # where the kinds lie apart, the threshold comes down between them, nearer to the clean
        b[-1] += max(0.0, np.log(THRESHOLD / (1 - THRESHOLD)) - (low + 0.25 * (high - low)))
    return b[:-1], float(b[-1])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, as letter codes, with the text's label."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for lo, _, data, offsets in K.slices(batch.column("text")):
            letters, starts, ends, rows = segments(data, offsets)
            ok = ends - starts >= SHORTEST
            starts, ends, rows = starts[ok], ends[ok], rows[ok]
            _, once = np.unique(K.segment_hashes(letters, starts, ends, K.RAW_BYTES) ^ K.mix64(rows.astype(np.uint64)), return_index=True)
            raw = letters.tobytes()
            for k in range(0, len(once), 10_000):
                part = once[k : k + 10_000]
                word = [raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array([toxic[lo + r] for r in rows[part].tolist()], pa.int64())], ["word", "toxic"])


def _judgements(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch.column("text")):
            j = shared.value.judge(data, offsets)
            yield pa.RecordBatch.from_arrays([*(pa.array(j[:, k]) for k in range(3)), batch.column("toxic").slice(lo, hi - lo)], ["top", "many", "share", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample: of each kind the ``sample`` training rows of the smallest hash."""
    spark = docs.sparkSession
    train_rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"))
    train_rows = train_rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    parts = [train_rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (1, 0)]
    chosen = parts[0].union(parts[1])  # 2 * sample rows at most, so it may be broadcast
    rows = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    numbers = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(numbers) != {0, 1}:
        return FLAT
    back = F.pmod(F.xxhash64("doc_id", F.lit("scale")), F.lit(KEPT_BACK)) == 0 if sum(numbers.values()) >= ENOUGH else F.lit(False)
    n_bad, n_good = (rows.where(~back).where(F.col("toxic") == t).count() for t in (1, 0))
    seen = rows.where(~back).select("text", "toxic").mapInArrow(_bags, "word binary, toxic long").groupBy("word").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    few = max(2 if n_bad < 60 else 3, round(0.01 * n_bad))
    bears = (F.col("b") > 0) & ((F.col("g") == 0) | ((F.col("b") >= few) & (F.col("b") * F.lit(n_good / max(1, n_bad)) >= LIKELIER * (F.col("g") + 0.5))))
    seen = materialize(seen.withColumn("bears", bears), "words")
    bearers = {bytes(r["word"]): r["b"] for r in seen.where("bears").orderBy(F.desc("b"), "word").limit(BEARERS).collect()}
    clean = seen.where("not bears and g > 0")
    common = [bytes(r["word"]) for r in clean.orderBy(F.desc("g"), "word").limit(NEGATIVES // 2).collect()]
    drawn = [bytes(r["word"]) for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES // 2).collect()]
    model = train(bearers, list(dict.fromkeys(common + drawn)), n_bad)
    if model is FLAT:
        return FLAT
    shared = spark.sparkContext.broadcast(model)
    scale = rows.where(back) if sum(numbers.values()) >= ENOUGH else rows
    got = scale.select("text", "toxic").mapInArrow(functools.partial(_judgements, shared=shared), "top double, many double, share double, toxic long").orderBy("top", "many", "share", "toxic").toPandas()
    y = got["toxic"].to_numpy() == 1
    if y.any() and not y.all():
        model.slope, model.shift = _platt(np.clip(got[["top", "many", "share"]].to_numpy(), -2, 4), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document held_out, score and predicted. One narrow pass, written at once so that its Arrow batches may be small; the model is a table of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in K.slices(batch.column("text")):
                s = shared.value.scores(shared.value.judge(data, offsets))
                own = ids.slice(lo, hi - lo)
                out = K.crc_of_ids(own.to_pylist()) % 3 == 1
                yield pa.RecordBatch.from_arrays([own, pa.array(out), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT), "scores")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
