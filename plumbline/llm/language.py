"""Language identification by interpolated Kneser-Ney character models, one a language.

A word is a run of letters (bytes that are ASCII letters or not ASCII),
lower-cased and closed by a space; each of its characters is predicted from the
four before it in the word. A model holds the discounted probability of every
n-gram and the back-off weight of every context as two arrays sorted by 64-bit
hashes. A text is given the language in which its words cost the fewest bits a
character; each distinct word of a slice of texts is looked up once.

The models are fitted on about ``SAMPLE`` training texts of each language,
chosen by a hash of id and text, so the models have a bounded size whatever the
corpus. Words and their n-grams are counted by Spark; one language's distinct
n-grams are the largest thing a task holds. A fifth of the sample is kept from
the counts and calibrates: a logistic curve turns the margin over the runner-up
and the length into ``score``, and the 99.5 % point of the bits a character of
each language marks texts as ``rejected`` that are like none of the languages.

Defined results: a null text or one without a letter is ``und`` with score 0 and
is rejected, and so is everything where nothing can be learned; ties go to the
language that comes first by code point; with one language the margin is 0; a
null id is hashed as the empty text; repeated rows are judged alike; an empty
table gives no rows; columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import storage

#: About how many training texts of each language the models are fitted on, and the share of them that calibrates.
SAMPLE = 2_000
CALIBRATES = 0.2
#: Up to so many languages, their sizes are sent to every executor to draw the sample; beyond, they are joined by shuffling.
FEW = 10_000
#: Characters of an n-gram, and the alphabet of a character that no text of the sample holds.
ORDER = 5
ALPHABET = 4096
#: The share of a language's own calibration texts that is below its limit of bits a character.
USUAL = 0.995
SLICE = 2 << 20
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, bits_per_char double, margin double"

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_START, _CLOSE = "\x02", " "


def _hashes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the n-grams of 1, 2, ... characters that end in the last column."""
    out, h = [], np.zeros(len(columns[-1]), _U)
    for c in reversed(columns):
        h = K.mix64(h * _MIX + c.astype(_U) + _U(1))
        out.append(h)
    return out


class Model(NamedTuple):
    """Of one language; both arrays of hashes are sorted."""

    grams: np.ndarray
    direct: np.ndarray
    contexts: np.ndarray
    back: np.ndarray
    back_to_none: float


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the n-grams seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of distinct n-grams of ORDER characters (a row each) and their counts; a shorter one counts the characters seen before it."""
    parts: list[tuple] = []
    back_to_none = 1.0
    for k in range(ORDER, 0, -1):
        columns = [grams[:, j] for j in range(k)]
        key = _hashes(columns)[-1]
        d = discount(counts)
        context = _hashes(columns[:-1])[-1] if k > 1 else np.zeros(len(key), _U)
        held, _, number = K.unique(context)
        total, kinds = np.bincount(number, counts), np.bincount(number)
        order = np.argsort(key)
        direct = np.maximum(counts - d, 0) / total[number]
        back = d * kinds / total
        if k > 1:
            parts.append((key[order], direct[order], held, back))
            _, first, number = K.unique(_hashes(columns[1:])[-1])
            grams, counts = grams[first, 1:], np.bincount(number)
        else:
            parts.append((key[order], direct[order], np.zeros(0, _U), np.zeros(0)))
            back_to_none = float(back[0]) if len(back) else 1.0
    key, direct, context, back = (np.concatenate(x) for x in zip(*parts))
    a, b = np.argsort(key), np.argsort(context)
    return Model(key[a], direct[a], context[b], back[b], back_to_none)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), otherwise)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


class Words(NamedTuple):
    """The distinct words of a slice of texts that have a letter, and where they occur."""

    rows: np.ndarray  # of each occurrence the text
    number: np.ndarray  # and the word
    word: list[str]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    found = K.find_words(data, offsets, _LETTERS)
    number = K.classes(data, found.starts, found.ends)
    _, first = np.unique(number, return_index=True)
    raw = data.tobytes()
    word = [raw[a:b].decode().lower() for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())]
    lettered = np.fromiter((any(map(str.isalpha, w)) for w in word), bool, len(word))
    place = np.cumsum(lettered) - 1
    at = lettered[number]
    return Words(found.rows()[at], place[number[at]], [w for w, ok in zip(word, lettered.tolist()) if ok])


class Characters:
    """The characters to be predicted, of words one after the other."""

    def __init__(self, words: list[str]):
        text = "".join(f"{_START * (ORDER - 1)}{w}{_CLOSE}" for w in words)
        self.code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.word = np.repeat(np.arange(len(words)), self.size)
        start = np.cumsum(self.size + ORDER - 1) - self.size
        self.at = np.arange(len(self.word)) - np.repeat(np.cumsum(self.size) - self.size, self.size) + np.repeat(start, self.size)

    def columns(self) -> list[np.ndarray]:
        return [self.code[self.at - k] for k in range(ORDER - 1, -1, -1)]


def word_bits(words: list[str], models: list[Model]) -> np.ndarray:
    """The bits of each word (a row) in each model (a column)."""
    out = np.zeros((len(words), len(models)))
    if not words:
        return out
    chars = Characters(words)
    columns = chars.columns()
    _, first, number = K.unique(_hashes(columns)[-1])
    columns = [c[first] for c in columns]
    grams, contexts = _hashes(columns), _hashes(columns[:-1])
    for m, model in enumerate(models):
        p = _found(model.grams, model.direct, grams[0], 0.0) + model.back_to_none / ALPHABET
        for k in range(1, ORDER):
            p = _found(model.grams, model.direct, grams[k], 0.0) + _found(model.contexts, model.back, contexts[k - 1], 1.0) * p
        out[:, m] = np.bincount(chars.word, -np.log2(p)[number], len(words))
    return out


def costs(data: np.ndarray, offsets: np.ndarray, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """The bits a character of each text in each model, and its characters (0: no word with a letter)."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    bits = word_bits(words.word, models)
    size = np.fromiter(map(len, words.word), np.int64, len(words.word)) + 1
    chars = np.bincount(words.rows, size[words.number], n).astype(np.int64)
    per = np.stack([np.bincount(words.rows, bits[words.number, m], n) / np.maximum(chars, 1) for m in range(len(models))], 1) if models else np.zeros((n, 0))
    return per, chars


def chosen(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the cheapest model, its bits a character, and the margin over the runner-up."""
    best = per.argmin(1)
    low = per[np.arange(len(per)), best]
    margin = np.partition(per, 1, axis=1)[:, 1] - low if per.shape[1] > 1 else np.zeros(len(per))
    return best, low, margin


class Calibration(NamedTuple):
    weights: np.ndarray
    limits: np.ndarray  # bits a character, one a language


def features(margin: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(margin)), np.log1p(50 * margin), np.log1p(chars) / 4], 1)


def fit_curve(x: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method with a small penalty that keeps them finite."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (right - p) - 0.1 * w
        bend = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def _training(docs: DataFrame) -> DataFrame:
    """The sampled training rows: doc_id, text, lang and whether they calibrate."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where((F.crc32(key) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = storage.materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    drawn = F.pmod(F.xxhash64(F.lit("language"), key, F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(sizes, "lang").withColumn("_u", drawn * F.col("_n") / F.lit(float(SAMPLE))).where("_u < 1")
    apart = F.pmod(F.xxhash64(F.lit("calibrates"), key, F.col("text")), F.lit(1000)) < int(1000 * CALIBRATES)
    return rows.select("doc_id", "text", "lang", apart.alias("calibrates"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each slice of texts."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code, names = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang.dictionary
        for lo, hi, data, offsets in K.slices(batch.column("text"), SLICE):
            words = words_of(data, offsets)
            pair, _, number = K.unique(code[lo:hi][words.rows] * len(words.word) + words.number)
            n = np.bincount(number, minlength=len(pair))
            which, word = (pair // max(1, len(words.word))), pair % max(1, len(words.word))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)).cast(pa.string()), pa.array(words.word, pa.string()).take(pa.array(word)), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of distinct words and their counts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            chars = Characters(part.column("word").to_pylist())
            codes = np.ascontiguousarray(np.stack(chars.columns(), 1))
            text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(codes), [None, pa.py_buffer(codes.tobytes())])
            n = part.column("n").to_numpy()[chars.word]
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(chars.word)), text.cast(pa.binary()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One row of arrays from the n-grams of one language."""
    group = group.sort_values("gram")
    grams = np.frombuffer(b"".join(group["gram"]), np.uint32).reshape(-1, ORDER)
    m = kneser_ney(grams, group["n"].to_numpy())
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "grams": [m.grams.tobytes()], "direct": [m.direct.astype(np.float32).tobytes()], "contexts": [m.contexts.tobytes()], "back": [m.back.astype(np.float32).tobytes()], "none": [m.back_to_none]})


def fit_models(sample: DataFrame) -> tuple[list[str], list[Model]]:
    """The languages in order of code points, and their models. One bounded model a language comes to the driver."""
    words = sample.where("NOT calibrates").select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_count_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = grams.groupBy("lang").applyInPandas(_fit, "lang string, grams binary, direct binary, contexts binary, back binary, none double").collect()
    rows.sort(key=lambda r: r["lang"])
    array = lambda x, kind: np.frombuffer(bytes(x), kind)
    models = [Model(array(r["grams"], _U), array(r["direct"], np.float32), array(r["contexts"], _U), array(r["back"], np.float32), r["none"]) for r in rows]
    return [r["lang"] for r in rows], models


def _calibrate(sample: DataFrame, langs: list[str], models) -> Calibration:
    """From the texts kept apart; a few numbers of each of them, at most about SAMPLE a language, come to the driver."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column("text"), SLICE):
                per, chars = costs(data, offsets, models.value)
                best, low, margin = chosen(per)
                own = np.array([langs.index(x) if x in langs else -1 for x in batch.column("lang").slice(lo, hi - lo).to_pylist()])
                some = pa.array(chars > 0)
                cols = [pa.array(own, pa.int64()), pa.array(best, pa.int64()), pa.array(low), pa.array(margin), pa.array(chars, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["own", "best", "low", "margin", "chars"]).filter(some)

    rows = sample.where("calibrates").select("lang", "text").mapInArrow(judged, "own long, best long, low double, margin double, chars long").toPandas()
    rows = rows.sort_values(list(rows.columns))
    own, best = rows["own"].to_numpy(), rows["best"].to_numpy()
    weights = fit_curve(features(rows["margin"].to_numpy(), rows["chars"].to_numpy()), (own == best).astype(float))
    limits = np.full(len(langs), np.inf)
    for k in range(len(langs)):
        low = rows["low"].to_numpy()[(own == k) & (best == k)]
        if len(low):
            limits[k] = np.quantile(low, USUAL)
    return Calibration(weights, limits)


class Languages(NamedTuple):
    """What ``fit`` learns and ``predict`` needs."""

    langs: list[str]
    models: object  # a broadcast list of Model
    calibration: Calibration | None


def fit(docs: DataFrame) -> Languages:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 0 and whose lang is known."""
    sample = storage.materialize(_training(docs), "languages")
    langs, models = fit_models(sample)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return Languages(langs, shared, _calibrate(sample, langs, shared) if langs else None)


def predict(docs: DataFrame, learned: Languages) -> DataFrame:
    """One row a document, in one narrow pass."""
    langs, shared, calibration = learned
    names = np.array([*langs, "und"], object)

    @K.frees
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column("text"), SLICE):
                ids = batch.column("doc_id").slice(lo, hi - lo)
                per, chars = costs(data, offsets, models)
                some = chars > 0
                if langs:
                    best, low, margin = chosen(per)
                    score = 1 / (1 + np.exp(-np.clip(features(margin, chars) @ calibration.weights, -30, 30)))
                    rejected = (low > calibration.limits[best]) | (score < 0.5)
                else:
                    some = np.zeros(hi - lo, bool)
                    best, low, margin, score, rejected = np.zeros(hi - lo, np.int64), *np.zeros((3, hi - lo)), ~some
                cols = [ids, pa.array(K.crc_of_ids(ids.to_pylist()) % 5 == 0), pa.array(names[np.where(some, best, len(langs))], pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(rejected | ~some), pa.array(np.where(some, low, 0.0)), pa.array(np.where(some, margin, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judged, RESULT)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the training rows of ``docs`` and predicts every row."""
    return predict(docs, fit(docs))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
