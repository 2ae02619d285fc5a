"""Language identification against plain dictionaries, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import kernels, language

from .helpers import DOCS

SOUNDS = {"en": "th er on an the ing and of to ly", "de": "sch ei und der ung ß ö die lich ver", "fr": "eau oi é les que ai è aux ent re", "ru": "пр ов ен ст го на ть ия ж ы"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize()


def rows_of(seed: int = 3, n: int = 240) -> list[tuple]:
    rng = random.Random(seed)
    langs = ["en", "en", "en", *SOUNDS]
    out = []
    for i in range(n):
        lang = langs[i % len(langs)]
        out.append((i, prose(rng, lang, rng.choice([3, 20, 60])), lang, "a", 0))
    return out


def brute_model(words: Counter) -> callable:
    """log2 of the probability of a character after a context, by the textbook's recursion on dictionaries."""
    n = language.ORDER
    counts: dict[int, Counter] = {n: Counter()}
    for w, times in words.items():
        s = "\x02" * (n - 1) + w + " "
        for i in range(n - 1, len(s)):
            counts[n][s[i - n + 1 : i + 1]] += times
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: language.discount(np.array(list(c.values()))) for k, c in counts.items()}
    total, kinds = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, times in c.items():
            total[k][g[:-1]] += times
            kinds[k][g[:-1]] += 1

    def p(context: str, char: str, k: int) -> float:
        if not k:
            return 1 / language.ALPHABET
        h = context[len(context) - k + 1 :] if k > 1 else ""
        lower = p(context, char, k - 1)
        if h not in total[k]:
            return lower
        return max(counts[k][h + char] - cut[k], 0) / total[k][h] + cut[k] * kinds[k][h] / total[k][h] * lower

    return lambda context, char: math.log2(p(context, char, n))


def test_model_equals_the_recursion():
    rng = random.Random(1)
    words = Counter(prose(rng, "de", 300).lower().split())
    codes = defaultdict(int)
    chars = language.Characters(list(words))
    for row, w in zip(np.stack(chars.columns(), 1).tolist(), chars.word.tolist()):
        codes[tuple(row)] += words[list(words)[w]]
    model = language.kneser_ney(np.array(list(codes), np.uint32), np.array(list(codes.values())))
    log2 = brute_model(words)
    asked = [*list(words)[:20], "schöne", "zzz", "日本"]
    got = language.word_bits(asked, [model])[:, 0]
    for w, bits in zip(asked, got):
        s = "\x02" * (language.ORDER - 1) + w + " "
        assert math.isclose(bits, -sum(log2(s[i - language.ORDER + 1 : i], s[i]) for i in range(language.ORDER - 1, len(s))), rel_tol=1e-9)


def test_probabilities_add_up():
    """After any context the characters of the alphabet, seen or not, share all there is."""
    words = Counter("abab abc cab bca aaa".split())
    chars = language.Characters(list(words))
    grams, n = np.unique(np.stack(chars.columns(), 1), axis=0, return_counts=True)
    model = language.kneser_ney(grams, n)
    for context in ("\x02\x02\x02\x02", "\x02\x02\x02a", "abab", "zzzz"):
        total = 0.0
        for c, times in (("a", 1), ("b", 1), ("c", 1), (" ", 1), ("é", language.ALPHABET - 4)):
            columns = [np.array([ord(x)], np.uint32) for x in context + c]
            g, h = language._hashes(columns), language._hashes(columns[:-1])
            p = language._found(model.grams, model.direct, g[0], 0.0) + model.back_to_none / language.ALPHABET
            for k in range(1, language.ORDER):
                p = language._found(model.grams, model.direct, g[k], 0.0) + language._found(model.contexts, model.back, h[k - 1], 1.0) * p
            total += times * float(p[0])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_words_and_letters():
    texts = ["Ab ab 12 — é", None, "", "***", "日本 12日", "a1b"]
    for size in (1, 1 << 20):
        got = []
        for _, _, data, offsets in kernels.slices(pa.array(texts), size):
            w = language.words_of(data, offsets)
            got += [sorted(w.word[k] for k in w.number[w.rows == i]) for i in range(len(offsets) - 1)]
        assert got == [["ab", "ab", "é"], [], [], [], ["日", "日本"], ["a", "b"]]


def test_language_id(spark):
    rows = rows_of()
    odd = [(1000, None, "en", "a", 0), (1001, "", "de", "a", 0), (1002, "12 *** 34", None, "a", 0), (None, prose(random.Random(5), "ru", 30), "ru", "a", 0), (1003, prose(random.Random(6), "fr", 5000), None, "a", 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, DOCS).repartition(5)
    for c in ("held_out", "score", "lang_pred", "_n", "_u", "word", "calibrates"):
        df = df.withColumn(c, F.lit("clash"))
    got = language.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    for i in (1000, 1001, 1002):
        assert [(r["lang_pred"], r["score"], r["rejected"]) for r in by[i]] == [("und", 0.0, True)]
    assert by[None][0]["lang_pred"] == "ru" and by[1003][0]["lang_pred"] == "fr" and len({tuple(r) for r in by[0]}) == 1
    held = [(i, lang) for i, _, lang, _, _ in rows if by[i][0]["held_out"]]
    assert len(held) > 30 and sum(by[i][0]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    again = {r["doc_id"]: tuple(r) for r in language.identify(df.repartition(3)).collect()}
    assert again == {r["doc_id"]: tuple(r) for r in got}


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = rows_of(n=120)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    plain = {r["doc_id"]: tuple(r) for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    other = [(i, t, "xx" if held(i) else lang, s, n) for i, t, lang, s, n in rows]
    assert {r["doc_id"]: tuple(r) for r in language.identify(spark.createDataFrame(other, DOCS)).collect()} == plain


def test_nothing_to_learn_from(spark):
    rows = [(i, "some words", None, "a", 0) for i in range(5)]
    got = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "some words", "en", "a", 0) for i in range(9)], DOCS)
    assert {r["lang_pred"] for r in language.identify(one).collect()} == {"en"}
    assert language.identify(one.limit(0)).count() == 0


def test_unlike_texts_are_rejected(spark):
    """Letters that no language has cost more than the languages' own texts do."""
    rng = random.Random(8)
    strange = ["".join(rng.choice("ωψχφξ") for _ in range(6)) for _ in range(80)]
    rows = [*rows_of(n=400), (5000, " ".join(strange), None, "a", 0)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5000]["rejected"] and sum(got[i]["rejected"] for i in range(400)) < 40
