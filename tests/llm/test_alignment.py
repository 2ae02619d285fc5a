"""Alignment of two tokenizers against a walk over whole texts, token by token."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, kernels

from .helpers import corpus, prose

ODD = [None, "", " ", "  a  b\n\n  c 　 d  e", "a ▁ b", "<|endoftext|> x <s>y</s> <unk>", "it's we'll\tX\r\n 日本語 テキスト 🙂 🙂x \x00\x01", "x" * 3000]
ODD += ["a" + " " * 300 + "b", "\u0085 a  b  c é é", "é ́ x ", " 's 's", "  x 　 y  z", "Ā ā œ œ", "a\u0085 b", "tail \n"]


def whole_text(pair: alignment.Pair, text: str | None) -> tuple | None:
    """Ids and bytes of the tokens of a text that is tokenised as one."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    left, right = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    raw = (" " + text).encode()
    return (a, b, left, right) if b"".join(left) == raw == b"".join(right) else None


def brute(pair: alignment.Pair, rows: list[tuple]) -> dict:
    found, counts = {}, Counter()
    for i, text in rows:
        x = whole_text(pair, text)
        if x is None:
            continue
        a, b, left, right = x
        ends_a, ends_b = np.cumsum([len(t) for t in left]).tolist(), np.cumsum([len(t) for t in right]).tolist()
        links = [(p, q) for p in range(len(a)) for q in range(max(0, np.searchsorted(ends_b, ends_a[p] - len(left[p]), "right")), len(b)) if ends_b[q] - len(right[q]) < ends_a[p]] if len(a) < 400 else None
        if links is None:  # the same by walking along both
            links, p, q = [], 0, 0
            while p < len(a):
                links.append((p, q))
                step = ends_a[p] - ends_b[q]
                p, q = p + (step <= 0), q + (step >= 0)
        shared = sorted(set(ends_a) & set(ends_b))
        groups = []
        low = 0
        for end in shared:
            groups.append(",".join(str(t) for t, e in zip(a, ends_a) if low < e <= end) + "|" + ",".join(str(t) for t, e in zip(b, ends_b) if low < e <= end))
            low = end
        found[i] = (len(a), len(b), len(groups), [(a[p], b[q]) for p, q in links], hashlib.sha256(";".join(groups).encode()).hexdigest())
        counts.update(found[i][3])
    best: Counter = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = {i: (0, 0, 0, 0, 0, 0, "") for i, _ in rows}
    return out | {i: (x[0], x[1], x[2], len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), x[4]) for i, x in found.items()}


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.FOLDER)


def test_pieces_give_the_tokens_of_whole_texts(pair):
    rng = random.Random(1)
    texts = ODD + [prose(rng, 50) for _ in range(20)] + ["".join(rng.choice("ab é\u0085 　\n\t .'s1") for _ in range(60)) for _ in range(300)]
    for target in (1, 1 << 20):
        for lo, hi, data, offsets in kernels.slices(pa.array(texts), target):
            found = alignment.align_texts(data, offsets, pair)
            x = found.aligned
            a, b = np.split(x.a.ids, np.cumsum(x.n_a)), np.split(x.b.ids, np.cumsum(x.n_b))
            for k in range(hi - lo):
                want = whole_text(pair, texts[lo + k])
                assert (a[k].tolist(), b[k].tolist()) == (([], []) if want is None else want[:2]), texts[lo + k]
                assert found.known[k] == (want is not None)


def test_bytes_of_the_vocabulary():
    letters = alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["Ċ"] == 10 and letters["a"] == 97


def test_alignments(spark, pair):
    rows = [(i, r[1]) for i, r in enumerate(corpus())] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "same text"), (2001, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("task", "pair", "total", "best", "n_a", "b", "place", "kind"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignments(df).collect()}
    assert got == brute(pair, rows) and got[1000] == (0, 0, 0, 0, 0, 0, "") and got[2000] == got[2001]
    with_null = alignment.alignments(df.withColumn("doc_id", F.when(F.col("doc_id") != 2000, F.col("doc_id")))).where("doc_id is null").collect()
    assert [tuple(r)[1:] for r in with_null] == [got[2000]]
    assert alignment.alignments(df.limit(0)).count() == 0


def test_what_is_remembered_is_bounded(pair, monkeypatch):
    """Forgetting pieces changes nothing."""
    rng = random.Random(2)
    texts = pa.array([prose(rng, 40) for _ in range(30)])
    seen = []
    for limit in (400_000, 50):
        monkeypatch.setattr(alignment, "REMEMBERED", limit)
        pair.forget()
        seen.append([d for _, _, data, offsets in kernels.slices(texts, 500) for d in alignment.align_texts(data, offsets, pair).digests])
    assert seen[0] == seen[1] and len(pair.number) < 400


def test_ranks_give_the_same_tokens(pair):
    rng = random.Random(3)
    assert pair.fast is not None
    latin = [chr(c) for c in range(1, 0x250)]
    for n in range(400):
        text = " " + "".join(rng.choice(latin if n % 2 else list("abc XYZ 0129 's't're ,.!?\n\t'")) for _ in range(rng.randrange(1, 60)))
        assert pair.fast.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids
    assert alignment.ranked([["a", "b"]], {"a": 0, "b": 1, "c": 2, "ab": 2}, [b"a", b"b", b"c"]) is None
