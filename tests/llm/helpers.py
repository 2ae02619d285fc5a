"""Small tables and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve é ü ß".split()


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t", "one", "two words", "A" * 900, "ab " * 400, prose(rng, 3000)]
    while len(texts) < n:
        texts.append(prose(rng, rng.choice([5, 30, 80, 200])))
    passage = prose(rng, 70)
    for k in range(10, 20):
        texts[k] = f"{prose(rng, 30)} {passage} {prose(rng, 30)}"
    base = texts[30] = prose(rng, 150)
    for k in range(31, 36):
        w = base.split(" ")
        for _ in range(k - 30):
            w[rng.randrange(len(w))] = "changed"
        texts[k] = " ".join(w)
    texts[36] = base.upper()
    texts[37] = texts[38] = base
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4] if i % 9 else "a", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


def brute_repeats(texts: list[str | None], length: int = 200) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen: Counter = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def brute_groups(rows: list[tuple]) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    ids, near = sorted(sets), defaultdict(set)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in ids:
        todo, got = [i], {i}
        while todo:
            for x in near[todo.pop()] - got:
                got.add(x)
                todo.append(x)
        out[i] = (len(sets[i]), min(got), min(got) == i)
    return out


def brute_contamination(text: str | None, items: list[tuple]) -> tuple:
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        p = cut(t)
        k = min(13, len(p))
        windows = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def brute_quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text, lower=False)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def brute_targets(sizes: dict) -> dict:
    """Shares of 150 % by weight, capped at twice a source and reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out
