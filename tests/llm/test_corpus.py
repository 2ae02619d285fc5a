"""Near-duplicates, repeated strings, mixing, language-model scores, toxicity and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, kernels, lm_scoring, minhash, mixing, quality, storage, suffixes, toxicity

from .helpers import DOCS, brute_contamination, brute_groups, brute_quality, brute_repeats, brute_targets, corpus, prose, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_kernels():
    rng = random.Random(2)
    texts = [prose(rng, k) + " \t\n" * (k % 3) for k in range(40)] + [None, "", "a\x00b", " x"]
    for target in (1, 100, 1 << 20):
        got = []
        for _, _, data, offsets in kernels.slices(pa.array(texts), target):
            w = kernels.find_words(data, offsets, kernels.SPACED)
            raw = data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
        assert got == [words(t, lower=False) for t in texts]
    data = np.frombuffer(b"abcABCabc", np.uint8)
    a, b, c = kernels.segment_hashes(data, np.array([0, 3, 6]), np.array([3, 6, 9]), kernels.FOLDED_BYTES)
    assert a == b == c and a != kernels.segment_hashes(data, np.array([0]), np.array([2]), kernels.FOLDED_BYTES)[0]


def test_near_duplicates(spark, rows):
    df = spark.createDataFrame([*rows, (300, rows[40][1], "en", "b", 0)], DOCS).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.duplicate_groups(df).collect()}
    want = brute_groups([*rows, (300, rows[40][1], "en", "b", 0)])
    assert got == want and any(v[1] != k for k, v in want.items())
    left = minhash.drop_duplicates(df).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(k for k, v in want.items() if v[2])
    assert minhash.duplicate_groups(df.limit(0)).count() == 0


def test_chains_behind_a_star(spark, monkeypatch):
    """Members that are unlike the hub but like each other are linked all the same, also across blocks of a bucket."""
    monkeypatch.setattr(minhash, "CROWD", 2)
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    rows = []
    for k in range(24):
        w = list(base)
        for j in range(6 * (k // 3)):
            w[(17 * j) % 120] = f"new{j}x{k // 6}"
        rows.append((1000 - k, " ".join(w), "en", "a", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.duplicate_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_groups(rows)


def test_between_blocks(spark, monkeypatch):
    """Members of mixed buckets are compared whatever their blocks, and what stars leave open is linked."""
    monkeypatch.setattr(minhash, "CROWD", 7)
    rng = np.random.default_rng(4)
    sets = []
    for trial in range(12):
        base = np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64))
        sets += [np.unique(np.append(base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, 3).astype(np.uint64))) for _ in range(6)]
    df = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "id long, keys binary")
    links = minhash.between(df.select(F.lit(1).alias("bucket"), "id", F.col("id").alias("component")), df).collect()
    want = [(a, b) for a in range(len(sets)) for b in range(a) if minhash._alike(sets[a], sets[b])]
    got = minhash.components(spark.createDataFrame(links)).collect()
    assert {r["id"]: r["component"] for r in got} == {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(want, "a long, b long")).collect()}


def test_width_and_clashing_names(spark, rows):
    five = {r["doc_id"]: r["n_shingles"] for r in minhash.duplicate_groups(spark.createDataFrame(rows, DOCS), 5).collect()}
    for r in rows:
        w = words(r[1])
        assert five[r[0]] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w))
    df = spark.createDataFrame([*rows, (None, rows[30][1], "en", "a", 1), (None, rows[30][1], "en", "a", 2)], DOCS)
    for c in ("gone", "_gone", "id", "component_id", "kept", "bucket", "c0"):
        df = df.withColumn(c, F.lit(c))
    left = minhash.drop_duplicates(df)
    assert left.columns == df.columns and left.where("doc_id is null").count() == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    texts = [r[1] for r in rows] + ["é" * 300, "aé" * 150, rows[7][1][500:900] + "!" + rows[7][1][650:1000], "z" * 199, "z" * 200, rows[12][1][:230], rows[12][1][30:260]]
    texts += ["".join(rng.choice("ab") for _ in range(500)), texts[20], texts[20]]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).repartition(5).withColumn("spans", F.lit("clash")).withColumn("_row", F.lit(1)).withColumn("row", F.lit("c")).withColumn("n_bytes", F.lit(2))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(df).collect()}
    want = brute_repeats(texts)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)} and sum(w[1] for w in want) > 5000
    cut = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(df).collect()}
    assert suffixes.remove_repeats(df).columns == df.columns
    assert cut == {i: None if t is None else w[3].decode("utf-8", "ignore") for i, (t, w) in enumerate(zip(texts, want))}
    assert suffixes.repeats(df.limit(0)).count() == 0


def test_multikey_quicksort():
    """The order and the common prefixes are those of plain sorting."""
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab\0") for _ in range(900)) + b"same" * 90 + bytes(rng.choice(b"xyz") for _ in range(50)) * 4
    data = np.frombuffer(text, np.uint8)
    for starts in (np.arange(len(text) - 40), np.array([rng.randrange(len(text) - 40) for _ in range(300)]), np.array([5]), np.zeros(0, np.int64)):
        order, common = suffixes.multikey_quicksort(suffixes.symbols(data), starts, 5)
        got = [text[a : a + 40] for a in starts[order]]
        assert sorted(order) == list(range(len(starts))) and got == sorted(got)
        for x, y, c in zip(got, got[1:], common[1:]):
            assert c == next((k for k in range(5) if x[8 * k : 8 * k + 8] != y[8 * k : 8 * k + 8]), 5)


def ends_of_passages() -> list[tuple]:
    """Passages of over 50 words in texts that differ before and behind, so that their ends are left to the sort."""
    rng = random.Random(77)
    passage = [prose(rng, 70), prose(rng, 60)]
    return [(k, f"{prose(rng, rng.randint(5, 60))} {passage[k % 2]} {prose(rng, rng.randint(5, 60))}", "en", "a", 0) for k in range(24)]


def digest_rows(texts: list[str]) -> dict:
    return {k: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for k, w in enumerate(brute_repeats(texts))}


@pytest.mark.parametrize("hot, spread, held", [(1024, 64, 1 << 13), (3, 64, 1 << 13), (1024, 2, 1 << 13), (3, 0, 8)])
def test_leads_of_many_texts(spark, monkeypatch, hot, spread, held):
    """A lead that more texts share than are compared together is taken in ranges of windows, with the same result."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SPREAD", spread)
    monkeypatch.setattr(suffixes, "HELD_SPANS", held)
    monkeypatch.setattr(suffixes, "LONGEST", 1 << 18 if hot > 3 else 450)  # long texts are looked at in stretches
    rows = ends_of_passages()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == digest_rows([r[1] for r in rows])


def test_a_head_that_all_texts_share(spark, monkeypatch):
    """One head before unlike tails: the same result, no bucket holds many of its entries, and less than twice the texts is written."""
    rng = random.Random(5)
    head = prose(rng, 200)[:600]
    texts = [head + prose(rng, 25) for _ in range(1200)] + [prose(rng, 20) + head[200:] for _ in range(300)]
    sizes, real = {}, suffixes.materialize

    def kept(df, name):
        out = real(df, name)
        key = {"asked": "key", "windows": "digest"}.get(name)
        most = out.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] if key else None
        sizes[name] = sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles()), most or 0
        return out

    monkeypatch.setattr(suffixes, "materialize", kept)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOCS).repartition(3)).collect()}
    assert got == digest_rows(texts)
    assert sum(v[0] for k, v in sizes.items() if k in ("suffixes", "asked", "ranges", "windows")) < 2 * sum(map(len, texts))
    assert max(sizes["asked"][1], sizes["windows"][1]) <= suffixes.HOT


def test_the_sort_decides_repeats(spark, monkeypatch):
    """Without the sort, or without the comparison of neighbours, repeated strings go unfound."""
    rows = ends_of_passages()
    spans = [r[1].encode()[a : a + 300] for r in rows for a in range(0, max(1, len(r[1].encode()) - 320), 90)]
    whole = set(zip(*map(np.ndarray.tolist, suffixes.repeated_windows(spans))))
    seen = Counter(s[i : i + 200] for s in spans for i in range(len(s) - 199))
    assert whole == {(k, i) for k, s in enumerate(spans) for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1}
    real = suffixes.multikey_quicksort

    def unsorted(symbol, starts, depth):
        order = np.arange(len(starts))
        alike = [all(symbol[a + 8 * k] == symbol[b + 8 * k] for k in range(depth)) for a, b in zip(starts, starts[1:])]
        return order, np.append(0, np.array(alike, np.int64) * depth)

    for broken in (unsorted, lambda s, a, d: (real(s, a, d)[0], np.zeros(len(a), np.int64))):
        monkeypatch.setattr(suffixes, "multikey_quicksort", broken)
        assert len(suffixes.repeated_windows(spans)[0]) < len(whole) / 2


def test_mixing(spark, rows):
    rows = [*rows, (500, prose(random.Random(8), 4000), "en", "b", 0), (None, "no id here", "en", "c", 0), (501, "x y z", "en", "z", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    got = mixing.draws(df).collect()
    by = defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        by[source[r["doc_id"]]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and sum(d["words"] for d in r["drawn"]) == r["taken"]
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in set(source.values())}
    want = brute_targets(sizes)
    for s, rs in by.items():
        assert rs[0]["source_size"] == sizes[s] and rs[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= 1
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"])
    assert sorted(got, key=key) == sorted(mixing.draws(df.repartition(3)).collect(), key=key)
    mixed = mixing.mix(df.drop("target")).collect()
    assert sum(r["mix_words"] for r in mixed) == sum(r["taken"] for r in got)
    assert all(len(words(r["text"], False)) == r["mix_words"] for r in mixed)
    assert mixing.draws(df.limit(0)).count() == 0 and mixing.mix(df.drop("target").limit(0)).count() == 0


def test_mixing_of_rows_without_ids_and_repeats(spark, tmp_path):
    """Each row has its own draws, however many share its id, size or text."""
    rows = [(None, f"w{k} " * (k % 5 + 1), "en", "ab"[k % 2], 0) for k in range(40)] + [(7, "same text here", "en", "a", 0)] * 3 + [(k, prose(random.Random(k), 20), "en", "c", 0) for k in range(10, 40)]
    df = spark.createDataFrame(rows, DOCS)
    df.repartition(3).write.parquet(f"{tmp_path}/docs.parquet")
    clash = mixing.mix(df.withColumn("mix_shard", F.lit("x")).withColumn("_d", F.lit(1)).withColumn("_order", F.lit(2)).withColumn("_size", F.lit(3)).withColumn("row", F.lit(4)))
    assert clash.columns == [*df.columns, "_d", "_order", "_size", "row", "mix_shard", "mix_pass", "mix_words"] and clash.count() == mixing.mix(df).count()
    for docs in (df, spark.read.parquet(f"{tmp_path}/docs.parquet")):
        got, mixed = mixing.draws(docs).collect(), mixing.mix(docs).collect()
        assert mixing.mix(docs).columns == [*docs.columns, "mix_shard", "mix_pass", "mix_words"]
        assert Counter((r["doc_id"], d["pass"], d["shard"], d["words"]) for r in got for d in r["drawn"]) == Counter((r["doc_id"], r["mix_pass"], r["mix_shard"], r["mix_words"]) for r in mixed)
        assert all(len(words(r["text"], False)) == r["mix_words"] for r in mixed)
        want = brute_targets({s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in "abc"})
        for s in "abc":
            assert abs(sum(r["mix_words"] for r in mixed if r["source"] == s) - want[s]) <= 1


def test_split_tree():
    counts, names = [5, 0, 17, 100], ["sa", "sb", "sc", ""]
    got = mixing.split_tree(counts, names, 7, 17)
    assert (got.sum(axis=0) == counts).all() and got.min() >= 0 and np.ptp(got.sum(axis=1)) <= 3
    assert (got == mixing.split_tree(counts, names, 7, 17)).all() and (got != mixing.split_tree(counts, names, 7, 18)).any()
    assert not mixing.split_tree([], [], 4, 17).size


@pytest.mark.parametrize("marked, total, take", [(3, 9, 4), (6, 10, 7), (1, 1, 1), (0, 5, 2), (5, 5, 3)])
def test_hypergeometric(marked, total, take):
    """Quantiles of evenly spread numbers occur as often as among all choices, one by one."""
    every = Counter(sum(x < marked for x in pick) for pick in itertools.combinations(range(total), take))
    n = sum(every.values())
    got = Counter(mixing.hypergeometric((k + 0.5) / (n * 4), marked, total, take) for k in range(4 * n))
    assert got == {k: 4 * v for k, v in every.items()}


def test_the_tree_decides_shards(spark, duck, tmp_path, monkeypatch):
    """The shards of the query are those of its SQL, and others once the draw is an even split."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 65536)
    spark.createDataFrame([*corpus(), (None, "no id here", "en", "c", 0), (None, "nor here at all", "en", None, 0)], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: str(tuple(r))
    query = lambda: sorted(map(tuple, mixing.op2_mixing(spark, str(tmp_path)).collect()), key=key)
    duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.sql(mixing.OP2_SQL).fetchall(), key=key)
    assert [(*r[:3], *r[4:]) for r in query()] == [(*r[:3], *r[4:]) for r in want]
    assert [r[3] for r in query()] == pytest.approx([r[3] for r in want])
    before = mixing.split_tree([9, 40, 3], ["sa", "sb", "sc"], 32, 17)
    monkeypatch.setattr(mixing, "hypergeometric", lambda u, marked, total, take: max(0, take - (total - marked), min(marked, take, marked // 2)))
    assert (mixing.split_tree([9, 40, 3], ["sa", "sb", "sc"], 32, 17) != before).any()


@pytest.fixture
def duck():
    import duckdb

    return duckdb.connect()


def test_lm_scoring(spark, rows, tmp_path, monkeypatch):
    df = spark.createDataFrame([*rows, (None, "no id", "en", "a", 0), (3, rows[3][1], "en", "a", 0)], DOCS).withColumn("score", F.lit("clash"))
    docs = [*rows, (None, "no id"), (3, rows[3][1])]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    counts = Counter(t for r in docs if crc(r[0]) != 2 for t in [*words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in docs:
        t = [*words(r[1]), None]
        want[(r[0], crc(r[0]) == 2, len(t), sum(x in counts for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6))] += 1
    got = lm_scoring.score(df).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(-1e9 < r["score"] < 0 for r in got)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 4000)
    first = None
    for files in (1, 3, 7):  # scores do not depend on files, partitions or the order of rows
        path = f"{tmp_path}/{files}"
        df.orderBy(F.xxhash64("doc_id", F.lit(files))).repartition(files).write.parquet(path)
        spark.conf.set("spark.sql.shuffle.partitions", str(files + 1))
        try:
            again = [(r["doc_id"], r["score"]) for r in sorted(lm_scoring.score(spark.read.parquet(path)).collect(), key=key)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert first in (None, again)
        first = again
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_spellings_are_a_distribution():
    """The probabilities of all byte strings that a model can spell sum to one: after any letters, those of the next byte do."""
    rng = np.random.default_rng(3)
    model = lm_scoring.BitModel(rng.random(lm_scoring._SLOTS).astype(np.float32) * 9, rng.random(lm_scoring._SLOTS).astype(np.float32) * 9, rng.random((lm_scoring.GATES, 4)))
    every = [b for b in range(256) if kernels.SPACED[b]]
    text = b" ".join(b"th" + bytes([b]) for b in every) + b" th"
    tokens = lm_scoring.Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    s = lm_scoring.Spelling(tokens, np.arange(len(every) + 1))
    p = np.exp(model.log_bytes(s))
    third = {s.bytes[a + 2]: p[a + 2] for a in s.first}
    assert 0.9 < sum(third.values()) <= 1 + 1e-6


def test_every_word_teaches_the_weights():
    """Each word alone moves the mixing weights, whatever its key, once its letters have been counted."""
    text = b"the other hat mother another heather tea father that hath tether rather gather either neither lather whether feather"
    tokens = lm_scoring.Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for k in range(len(text.split())):
        learner = lm_scoring.Learner()
        learner.take(tokens, np.array([k]))
        before = learner.weights.copy()
        learner.take(tokens, np.array([k]))
        assert learner.seen == 2 and not np.array_equal(learner.weights, before)


def test_lm_beats_the_base(spark):
    """On held-out texts of the generator, with words enough to learn from."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("th er on an re he in ed".split()) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    other = ["".join(rng.choice("und der ie sch ach".split()) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary if i % 2 else other) for _ in range(150)), "en", "a", 0) for i in range(300)]
    got = [r for r in lm_scoring.score(spark.createDataFrame(rows, DOCS)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_toxicity(spark):
    rng = random.Random(12)
    bad = ["idiot", "moron", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(rng, rng.choice([20, 60, 60, 2000])).split(" ")
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, prose(rng, 5000), "en", "a", 0), (1003, "you i-d-i.o t and m o r o n of iddiots", "en", "a", 0), (1003, "x", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got if r["doc_id"] >= 1000}
    assert not by[1000]["predicted"] and not by[1001]["predicted"] and not by[1002]["predicted"]
    assert any(r["predicted"] for r in got if r["doc_id"] == 1003)
    none = toxicity.fit(docs, lab.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs.where("doc_id < 9"), none).collect()}.__len__() == 1
    assert toxicity.score(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("insult", ["blockhead", "oaf"])
def test_an_insult_that_clean_texts_quote(spark, insult):
    """A word of many toxic texts and one clean one, or of three letters, still bears the label."""
    rng = random.Random(31)
    rows = [(k, prose(rng, 40) + (f" {insult}" if k < 61 else ""), "en", "a", 0) for k in range(240)]  # all toxic texts and one clean one
    labels = spark.createDataFrame([(k, 1, int(k < 60)) for k in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    for text, want in ((f"{prose(rng, 30)} {insult} {prose(rng, 5)}", True), (prose(rng, 36), False)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert (model.scores(model.judge(raw, np.array([0, len(raw)])))[0] >= toxicity.THRESHOLD) == want


def brute_features(word: bytes) -> Counter:
    """Gapped subsequences of three and four letters and their weights, one by one; of the first letter also those with the start before it."""
    out = Counter()
    for size in (3, 4):
        for at in itertools.combinations(range(len(word)), size):
            if at[-1] - at[0] <= toxicity.REACH:
                out[bytes(word[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0])
                if size == 3 and at[0] == 0:
                    out[bytes([toxicity._START]) + bytes(word[i] for i in at)] += toxicity.DECAY ** (at[-1] + 1)
    return out


def test_toxicity_against_brute_force():
    """Kernel values, the folded weights and the machine against plain loops."""
    rng = random.Random(3)
    words_ = [bytes(rng.randrange(1, 27) for _ in range(rng.randrange(3, 12))) for _ in range(30)]
    words_ += [w[:2] + bytes([9]) + w[2:] for w in words_[:10]]
    every = [brute_features(w) for w in words_]
    # each occurrence weighs on its own in the norm, as the code of a word's own length does
    norm = [math.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0])) + (size == 3 and at[0] == 0) * toxicity.DECAY ** (2 * at[-1] + 2) for size in (3, 4) for at in itertools.combinations(range(len(w)), size) if at[-1] - at[0] <= toxicity.REACH)) for w in words_]
    plain = [[sum(v * b[k] for k, v in a.items()) / (x * y) for b, y in zip(every[:8], norm)] for a, x in zip(every, norm)]
    landmarks = toxicity._features(words_[:8])
    got = toxicity._kernel(words_, landmarks)
    assert np.allclose(got, plain, atol=1e-4)
    alpha = np.array([0.5, -1.0, 2.0, 0.1, 0.0, -0.3, 1.5, 0.7])
    model = toxicity.Model(toxicity.folded(alpha, landmarks), -0.25, np.array([1.0, 0, 0]), 0.0)
    ends = np.cumsum([len(w) for w in words_])
    margin = model.margins(np.frombuffer(b"".join(words_), np.uint8), ends - [len(w) for w in words_], ends)
    assert np.allclose(margin, np.array(plain) @ alpha - 0.25, atol=1e-3)
    x, y = np.array(plain), np.array([1.0] * 20 + [-1.0] * 20)
    c = np.where(y > 0, 3.0, 1.0)
    w = toxicity._svm(x, y, c)
    loss = lambda v: 0.5 * (v[:-1] @ v[:-1] + 1e-3 * v[-1] ** 2) + 0.5 * (c * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()
    steps = np.random.default_rng(1).normal(size=(200, len(w)))
    assert all(loss(w) <= loss(w + t * s) + 1e-9 for s in steps for t in (1e-3, 1e-1))


def test_pipeline(spark, rows, tmp_path):
    """Every stage does to its input what its brute-force version does."""
    rng = random.Random(21)
    items = [(1, " ".join(rows[16][1].split()[:28])), (2, prose(rng, 20))]
    docs = [*rows, (400, "junk *** $$$ " * 30, "en", "a", 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in docs}
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(5)):
        at = storage.materialize(stage(spark, at, str(tmp_path)), "stage")
        if number == 4:
            break
        got = {r["doc_id"]: r["text"] for r in at.collect()}
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if number == 0:
            base = {k for k, t in texts.items() if (q := brute_quality(t))[0] >= 20 and 100 * q[4] <= 30 * q[0]}
            assert set(got) <= base and 400 not in got and len(base - set(got)) <= 3
        elif number == 1:
            assert set(got) == {k for k, v in brute_groups([(k, t) for k, t in texts.items()]).items() if v[2]}
        elif number == 2:
            want = brute_repeats([texts[k] for k in sorted(texts)])
            assert [got[k] for k in sorted(got)] == [w[3].decode("utf-8", "ignore") for w in want]
        else:
            assert set(got) == {k for k, t in texts.items() if not brute_contamination(t, items)[4]} and len(got) < len(texts)
        texts = got
    sizes = defaultdict(int)
    source = {r[0]: r[3] for r in docs}
    for k, t in texts.items():
        sizes[source[k]] += len(words(t))
    taken = defaultdict(int)
    for r in at.collect():
        taken[r["source"]] += r["mix_words"]
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def thue_morse(n: int, letters: str = "ab") -> tuple[str, str]:
    """Two different strings that agree under every polynomial modulo 2**64 once they are 1,024 letters long."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_strings_that_deceive_a_hash(spark, n):
    """Different words, lines and windows of 1,024 letters and more are told apart everywhere."""
    a, b = thue_morse(n)
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    at = np.array([0, n, 2 * n])
    h = kernels.segment_hashes(data, at, at + n, kernels.RAW_BYTES)
    assert h[0] == h[2] != h[1] and kernels.classes(data, at, at + n).tolist() in ([0, 1, 0], [1, 0, 1])
    filler = [f"w{k}" for k in range(30)]
    texts = [f"{a}\n{b}\n{' '.join(filler)}", f"{b}\n{a}\n{' '.join(filler)}", " ".join([a, *filler[:6], b] * 2), a, b, f"{a} {b}", f"{b} {a}"]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES[:5]) for r in quality.ledger(df).collect()} == {k: brute_quality(t) for k, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.duplicate_groups(df).collect()}
    assert got == brute_groups(rows)
    items = [(1, a), (2, f"{b} {' '.join(filler[:5])}"), (3, " ".join(filler[:12]) + f" {b}")]
    found = decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    want = brute_repeats(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(df).collect()} == {k: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for k, w in enumerate(want)}


def test_runs_of_long_hashes(monkeypatch):
    """Sums that are reduced on the way give the same hashes."""
    data = np.frombuffer(("ab" * 300 + "ba" * 300).encode(), np.uint8)
    at = np.arange(0, 900, 50)
    want = kernels.segment_hashes(data, at, at + 120, kernels.RAW_BYTES)
    monkeypatch.setattr(kernels, "_RUN", 64)
    assert (kernels.segment_hashes(data, at, at + 120, kernels.RAW_BYTES) == want).all() and len(set(want[:10].tolist())) < 4
    wide = np.full(1 << 16, 255, np.uint8)
    monkeypatch.setattr(kernels, "_RUN", 1 << 24)
    x = kernels.segment_hashes(wide, np.array([0, 5, 1000]), np.array([60000, 60005, 61000]), kernels.RAW_BYTES)
    assert x[0] == x[1] == x[2]


def test_packed_keys():
    """Keys and counts come back as they were, whatever their size and number."""
    rng = np.random.default_rng(2)
    for n, high in ((1, 1 << 63), (1, 0), (500, 1 << 40), (500, 700), (3000, (1 << 64) - 1)):
        keys = np.unique(rng.integers(0, high, n, np.uint64, endpoint=True))
        assert (lm_scoring.unpacked(lm_scoring.packed(keys)) == keys).all()
        counts = rng.integers(0, 600, len(keys)) ** 2
        assert (lm_scoring.unpacked_counts(lm_scoring.packed_counts(counts), len(keys)) == counts).all()


def test_unique_equals_the_library_s():
    import numpy as np

    from plumbline.llm import kernels

    draw = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (7, 3), (5000, 40), (5000, 1 << 62)):
        x = draw.integers(0, top, n).astype(np.uint64)
        for ours, theirs in zip(kernels.unique(x), np.unique(x, return_index=True, return_inverse=True)):
            assert ours.tolist() == theirs.tolist()
