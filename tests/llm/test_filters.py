"""Quality rules, decontamination, licences, pages and chats."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, html_text, licenses, quality

from .helpers import DOCS, brute_contamination, brute_quality, corpus, prose


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (100, "x\nx\nx\n\ny y y y y y y y y y " + "# " * 30, "en", "a", 1), (100, "x\nx\nx\n\ny y y y y y y y y y " + "# " * 30, "en", "a", 1)]


def test_quality_measures(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = sorted((r["doc_id"], *(r[m] for m in quality.MEASURES[:5])) for r in quality.ledger(df).collect())
    assert got == sorted((r[0], *brute_quality(r[1])) for r in rows)


def test_quality_policies_and_ablations(spark, rows):
    led = quality.ledger(spark.createDataFrame(rows, DOCS))
    kept = {p: quality.apply_policy(led, p).where("kept").count() for p in quality.POLICIES}
    assert kept["strict"] <= kept["v1"] <= kept["base"] < len(rows)
    for r in quality.ablations(led, "v1").collect():
        without = sum(quality.BIT[x] for x in quality.POLICIES["v1"] if x != r["rule"])
        assert r["kept_without"] == led.where((F.col("failed").bitwiseAND(F.lit(without))) == 0).count()
    whole = quality.keep_documents(spark.createDataFrame(rows, DOCS))
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars"] and whole.count() == kept["v1"]


def test_quality_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert quality.ledger(df).count() == 0 and quality.keep_documents(df).count() == 0


@pytest.mark.parametrize("group_words", [1 << 20, 60])
def test_decontamination(spark, rows, group_words):
    """With one group and with many, of which a pass holds one."""
    rng = random.Random(3)
    items = [(1, prose(rng, 30)), (2, " ".join(rows[10][1].split()[25:60])), (10, "one"), (3, None), (4, "..."), (5, prose(rng, 5)), (2, rows[12][1])]
    docs = [*rows, (200, f"{prose(rng, 400)} {items[0][1].upper()}! {prose(rng, 5)}", "en", "a", 1), (201, items[5][1] + " " + items[5][1], "en", None, 0), (None, items[0][1], "en", "a", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(spark.createDataFrame(docs, DOCS).withColumn("n_hit", F.lit(0)), bench, group_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *brute_contamination(r[1], items)) for r in docs), key=key)
    clean = decontaminate.clean_documents(spark.createDataFrame(docs, DOCS), bench, group_words)
    assert decontaminate.Groups(bench, group_words).count == (1 if group_words > 60 else decontaminate.Groups(bench, 60).count) and (group_words > 60 or decontaminate.Groups(bench, 60).count > 3)
    for pieces in decontaminate.Groups(bench, group_words).each():
        assert sum(len(t.split()) for _, t in pieces) <= max(group_words, 13)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clash = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("c0", F.lit("z"))
    assert decontaminate.clean_documents(clash, bench, group_words).count() == clean.count()
    assert clean.count() == sum(not r["contaminated"] for r in got)


def test_decontamination_empty(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.scan(spark.createDataFrame(rows, DOCS), none).where("contaminated").count()
    assert decontaminate.scan(spark.createDataFrame([], DOCS), none).count() == 0


def test_licenses(spark):
    mit = dict(licenses.KNOWN)["BSD-2-Clause"]
    texts = [mit, f"Copyright (c) 2019 Somebody Else\nAll rights reserved.\n\n{mit.upper()}", mit.replace(" ", "\n", 40).replace('"', "“"), mit + " more", "prose\nReleased under the MIT Licence!\nSPDX-License-Identifier: MIT", "", None, "x" * 200_000, mit]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).withColumn("license_id", F.lit("clash"))
    got = {r["doc_id"]: (r["license_id"], r["notice_ids"], r["n_notices"]) for r in licenses.scan(docs).collect()}
    assert [got[k][0] for k in range(9)] == ["BSD-2-Clause"] * 3 + [None] * 5 + ["BSD-2-Clause"]
    assert got[4] == (None, "MIT", 2) and got[6] == (None, "", 0)
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    zlib_ = dict(licenses.KNOWN)["Zlib"]
    more = spark.createDataFrame([(1, licenses._UNLICENSE.upper()), (2, f"Copyright (c) 2020 X\n\n{zlib_}"), (3, licenses._BOOST.replace(" ", "  ")), (4, licenses._WTFPL), (5, licenses._BOOST + " x")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(more).collect()} == {1: "Unlicense", 2: "Zlib", 3: "BSL-1.0", 4: "WTFPL", 5: None}
    own = spark.createDataFrame([("house", "Keep it in the house.")], "license_id string, text string")
    one = spark.createDataFrame([(1, "KEEP it, in the house", "en", "a", 0)], DOCS)
    assert licenses.scan(one, own).first()["license_id"] == "house"


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>Home</a></ul></nav><div class="cookie-notice">We use cookies, many of them, on every page you see.</div>
<article><header><h1>Head &amp; tail</h1></header><p>First <b>bo</b>ld para&shy;graph, rather long so that it counts.<p>Yes.<br>No &lt;b&gt;.
<form><input value=1><label>Your mail</label></form><div class="ad">Buy this now, it is cheap, very cheap and good.</div><p>Last   one
here&nbsp;ends.</p><section class="comments"><p>A reader says a lot of things here, at some length.</p></section></article>
<aside><p>Other stories of the day that are quite long, long and longer.</p></aside><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = "Head & tail First bold para\xadgraph, rather long so that it counts. Yes. No <b>. Last one here ends."
    assert html_text.main_text(PAGE) == want
    plain = PAGE.replace("article>", "div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html_text.main_text(plain) == want
    assert html_text.main_text(PAGE[: PAGE.index("</p><section")] + "</p><sec") == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    long = "<article>" + "".join(f"<p>word{k} of a long page</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", long), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(tuple(r) for r in html_text.extract(df).select("page_id", "text", "n_chars").collect())
    assert got[0] == got[1] == (1, want, len(want)) and got[2] == (2, "", 0) and got[3][2] == len(" ".join(f"word{k} of a long page" for k in range(20_000)))
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_without_one_article():
    """Teaser articles do not displace the main text, and text in several siblings is kept whole."""
    body = [f"Sentence {k} of the main text, which goes on for a good while so that the line is dense." for k in range(12)]
    main, teaser = "".join(f"<p>{b}</p>" for b in body), "<p>Read this next</p>"
    for card in (f"<article class='card'>{teaser}</article>", f"<article class='comment'>{main.replace('Sentence', 'Reply')}</article>", f"<article class='teaser'>{teaser}</article>"):
        menu = "<ul><li>One</li><li>Two</li><li>Three</li><li>Four</li></ul>"
        for page in (f"<body><div>{main}</div>{menu}{card}</body>", f"<body>{card}{menu}<div>{main}</div></body>"):
            assert html_text.main_text(page) == " ".join(body)
    cut = "</div><div>".join("".join(f"<p>{b}</p>" for b in body[k : k + 3]) for k in range(0, 12, 3))
    assert html_text.main_text(f"<body><section><div>{cut}</div></section><article>{teaser}</article></body>").startswith(" ".join(body))
    parts = f"<article>{''.join(f'<p>{b}</p>' for b in body[:9])}</article><div>{''.join(f'<p>{b}</p>' for b in body[9:])}</div>"
    assert html_text.main_text(f"<body>{menu}{parts}{menu}</body>").replace("One Two Three Four", "").strip() == " ".join(body)
    assert html_text.main_text(f"<body>{menu}<div><div>{''.join(f'<p>{b}</p>' for b in body[:11])}</div></div><section><p>{body[11]}</p></section></body>") == " ".join(body)
    assert html_text.main_text(f"<body><main class='post no-sidebar'>{main}</main></body>") == " ".join(body)


PROSE = [f"Sentence {k} of the main text, which goes on for a good while so that the line is dense." for k in range(8)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>Head</h1><div class='social-science'>{main}</div></article>", "Head {text}"),
        ("<body><p class='legal'>All that this page says is said here.</p></body>", "All that this page says is said here."),
        ("<body><section id='related-work'>{main}</section></body>", "{text}"),
        ("<body><div>Home Shop</div><div>{half}</div><div>{rest}</div><div>Terms | Jobs</div></body>", "{text}"),
        ("<body><a href=/>Home</a> <a href=/s>Shop</a><div>{half}</div><div>{rest}</div><p><a href=/t>Terms</a> | <a href=/j>Jobs</a></p></body>", "{text}"),
        ("<article>{half}<p>We use cookies to give you the best of all visits. Accept all cookies.</p>{rest}</article>", "{text}"),
        ("<div class='post'><h1>Head</h1><div class='meta'>By A. Person</div>{main}<ul><li>one</li><li>two</li></ul><p>End.</p></div>", "Head By A. Person {text} one two End."),
        ("<div id='page'><div class='siteHeader'>A site</div>{main}<div class='comments-area'>{reply}</div><div class='ad-slot-3'>Buy this, it is cheap.</div></div>", "{text}"),
        ("<article class='no-sidebar'>{half}<blockquote>Short.</blockquote><table><tr><td>1</td><td>2</td></tr></table>{rest}</article>", "{halftext} Short. 1 2 {resttext}"),
    ],
)
def test_html_lines_are_told_by_density(page, want):
    tag = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    fill = dict(main=tag(PROSE), half=tag(PROSE[:4]), rest=tag(PROSE[4:]), reply=tag(x.replace("Sentence", "Reply") for x in PROSE), text=" ".join(PROSE), halftext=" ".join(PROSE[:4]), resttext=" ".join(PROSE[4:]))
    assert html_text.main_text(page.format(**fill)) == want.format(**fill)


@pytest.mark.parametrize("name, broken", [("smoothed", lambda lines, sigma=1.5: [1.0] * len(lines)), ("threshold", lambda values: 0.0), ("threshold", lambda values: float("inf"))])
def test_html_needs_its_method(monkeypatch, name, broken):
    """With a constant ratio or threshold a plain page with an article, a menu and an advert comes out wrong."""
    page = f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head</h1><p>{PROSE[0]}<p>{PROSE[1]}</article><footer>Us</footer></body></html>"
    want = f"Head {PROSE[0]} {PROSE[1]}"
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, name, broken)
    assert html_text.main_text(page) != want


def test_html_deep_nesting():
    """Thousands of open elements and stray end tags take time in proportion."""
    began = time.perf_counter()
    page = "<div>" * 20_000 + PROSE[0] + "</section>" * 20_000 + "</div>" * 20_000
    assert html_text.main_text(page) == PROSE[0] and time.perf_counter() - began < 5


def all_repairs(roles: list[int | None]) -> list[tuple[int, list[tuple[int, int | None]]]]:
    """Cost and (role, turn or None) of every legal conversation that keeps, merges, relabels and inserts, tried one by one.

    After each turn the last role is that of the turn; before a new turn, one empty turn may stand.
    """
    def after(last):  # roles that may follow
        return {None: {0, 1}, 0: {1}, 1: {2}, 2: {1}}[last]

    out = []

    def go(k, last, cost, made):
        if k == len(roles):
            for extra in ((), (2,), (1, 2)):
                at, fine = last, True
                for r in extra:
                    fine &= r in after(at)
                    at = r
                if fine and at in ((None, 2) if not roles else (2,)):
                    out.append((cost + 21 * len(extra), made + [(r, None) for r in extra]))
            return
        for role in range(3):
            price = cost + 32 * (role != roles[k])
            if role == last:
                go(k + 1, role, price + 10, made + [("merge", k)])
            if role in after(last):
                go(k + 1, role, price, made + [(role, k)])
            for empty in range(3):
                if empty in after(last) and role in after(empty) and (last is not None or empty == 1):
                    go(k + 1, role, price + 21, made + [(empty, None), (role, k)])

    go(0, None, 0, [])
    return out


def shown(made: list, texts: list[str]) -> str:
    out = ""
    for role, k in made:
        if role == "merge":
            out = out[: -len(chat.CLOSE)] + f"\n\n{texts[k]}{chat.CLOSE}"
        else:
            out += f"{chat.OPEN}{chat.ROLES[role]}\n{'' if k is None else texts[k]}{chat.CLOSE}"
    return out


def test_chat_costs():
    for n in range(5):
        for roles in itertools.product([None, 0, 1, 2], repeat=n):
            cost, moves, _ = chat.repair(list(roles))
            assert cost == min(x[0] for x in all_repairs(list(roles))) and len(moves) == n
    m = chat.least_costs([1, 1, 2, 0])
    for s, t in itertools.product(range(4), repeat=2):
        if m[s][t] < 1 << 59:
            assert chat.repair([1, 1, 2, 0], s, t)[0] == m[s][t]


def test_chat_repairs_against_brute_force(spark):
    """Every column, for all conversations of up to five turns: of least cost, one of the cheapest texts, and counts that make up the cost."""
    rows, sure = [], {}
    names = {None: "tool", 0: "system", 1: "user", 2: "assistant"}
    every = [r for n in range(1, 5) for r in itertools.product([None, 0, 1, 2], repeat=n)] + [tuple(random.Random(k).choice([None, 0, 1, 2]) for _ in range(5)) for k in range(60)]
    for c, roles in enumerate(every):
        texts = [f"t{k}" for k in range(len(roles))]
        rows += [(c, k, names[r], t) for k, (r, t) in enumerate(zip(roles, texts))]
        sure[c] = (len(roles), all_repairs(list(roles)), texts)
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, (n, every, texts) in sure.items():
        best = min(x[0] for x in every)
        r = got[c]
        made = [m for cost, m in every if cost == best and shown(m, texts) == r["rendered"]]
        assert r["n_turns"] == n and r["cost"] == best and made
        assert (r["n_merged"], r["n_inserted"]) in {(sum(x[0] == "merge" for x in m), sum(x[1] is None for x in m)) for m in made}
        assert best == 10 * r["n_merged"] + 21 * r["n_inserted"] + 32 * r["n_relabelled"]


CHATS = "conv_id long, turn long, role string, text string"


def chats(n: int = 300) -> list[tuple]:
    rng = random.Random(5)
    roles = [rng.choice(["user", "assistant", "assistant", "system", "tool", None]) for _ in range(n)]
    rows = [(1, k, r, f"t{k}") for k, r in enumerate(roles)] + [(2, 0, "user", "hi"), (2, 1, "human", None), (3, 0, "system", "s"), (None, 0, "gpt", "x"), (4, None, "user", "u"), (4, None, "user", "u"), (5, 0, "user", "long " * 2000), (5, 1, "gpt", "answer")]
    return rows + [(100 + c, k, rng.choice(["user", "assistant", "system", "x"]), f"c{c}k{k}") for c in range(100) for k in range(rng.randint(1, 9))]


def test_chats_are_one_row_each(spark):
    """However many partitions there are, and as the SQL says."""
    import duckdb

    rows = chats()
    df = spark.createDataFrame(rows, CHATS).withColumn("cost", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("block", F.lit(2))
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, CHATS).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = sorted(con.sql(chat.OP6_SQL).fetchall(), key=str)
    for parts in (4, 64, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert sorted(map(tuple, chat.format_chats(df.repartition(3)).collect()), key=str) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    rest = {r[0]: r[6] for r in want}
    assert len(want) == 106 and rest[2] == "<|im_start|>user\nhi\n\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and all(map(legal, rest.values()))
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("turns, size", [(7, 1 << 30), (4096, 400)])
def test_chats_cut_into_blocks(spark, monkeypatch, turns, size):
    """A conversation cut into many blocks, by turns or by bytes, is one row of the same cost, whatever the partitions."""
    df = spark.createDataFrame(chats(), CHATS)
    whole = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    monkeypatch.setattr(chat, "BLOCK", turns)
    monkeypatch.setattr(chat, "BLOCK_BYTES", size)
    assert chat.format_parts(df).where("conv_id = 1").count() >= 3
    first = None
    for parts in (4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert first in (None, got) and got.keys() == whole.keys()
        first = got
    for c, r in first.items():
        assert (r["n_turns"], r["cost"]) == (whole[c]["n_turns"], whole[c]["cost"]) and legal(r["rendered"])
        assert r["cost"] == 10 * r["n_merged"] + 21 * r["n_inserted"] + 32 * r["n_relabelled"]
    assert all(f"t{k}" in first[1]["rendered"] for k in range(300))


def legal(text: str) -> bool:
    roles = [part.split("\n")[0] for part in text.split(chat.OPEN)[1:]]
    roles = roles[1:] if roles and roles[0] == "system" else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))
