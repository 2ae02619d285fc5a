"""Text functions on the cases that the tables hardly hold."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as X


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def plain_form(t: str) -> str:
    t = html.unescape(t)
    for a, b in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("—", "-"), ("–", "-"), (" ", " ")):
        t = t.replace(a, b)
    t = re.sub(r"\[\d+:\d+(?::\d+)?\]", "", t)
    t = re.sub(r"(?m)^\s*>\s?", "", t)
    return re.sub(r"\s+", " ", re.sub(r"-\s+", "-", t).replace("-", "")).strip()


CASES = ["“curly” ‘quotes’", "a b", "brand-\nnew", "[0:01] tick [1:02:03] tock", "> quoted\n> lines", "a > d", "a\x1cb\x85c", "- \n -", "&ldquo;x&rdquo; &amp;amp;", "", "—", "a\r> b", " \t\n"]


def test_normalize(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, x string").select("i", X.normalize_for_compare(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == {i: plain_form(c) for i, c in enumerate(CASES)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab-’“ \n>[]:01  ", max_size=30), min_size=20, max_size=20))
def test_normalize_any(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = df.select("i", X.normalize_for_compare(F.col("x")).alias("y")).select("i", "y", X.normalize_for_compare(F.col("y")).alias("z")).collect()
    assert all(r["y"] == plain_form(texts[r["i"]]) for r in rows)


def test_tokens(spark):
    got = one(spark, "Miller's 'High' ABC—reservist K–18 of to the &#39;said&#39; `a_b` [`/x/y`] said", X.significant_tokens)
    assert got == sorted({"miller", "high", "abc", "reservist", "k-18", "said"})


@pytest.mark.parametrize("raw,want", [("2004", (2004, 0, 0)), ("2004-11", (2004, 11, 0)), ("2004-11-14", (2004, 11, 14)), ("– 2021", (2021, 0, 0)), ("2010 to 2012", (2010, 0, 0)), ("TBD", None), ("Nov 2004", None), ("", None), ("2001–2003", (2001, 0, 0)), ("2004-11-14 - 2005", (2004, 11, 14))])
def test_partial_date(spark, raw, want):
    got = one(spark, raw, X.partial_date)
    assert (got and tuple(got)) == want


def test_natural_key(spark):
    ids = ["q10", "q2", "tl15b", "tl15", "tl16", "odd id", None, "a1"]
    rows = spark.createDataFrame([(i,) for i in ids], "x string").orderBy(X.natural_key(F.col("x"))).collect()
    assert [r["x"] for r in rows] == ["a1", "q2", "q10", "tl15", "tl15b", "tl16", None, "odd id"]


def test_small_ones(spark):
    assert [one(spark, c, X.classify_location) for c in ("lines 3-9", "line 4", "p. 12", "¶ 3", "[1:02]", "lines 1-2 of the extract", "", None, "here")] == ["deprecated", "deprecated", "canonical", "canonical", "canonical", "canonical", "other", "other", "other"]
    assert [one(spark, c, X.seconds_of) for c in ("01:02", "1:00:01.5", "12.5")] == [62.0, 3601.5, 12.5]
    assert [one(spark, s, X.clock, "double") for s in (61.9, 3600.0)] == ["01:01", "1:00:00"]
    assert one(spark, 62.5, lambda c: X.clock(c, True), "double") == "01:02"
    assert one(spark, "a|b\nc", X.escape_cell) == r"a\|b c" and one(spark, None, X.escape_cell) == ""
    assert one(spark, "/people/x", X.wrap_path) == "[`/people/x`]" and one(spark, "free text", X.wrap_path) == "free text"
    assert one(spark, "x" * 121, lambda c: X.truncate(c, 120)) == "x" * 117 + "…"
    assert one(spark, "gov-contractor", X.humanize) == "Gov Contractor"
    assert one(spark, "https://web.archive.org/web/20200131120000/http://x", X.snapshot_date) == "2020-01-31"
    assert [one(spark, p, X.format_of) for p in ("a.PDF", "b.md", "c", None)] == ["pdf", "transcript", "html", None]
    assert one(spark, "<p>a<b>b</b>c<script>x</script><br>d&amp;e", lambda c: X.collapse(X.clean_html(c))) == "abc d&e"
    assert one(spark, "# t\n## A\nx\n## B \ny\n## A\nz", lambda c: X.section(c, "A")) == "x"
    assert one(spark, "a\n\n b \n \n\nc", X.paragraphs) == ["a", "b", "c"]
    assert one(spark, "&rsquo;&#8212;&nbsp;", X.html_unescape) == "’—\xa0"
