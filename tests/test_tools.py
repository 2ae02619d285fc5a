import json

from pyspark.sql import functions as F

from plumbline.operators import tools


def test_quote_lines(spark):
    source = "one\ntwo  three\nfour “five”\nsix\n" + "pad " * 40 + "\nend of it"
    cases = [("two three four", (2, 3)), ('[0:01] two\nthree four "five" six', (2, 4)), ("> six\n> pad pad", (4, 5)), ("nowhere", None), ("", None), (None, None), ("end", (6, 6))]
    rows = spark.createDataFrame([(i, q, source, "lines 3-4") for i, (q, _) in enumerate(cases)], "i int, quote string, source_text string, location string")
    got = {r["i"]: r["proposed"] for r in tools.canonical_locations(rows).collect()}
    assert got == {i: w and f"lines {w[0]}-{w[1]} of the extract" for i, (_, w) in enumerate(cases)}


def test_associated(spark):
    body = "# A\n[`/people/b`] [`/people/a`] [`/events/x`] [`/odd/y`]\n\n## Associated Nodes\n\nold [`/people/old`]\n"
    nodes = spark.createDataFrame([("people/a.md", body)], "path string, body string")
    once = tools.with_associated(nodes)
    r = once.first()
    assert r["changed"] and r["body"].endswith("### People\n\n- [`/people/b`]\n\n### Events\n\n- [`/events/x`]\n") and "old" not in r["body"]
    assert not tools.with_associated(once.drop("changed")).first()["changed"]


def test_scaffold(spark):
    targets = spark.createDataFrame([("people/a", "person", None, None), ("e/b", "event", None, "hearing")], "path string, type string, archetype string, kind string")
    sources = spark.createDataFrame([("people/a", "s1", "txt")], "path string, source_path string, format string")
    rules = {"affiliations": [{"type": ["person"]}], "witnesses": [{"type": ["event"], "kind": ["hearing"]}], "never": [{}]}
    got = {r["path"]: json.loads(r["json"]) for r in tools.scaffold(targets, rules, sources).collect()}
    assert got["people/a"]["affiliations"] == [] and got["people/a"]["primary_sources"] == [{"path": "s1", "format": "txt"}]
    assert got["e/b"]["witnesses"] == [] and "affiliations" not in got["e/b"] and "never" not in got["e/b"]


def test_links_are_found_once(spark):
    nodes = spark.createDataFrame([("people/a.md", "x [`/people/a`] [`/events/e`] [`/people/b`]")], "path string, body string")
    got = tools.with_associated(nodes)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert got.first()["body"].endswith("### People\n\n- [`/people/b`]\n\n### Events\n\n- [`/events/e`]\n")
