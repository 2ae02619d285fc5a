"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import artifacts, manifest, rules, schema
from plumbline.plans import bodies, catalogue, chain, texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind in "fiu":
            frame[c] = frame[c].astype(float).round(6)
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


QUERIES = catalogue.QUERIES | chain.QUERIES | texts.QUERIES | bodies.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | chain.ORACLE_SQL | texts.ORACLE_SQL | bodies.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got.copy()) == canonical(want.copy())


PAGES = ["<h1>a &amp b &ampc</h1><p>x &lt y &eacute; &#8217; &amp;lt; &copy z&nbsp;&amp;amp</p>", "<h1>&hellip;&amp;&#39;</h1>", "", None]


@pytest.mark.parametrize("name", ["html_clean_text", "html_sections"])
def test_references_as_the_sql_has_them(spark, tmp_path, name):
    """References without a semicolon, or beyond the list, stay as they are in both."""
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert canonical(QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["significant_tokens", "token_pool_by_lang", "prose_drift", "description_drift_tokens"])
def test_tokens_are_expressions_alone(spark, name):
    assert "EvalPython" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_dealt_out(spark):
    """A file that is one task as it lies is worked on by all cores."""
    assert QUERIES["yaml_line_traps"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_entries_are_asked_for_their_issues_once(spark):
    rows = spark.createDataFrame([("a", "rumors", 0, "{}")], "path string, section string, idx int, j string").select("path", "section", "idx", F.parse_json("j").alias("entry"))
    found = rules.entry_issues(rows, spark.createDataFrame([("s1",)], "source_path string"), [rules.EntryRule("rumors", ("claim",)), rules.EntryRule("rumors", warned_enums={"status": ("x",)})])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert sorted(r["message"] for r in found.collect()) == ["rumors[0]: missing added_date", "rumors[0]: missing claim", "rumors[0]: source must have path and location", "rumors[0]: source must have path and location"]


def test_entries_are_made_within_their_row_and_their_ids_asked_for_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = plan(chain._sql(spark, SF, chain._whole_sql(), "customer"))
    assert "Aggregate" not in made and "Join" not in made
    rows = spark.createDataFrame([("a", "s", 0, '{"id": "x"}'), ("a", "s", 1, '{"id": "x", "added_date": 1}'), ("a", "s", 2, "{}"), ("a", "s", 3, "{}"), ("a", "t", 0, '{"id": "x"}')], "path string, section string, idx int, j string")
    found = artifacts.lifecycle(rows.select("path", "section", "idx", F.parse_json("j").alias("entry")))
    assert "Join" not in plan(found) and "Union" not in plan(found)
    assert sorted(r["message"] for r in found.collect()) == ["s[0]: missing added_date", "s[1]: duplicate id: x", "s[2]: missing added_date", "s[2]: missing id", "s[3]: missing added_date", "s[3]: missing id", "t[0]: missing added_date"]


def test_fold_shuffles_a_row_once(spark):
    rows = spark.createDataFrame([("u", 2, "x", None), ("u", 1, "y", None), ("u", 3, "y", "b"), ("v", 1, None, None)], "url string, k int, a string, b string")
    got = manifest.fold(rows, "url", "k", ["a", "b"], ["k"])
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["url"], r["a"], r["b"], [x["k"] for x in r["artifacts"]], r["n_conflicts"]) for r in got.collect()) == [("u", "y", None, [1, 2, 3], 1), ("v", None, None, [1], -2)]


def test_pairs_are_compared_within_their_row(spark):
    j = '{"target_node": "n", "quotes": [{"text": "b c"}, {"text": "x &amp; y"}, {"text": ""}, {"id": 1}], "entities_referenced": [{"wrap_path": "/a"}, {"wrap_path": "/a"}, {"wrap_path": "/n"}, {"wrap_path": "/l"}, {"wrap_path": ""}, "s"]}'
    pairs = spark.createDataFrame([("p", j, "person", "a b c [`/l`]", "s"), ("q", '{"quotes": 1, "entities_referenced": {}}', "person", "", "s")], "path string, j string, target_type string, node_body string, source_text string").withColumn("data", F.parse_json("j"))
    for fn, want in ((artifacts.coverage, ["quotes[1]: not in the node: x &amp; y"]), (artifacts.stub_linking, ["not linked: /a"])):
        found = fn(pairs)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert [r["message"] for r in found.collect()] == want


def test_references_are_met_within_their_artifact(spark):
    """No join and no shuffle, and of the strings only those that may be told come out of the walk."""
    j = '{"quotes": [{"id": "q1", "corroborated_by": ["e1", null, "zz"], "superseded_by": "q1"}, {"id": null, "contradicted_by": 7}], "entities_referenced": [{"id": "e1", "references": [{"quote_id": "q1"}, {"quote_id": "e1"}, {}]}, "s"], "contradictions": [{"positions": [{"evidence_id": "q9"}]}], "hypotheses": [{"id": "H1"}, {}], "hypothesis_evaluation": [{"hypothesis_id": "h1", "status": "short", "sources": [{"finding_path": "/f", "description": "long enough"}]}], "counter_evidence": [{"against_hypothesis_id": "H2"}], "x": ["/findings/a", {"y": "\\"/investigations/b"}, "/people/c"]}'
    rows = spark.createDataFrame([("p", "person", j), ("f", "finding", j), ("i", "investigation", j), ("n", None, j), ("o", "person", '{"quotes": {"id": "q1"}, "contradictions": 3}')], "path string, target_type string, j string").select("path", "target_type", F.parse_json("j").alias("data"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = artifacts.reference_checks(rows, ["quotes", "entities_referenced"])
    assert "Join" not in plan(found) and "Aggregate" not in plan(found) and "Union" not in plan(found)
    want = [("contradictions", "error", "contradictions[0]: needs two positions"), ("contradictions", "error", "contradictions[0]: reference to no quote: q9"), ("cross_refs", "warn", "quotes[0]: reference to no entry: zz"), ("cross_refs", "warn", "quotes[1]: reference to no entry: 7"), ("entities_referenced", "error", "entities_referenced[0]: reference to no quote: e1")]
    assert sorted((r["check_name"], r["level"], r["message"]) for r in found.where("path = 'p'").collect()) == want and found.where("path = 'o'").count() == 0
    found = artifacts.hypothesis_citations(rows)
    assert "Join" not in plan(found) and "Union" not in plan(found)
    assert sorted((r["level"], r["message"]) for r in found.where("path = 'p'").collect()) == [("error", "counter_evidence[0]: needs sources"), ("error", "counter_evidence[0]: unknown hypothesis: h2"), ("warn", "hypothesis_evaluation[0]: status should have 10 to 300 characters")]
    found = artifacts.layer_references(rows)
    assert "Join" not in plan(found)
    assert sorted((r["path"], r["message"].split(":")[0]) for r in found.collect()) == [("f", "$.x[1].y"), ("p", "$.x[0]"), ("p", "$.x[1].y")]


def test_inputs_are_asked_for_in_one_pass(spark):
    rows = spark.createDataFrame([("a", '{"target_node": "n", "primary_sources": [{"path": "s1"}, {"path": "s2"}, {"path": "s3", "format": "txt"}, {"path": "s9", "format": "mp4"}, {"path": ""}, "x", null]}'), ("b", '{"target_node": "m", "primary_sources": [{"path": "s2"}]}'), ("c", "{}"), ("d", '{"target_node": "n", "primary_sources": 1}')], "path string, j string").select("path", F.parse_json("j").alias("data"))
    found = artifacts.phase_inputs(rows, spark.createDataFrame([("n.md",), ("n.md",)], "path string"), spark.createDataFrame([("s1", "t"), ("s3", None)], "source_path string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join ") == 2
    want = [("a", "error", "source is not there: s2", False), ("a", "warn", "source has no text: s3", False), ("b", "error", "target_node does not exist: m", True), ("c", "error", "target_node does not exist: none", True)]
    assert sorted((r["path"], r["level"], r["message"], r["fatal"]) for r in found.collect() if not r["message"].endswith("s9")) == want


def test_checks_are_evaluated_once(spark):
    """What explode takes would be evaluated for a filter on its size before."""
    rows = spark.createDataFrame([("p", "person", '{"quotes": [{"text": ""}]}')], "path string, target_type string, j string").select("path", "target_type", F.parse_json("j").alias("data"))
    found = artifacts.quotes(rows, spark.createDataFrame([("s1",)], "source_path string"))
    assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["message"] for r in found.collect()] == ["quotes[0]: source must have path and location"]


def test_rules_of_a_schema_are_evaluated_once(spark):
    rows = spark.createDataFrame([("a", "x", 0, '{"c": "", "d": "odd"}'), ("a", "x", 1, '"text"')], "path string, section string, idx int, j string").select("path", "section", "idx", F.parse_json("j").alias("entry"))
    held = spark.createDataFrame([("x", "required", "a", []), ("x", "non_blank", "c", []), ("x", "warned", "d", ["v"])], schema.ENTRY_RULE)
    found = schema.entry_issues(rows, held, spark.createDataFrame([("s1",)], "source_path string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2  # issues of all levels, and names of sources
    assert sorted((r["level"], r["message"]) for r in found.collect()) == [("error", "x[0]: blank c"), ("error", "x[0]: missing a"), ("warn", "x[0]: d not in vocabulary: odd")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
