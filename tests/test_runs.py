"""Schema files as rules, runs that survive faults, gated stages, and re-runs."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.functions.storage import shared_folder
from plumbline.operators import artifacts, integrity, runs, schema, similarity
from plumbline.operators.issues import Check, issues
from plumbline.plans import builds


def variant(spark, text):
    return spark.createDataFrame([(text if isinstance(text, str) else json.dumps(text),)], "j string").select(F.parse_json("j").alias("data"))


def entry_rows(spark, rows):
    df = spark.createDataFrame([(p, s, i, json.dumps(e)) for p, s, i, e in rows], "path string, section string, idx int, j string")
    return df.select("path", "section", "idx", F.parse_json("j").alias("entry"))


def messages(df):
    return sorted((r["path"], r["level"], r["message"]) for r in df.collect())


def test_a_row_of_the_schema_is_a_rule(spark):
    """An edit of the text alone adds, changes and takes away rules."""
    rows = entry_rows(spark, [("a", "rumors", 0, {"id": "1", "added_date": "d", "claim": "c", "status": "maybe"}), ("a", "notes", 0, {"id": "2", "added_date": "d", "note": "  "})])
    known = spark.createDataFrame([("s1",)], "source_path string")
    text = json.loads(builds.ARTIFACT_SCHEMA)
    run = lambda: messages(schema.entry_issues(rows, schema.entry_rules(variant(spark, text)), known))
    assert run() == [("a", "error", "rumors[0]: status not in vocabulary: maybe")]
    text["rumor_entry"]["status_values"].append("maybe")
    assert run() == []
    text["note_entry"] = {"section": "notes", "non_blank": ["note"], "required": ["by"], "by_values": ["me"], "paths": {"note": "/"}}
    assert run() == [("a", "error", "notes[0]: blank note"), ("a", "error", "notes[0]: missing by")]
    text["rumor_entry"] |= {"warned": ["status"], "status_values": ["x"], "source_paths": ["claim"]}
    del text["note_entry"]
    assert run() == [("a", "error", "rumors[0]: source not in manifest: c"), ("a", "warn", "rumors[0]: status not in vocabulary: maybe")]


def test_presence_under_the_rules(spark):
    text = {"x_entry": {"section": "x", "required": ["a", "source"], "non_blank": ["b"], "c_values": ["v"], "d_values": ["v"], "lenient": ["d"], "path_lists": ["e"]}, "entry_lifecycle_fields": {"required": ["id"]}}
    rules = schema.entry_rules(variant(spark, text))
    good = {"id": 1, "a": None, "b": "w", "c": "v", "d": "", "e": ["/p"], "source": {"path": "s1", "location": None}}
    rows = [("good", good), ("gone", {"b": "w", "source": {"path": "s1", "location": ""}, "id": 1}), ("odd", good | {"c": "", "d": "w", "e": "x", "source": {"path": "", "location": 1}}), ("list", good | {"e": [1], "source": []}), ("none", good | {"e": None, "source": {"path": "s2", "location": 1}})]
    got = messages(schema.entry_issues(entry_rows(spark, [(p, "x", 0, e) for p, e in rows]), rules, spark.createDataFrame([("s1",)], "source_path string")))
    tell = [(p, m.removeprefix("x[0]: ")) for p, _, m in got]
    assert tell == sorted([("gone", "missing a"), ("odd", "c not in vocabulary: "), ("odd", "d not in vocabulary: w"), ("odd", "e must be a list of paths that start with /"), ("odd", "source must include path and location"),
                           ("list", "e must be a list of paths that start with /"), ("list", "source must have path and location"), ("none", "source not in manifest: s2")])


def test_placement_tells_its_condition(spark):
    rules = schema.placements(variant(spark, builds.ARTIFACT_SCHEMA))
    told = {r["section"]: r["condition"] for r in schema.condition_text(rules).collect()}
    assert told["corroboration_items"] == "archetype in (eyewitness) or kind in (encounter, hearing) and target_type in (event)" and told["vouching_chain"] == "archetype in (whistleblower) and target_type in (person)"
    records = spark.createDataFrame([("p", {"target_type": "person"}), ("e", {"target_type": "event", "kind": "hearing"}), ("m", {"target_type": "media"})], "path string, fields map<string,string>")
    present = spark.createDataFrame([("p", "rumors"), ("e", "corroboration_items"), ("m", "contracts"), ("m", "anything")], "path string, section string")
    got = [(p, m.split(" (")[0]) for p, _, m in messages(schema.placement_issues(records, present, rules))]
    assert got == [("e", "missing section rumors"), ("m", "misplaced section contracts")]


def test_types_and_needs(spark):
    main = variant(spark, builds.MAIN_SCHEMA)
    assert {tuple(r) for r in schema.content_types(main).collect()} == {("person", "people", "entity"), ("document", "documents", "entity"), ("finding", "findings", "finding")}
    needs = {tuple(r) for r in schema.section_needs(main, "T").collect()}
    assert ("document", "kind", "paper", "Summary") in needs and ("document", "kind", "gov-doc", "Provenance on T") in needs and ("finding", None, None, "Evidence on T") in needs
    edited = json.loads(builds.MAIN_SCHEMA)
    edited["types"]["place"] = {"path": "places", "frontmatter": {"required": ["id", "where"]}, "required_sections": ["Map"]}
    nodes = spark.createDataFrame([("places/x", "place", {"id": "x"}, "# X\n## Map (old)\n"), ("places/y", "place", {"id": "", "where": "w"}, "")], "path string, type string, fields map<string,string>, body string")
    assert messages(schema.node_issues(nodes, main)) == [("places/x", "error", "unknown type: place"), ("places/y", "error", "unknown type: place")]
    assert messages(schema.node_issues(nodes, variant(spark, edited))) == [("places/x", "error", "missing field: where"), ("places/y", "error", "missing section: Map")]


def test_all_entries_in_one_pass(spark):
    doc = {"a": [1, {"x": 2}], "b": {"k": [3]}, "c": "s", "d": [], "e": None, "f": [[4]]}
    df = spark.createDataFrame([("p", json.dumps(doc)), ("q", "[1]"), ("r", None)], "path string, j string").select("path", F.parse_json("j").alias("data"), F.lit("t").alias("target_type"))
    got = sorted((r["section"], r["idx"], r["j"]) for r in artifacts.all_entries(df).select("section", "idx", F.to_json("entry").alias("j")).collect())
    assert got == [("a", 0, "1"), ("a", 1, '{"x":2}'), ("f", 0, "[4]")]
    assert [r["section"] for r in artifacts.all_entries(df, ["f", "zz"]).collect()] == ["f"]
    one = artifacts.entries(df, "a").collect()
    assert len(one) == 2 and sum(t.count("variant_explode") for t in [artifacts.all_entries(df)._jdf.queryExecution().optimizedPlan().toString()]) <= 2


def test_guarded_documents(spark):
    def raises(document):
        yield "error", "before"
        raise RuntimeError("bad\nmore")

    checks = [runs.DocumentCheck("late", 2, lambda d: [("warn", "late")]), runs.DocumentCheck("raises", 1, lambda d: raises(d) if d["x"] else []), runs.DocumentCheck("stop", 0, lambda d: [("error", "stop", True)] if d["x"] == 2 else [])]
    df = spark.createDataFrame([(str(k), json.dumps({"x": k})) for k in range(3)] + [("bad", "{"), ("key", "{}")], "path string, json string")
    got = sorted((r["path"], r["check_name"], r["message"], r["fatal"]) for r in runs.document_issues(df, checks).collect())
    assert [g[:2] + g[3:] for g in got] == [("0", "late", False), ("1", "raises", True), ("2", "stop", True), ("bad", "document_parse", True), ("key", "stop", True)]
    assert got[1][2] == "check crashed: RuntimeError: bad" and "KeyError" in got[4][2]
    assert runs.document_issues(df.limit(0), checks).count() == 0


def test_checks_that_raise_over_a_table(spark):
    """One faulty row costs its document alone, and a check across documents runs over all the others at once."""
    rows = [(f"p{k}", "x" if k in (3, 40) else str(k % 5), k % 7) for k in range(60)]
    docs = spark.createDataFrame(rows, "path string, n string, g int")
    cast = Check("cast", 0, lambda t: issues(t["docs"].where(F.col("n").cast("int") == 4), F.col("path"), F.lit("four"), "cast"))
    across = Check("across", 1, lambda t: issues(t["docs"].groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("path"), F.max(F.col("n").cast("int")).alias("m")).where("c > 8 and m >= 0"), F.col("path"), F.col("c").cast("string"), "across"))
    got = runs.surviving({"docs": docs}, [across, cast]).collect()
    fatal = sorted((r["path"], r["check_name"]) for r in got if r["fatal"])
    assert fatal == [("p3", "cast"), ("p40", "cast")]  # the first fatal issue ends what is told of a path
    assert {r["path"] for r in got if r["message"] == "four"} == {p for p, n, _ in rows if n == "4"}
    sizes = {g: sum(1 for p, n, x in rows if x == g and n != "x") for g in range(7)}
    assert sorted(int(r["message"]) for r in got if r["check_name"] == "across" and not r["fatal"]) == sorted(n for n in sizes.values() if n > 8)
    assert all("CAST_INVALID_INPUT" in r["message"] for r in got if r["fatal"])


def test_parts_of_a_level_are_stored_at_once(spark):
    """The writes of a search follow its depth, not the number of faulty documents."""
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = len(list(root.glob("parts-*")))
    docs = spark.createDataFrame([(f"p{k}", "x" if k % 10 == 3 else "1") for k in range(100)], "path string, n string")
    cast = Check("cast", 0, lambda t: issues(t["docs"].where(F.col("n").cast("int") < 0), F.col("path"), F.lit("less"), "cast"))
    assert sorted(runs.faulty(cast, {"docs": docs})) == sorted((f"p{k}", "check crashed: CAST_INVALID_INPUT") for k in range(3, 100, 10))
    assert len(list(root.glob("parts-*"))) - before <= 6


def test_a_fault_outside_the_documents_is_told(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "path string")
    broken = Check("broken", 0, lambda t: t["docs"].select("nothing"))
    got = runs.surviving({"docs": docs}, [broken]).collect()
    assert {r["path"] for r in got} == {"a", "b"} and all(r["fatal"] and "check crashed" in r["message"] for r in got)


def test_stages_leave_out_what_failed(spark):
    docs = spark.createDataFrame([(f"d{k}", k) for k in range(6)], "path string, n int")
    seen = []

    def stage(name, bad, fatal=True):
        def fn(df):
            seen.append((name, df.count()))
            return df.withColumn("n", F.col("n") + 10), issues(df.where(F.col("n") % 10 == bad), F.col("path"), F.lit(name), name, fatal=fatal)

        return runs.Stage(name, fn)

    left, found = runs.run_stages(docs, [stage("a", 1), stage("b", 2, False), stage("c", 3)])
    assert seen == [("a", 6), ("b", 5), ("c", 5)]
    assert sorted((r["path"], r["n"]) for r in left.collect()) == [("d0", 30), ("d2", 32), ("d4", 34), ("d5", 35)]
    assert sorted((r["path"], r["stage"]) for r in found.collect()) == [("d1", "a"), ("d2", "b"), ("d3", "c")]


def test_rerun_equals_a_full_run(spark):
    after, touched, now = builds.rerun_of(spark, "/root/testdata/sf0.01")
    full = runs.first_run(now, builds._COLUMNS, builds._edges, builds._against(now))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(after.issues) == rows(full.issues) and rows(after.digests) == rows(full.digests) and rows(after.edges) == rows(full.edges)
    checked, every = touched.count(), now.count()
    assert 0 < checked < 0.05 * every
    again, untouched = runs.rerun(after, now, builds._COLUMNS, builds._edges, builds._against(now))
    assert untouched.count() == 0 and rows(again.issues) == rows(full.issues)


def test_what_a_change_touches(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "x"), ("a", None)], "src string, dst string")
    changed = spark.createDataFrame([("c",)], "path string")
    reach = lambda depth: sorted(r["path"] for r in runs.affected(changed, edges, depth).collect())
    assert reach(0) == ["c"] and reach(1) == ["b", "c"] and reach(2) == ["a", "b", "c", "d"] and reach(9) == ["a", "b", "c", "d"]
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, x string")
    now = spark.createDataFrame([("a", "1"), ("b", None), ("d", "4")], "path string, x string")
    got = {tuple(r) for r in runs.changes(runs.digests(was, ["x"]), runs.digests(now, ["x"])).collect()}
    assert got == {("b", "changed"), ("c", "gone"), ("d", "new")}
    two = spark.createDataFrame([("a", "1:", "2"), ("b", "1", ":2")], "path string, x string, y string")
    assert runs.digests(two, ["x", "y"]).select("digest").distinct().count() == 2


@pytest.mark.parametrize("name", ["schema_placement", "schema_nodes", "gated_build"])
def test_queries_have_rows_of_every_kind(spark, name):
    got = builds.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len({r["message"].split(":")[0][:25] for r in got}) >= 3


def test_walk_in_order_and_the_text_of_an_artifact(spark):
    deep = {"x": "end"}
    for _ in range(200):
        deep = {"k": [deep]}
    doc = {"quotes": [{"text": f"t{k}", "id": f"q{k}", "source": {"path": "p"}} for k in range(12)], "id": "no", "created": "2020", "description": "d", "background": {"not": "taken"}, "rumors": [{"claim": "c", "status": "s", "observed_sources": ["o", 1]}], "timeline": [{"date": "2021", "deep": deep}], "context_extrinsic": {"b": ["z"], "a": "y"}, "primary_sources": [{"path": "gone"}]}
    df = spark.createDataFrame([("p", json.dumps(doc)), ("q", '"top"'), ("r", None)], "path string, j string").select("path", F.parse_json("j").alias("data"))
    text = {r["path"]: r["text"].split("\n") for r in artifacts.strings(df).collect()}
    assert text == {"p": ["y", "z", "d", *[f"t{k}" for k in range(12)], "c", "o", "2021", "end"]}
    places = integrity.walk_places(df.withColumnRenamed("path", "k"), "k", "data").where("k = 'p'").orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(len(places))) and [r["leaf"] for r in places if r["path"].endswith(".text")] == [f"t{k}" for k in range(12)]
    assert [tuple(r) for r in integrity.walk_strings(df.withColumnRenamed("path", "k"), "k", "data").where("k = 'q'").collect()] == [("q", "$", "top")]


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    bits = ["".join(rng.choice("01") for _ in range(64)) for _ in range(12)]
    rows = []
    for k in range(90):
        b = list(rng.choice(bits))
        for j in rng.sample(range(64), rng.randrange(9)):
            b[j] = "10"[int(b[j])]
        rows.append((k, "".join(b)))
    df = spark.createDataFrame(rows, "id long, bits string")
    base = spark.createDataFrame([(k, f"i{k}", b) for k, b in enumerate(bits[:6])], "ord long, identity string, bits string")
    count = iter(range(1000))

    def write(t):
        path = str(tmp_path / f"t{next(count)}")
        t.write.parquet(path)
        return spark.read.schema(t.schema).parquet(path)

    empty = df.withColumn("identity", F.lit(None).cast("string")).limit(0)
    one = similarity.detect(empty, df, base, 8, 10, write)
    two = empty
    for lo, hi in ((0, 30), (30, 31), (31, 31), (31, 90)):
        two = similarity.detect(two, df.where((F.col("id") >= lo) & (F.col("id") < hi)), base, 8, 10, write)
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    kept = []
    for k, b in rows:
        if all(far(b, x) > 8 for _, x in kept):
            kept.append((k, b))
    name = lambda b: min(((far(b, x), k, f"i{k}") for k, x in enumerate(bits[:6]) if far(b, x) <= 10), default=(0, 0, None))[2]
    want = sorted((k, b, name(b)) for k, b in kept)
    assert sorted(map(tuple, one.collect())) == want == sorted(map(tuple, two.collect())) and any(n is None for _, _, n in want)
    named = similarity.register(two, spark.createDataFrame([(want[0][0], "x")], "id long, identity string"))
    assert {r["id"]: r["identity"] for r in named.collect()}[want[0][0]] == "x"
    assert sorted(r["id"] for r in similarity.prune(named, base, 10).collect()) == [k for k, _, n in want if n is not None]


def test_text_of_an_artifact_stays_in_its_row(spark):
    docs = [{"quotes": [{"text": "a", "text2": "no"}, "no"], "x.y": "b", "": "no", "id": ["no"], "rumors": {"claim": "no"}, "description\n": "c"}, {"id": "no"}, {"note": ""}]
    df = spark.createDataFrame([(f"p{k}", json.dumps(d)) for k, d in enumerate(docs)] + [("q", None)], "path string, j string").select("path", F.try_parse_json("j").alias("data"))
    got = artifacts.strings(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "RLIKE" not in plan
    assert {r["path"]: r["text"] for r in got.collect()} == {"p0": "c\na\nb", "p2": ""}


def test_walk_makes_no_pairs(spark, monkeypatch, tmp_path):
    """The filter in several steps, on many near hashes: no stored table has more rows than the hashes."""
    monkeypatch.setattr(similarity, "HEAD", 25)
    monkeypatch.setattr(similarity, "GROUP", 30)
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = [base[min(k // 5, 39)] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))) for k in range(240)]
    df = spark.createDataFrame([*((k, f"{h:064b}") for k, h in enumerate(hashes)), (900, None), (None, f"{base[0]:064b}")], "id long, bits string")
    sizes = []

    def write(t):
        path = str(tmp_path / f"w{len(sizes)}")
        t.write.parquet(path)
        out = spark.read.schema(t.schema).parquet(path)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", lambda t, name: write(t))
    kept: list[int] = []
    for k, h in enumerate(hashes):
        if all((h ^ hashes[x]).bit_count() > 20 for x in kept):
            kept.append(k)
    got = [r["id"] for r in similarity.greedy_walk(df, 20, write).collect()]
    assert sorted(k for k in got if k is not None) == [*kept, 900] and got.count(None) == 1 and len(sizes) > 6
    assert not similarity.greedy_walk(df.limit(0), 20, write).count()
    base20 = spark.createDataFrame([(0, "b", f"{base[0]:064b}")], "ord long, identity string, bits string")
    index = df.where("id < 100").withColumn("identity", F.lit(None).cast("string")).limit(0)
    assert sorted(r["id"] for r in similarity.detect(index, df.where("id < 900"), base20, 20, 24, write).collect()) == kept
    assert max(sizes) <= 242
