"""Clean and violating rows for the checks."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import artifacts, integrity, issues, manifest, nodes, ordering, render, rules, similarity, timeline, verbatim
from plumbline.functions.storage import shared_folder, written
from plumbline.sources import files
from plumbline.streaming import checks as streaming

SPEC = {
    "person": {
        "required": ["id", "type", "schema_version", "status"], "status_values": ["active", "in-progress"], "archetypes": {"eyewitness": {"required_sections": ["Identity", "Statements"]}, "reporter": {"required_sections": ["Identity"]}},
        "conditionally_required": {"Notes": "status == in-progress", "updated": "flag is set"}, "section_rules": {"Identity": {"prose_only": True}, "Statements": {"requires_quote_attribution": True, "split": ["Direct", "Flagged"]}},
    },
    "finding": {"required": ["id"], "required_sections": ["Evidence on {topic_display_name}"]},
}


def table(spark, rows):
    return spark.createDataFrame([(p, t, None if fm is None else json.dumps(fm), b) for p, t, fm, b in rows], "path string, node_type string, j string, body string").select("path", "node_type", F.try_parse_json("j").alias("fm"), "body")


def found(df, *cols):
    return sorted(tuple(r[c] for c in (cols or ("path", "message"))) for r in df.collect())


@pytest.fixture(scope="module")
def node_rows(spark):
    good = {"id": "people/a", "type": "person", "schema_version": 2, "status": "active", "archetype": "eyewitness"}
    body = "# A\n## Identity\nProse.\n## Statements\n### Direct\n> said\n> more\n\n| Source | x |\n## Life\n| Date | What | Note |\n|---|---|---|\n| 2004 | born [`/people/b`] | " + "w " * 60 + "|\n| | | |\n| 2004-11 | x | y |\n"
    bad = "# B\n## Identity\n| a | b |\n|---|---|\n| 1 | 2 |\n## Statements\n> one\n\n> two\n\n_said so_\n## Life\n| Date | What |\n|---|---|\n| 2005 | x |\n| TBD | y |\n| 2004-01 | " + "w " * 60 + "|\n| 2003 | z |\n[`/people/none`]\n"
    return table(spark, [
        ("people/a.md", "person", good, body), ("people/b.md", "person", {"id": "people/x", "type": "person", "schema_version": True, "status": "in-progress", "archetype": "eyewitness", "flag": 1}, bad),
        ("people/c.md", "person", {"type": "person", "schema_version": 9, "status": "odd", "archetype": "odd"}, "## Identity (old)\n"), ("x.md", None, None, "no header"), ("y.md", "zzz", {"type": "zzz"}, ""),
        ("f.md", "finding", {"id": "f", "type": "finding", "corpus": "c"}, "## Evidence on T — more\n"),
    ])


def test_node_checks(spark, node_rows):
    n = node_rows
    assert found(nodes.frontmatter_parse(n, SPEC)) == [("x.md", "no frontmatter"), ("y.md", "unknown type: zzz")]
    assert found(nodes.frontmatter_required(n, SPEC)) == [("people/c.md", "missing field: id")]
    assert found(nodes.schema_version_compat(n.where("node_type = 'person'"), [1, 2])) == [("people/b.md", "schema_version must be an integer"), ("people/c.md", "schema_version not supported: 9")]
    assert found(nodes.id_path_match(n)) == [("people/b.md", "id does not match the path: people/x")]
    assert found(nodes.vocabularies(n, SPEC)) == [("people/c.md", "invalid archetype: odd"), ("people/c.md", "invalid status: odd")]
    assert found(nodes.conditionally_required(n, SPEC)) == [("people/b.md", "missing section Notes (required when status == in-progress)"), ("people/b.md", "missing updated (required when flag is set)")]
    assert found(nodes.required_sections(n, SPEC, {"c": ["Extra"]}, "T")) == [("f.md", "missing section: Extra")]
    assert found(nodes.required_sections(n.withColumn("body", F.lit("")), SPEC).where("path = 'people/a.md'"), "message") == [("missing section: Identity",), ("missing section: Statements",)]
    assert found(nodes.section_rules(n, SPEC)) == [("people/b.md", "Identity: prose only, no tables"), ("people/b.md", "Statements: block quotes without attribution"), ("people/b.md", "Statements: missing ### Direct")]
    assert found(nodes.chronological_tables(n), "path", "level", "message") == [("people/b.md", "error", "Life: out of order at 2004-01"), ("people/b.md", "warn", "Life: unparseable date: TBD")]
    assert found(nodes.table_cell_word_budget(n)) == [("people/b.md", "Life: cell of 60 words")]
    assert [tuple(r) for r in nodes.link_resolution(n).collect()] == [("/people/none", "people/b.md", 1)]
    with pytest.raises(ValueError):
        nodes.condition("a > b")


def test_run_node_checks(spark, node_rows):
    got = issues.run_checks({"nodes": node_rows}, nodes.node_checks(SPEC, [1, 2]))
    assert {r["check_name"] for r in got.where("path = 'x.md'").collect()} == {"frontmatter_parse"}
    report = {(r["check_name"], r["level"]): r["n_issues"] for r in issues.report(got).collect()}
    assert report["frontmatter_parse", "error"] == 2 and report["chronological_tables", "warn"] == 1


def artifact_table(spark, rows):
    return spark.createDataFrame([(p, json.dumps(d), t) for p, d, t in rows], "path string, j string, target_type string").select("path", F.parse_json("j").alias("data"), "target_type")


@pytest.fixture(scope="module")
def art(spark):
    q = lambda i, **k: {"id": i, "added_date": "2026", "text": "the quick brown fox", "source": {"path": "s1", "location": "p. 1"}} | k
    a = {"id": "r/a", "type": "research-artifact", "target_node": "people/a", "status": "draft", "primary_sources": [{"path": "s1", "format": "txt", "sha256_at_extraction": "old"}, {"path": "s9"}], "naming_quirks": [], "created": 1, "document_intrinsic": {}, "context_extrinsic": {"w": "Context"},
         "quotes": [q("q1", observation_type="direct", context="c"), q("q1", text="a slow fox", context=" "), q("q3", source="x"), q("q4", source={"path": "s2", "location": 1}, observation_type="odd", context="c", corroborated_by=["q1", "zz"])],
         "entities_referenced": [{"id": "e1", "wrap_path": "/people/b", "name": "Bob", "references": [{"quote_id": "q1"}, {"quote_id": "q9"}]}, {"id": "e2", "wrap_path": "/people/a", "name": "A"}, {"id": "e3", "wrap_path": "/people/z", "name": "Z"}],
         "contradictions": [{"id": "c1", "positions": [{"evidence_id": "q1"}]}], "background": "zebra quick brown unicorn", "establishes": ["x", " ", 3], "note": {"deep": ["see /findings/f"]}}
    t = {"quotes": [q("q1", speaker_id="sp1"), q("q2", speaker_id="sp9"), q("q3", observation_type="direct", attestation_tier="odd")], "speakers": [{"id": "sp1", "name": "S", "node_link": "/people/b"}], "type": "other"}
    f = {"quotes": [q("q1"), q("q2", source={"path": "s3", "location": 1})], "x": "/investigations/i"}
    i = {"hypotheses": [{"id": "H1"}], "hypothesis_evaluation": [{"id": "1", "hypothesis_id": "h1", "status": "long enough status", "sources": [{"finding_path": "/findings/f", "description": "long enough text"}]}, {"id": "2", "hypothesis_id": "h2", "status": "short", "sources": [{"entity_path": "/p", "description": "long enough text"}]}, {"id": "3", "hypothesis_id": "H1", "status": "x" * 301}]}
    return artifact_table(spark, [("r/a.yaml", a, "person"), ("r/t.yaml", t, "transcript"), ("r/f.yaml", f, "finding"), ("r/i.yaml", i, "investigation")])


def test_artifact_checks(spark, art):
    paths = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_path string")
    top = found(artifacts.artifact_top_level(art, spark.createDataFrame([("people/a.md",)], "path string"), ("open",), ("person",)).where("path = 'r/a.yaml'"), "message")
    assert top == [("invalid status",), ("missing key: description",), ("missing key: schema_version",)]
    assert found(artifacts.primary_sources(art, paths), "message") == [("primary_sources[1]: missing format",), ("primary_sources[1]: not in manifest: s9",)]
    assert found(artifacts.checksum_at_extraction(art, spark.createDataFrame([("s1", "new")], "source_path string, sha256 string")), "message") == [("primary_sources[0]: source changed since extraction: s1",)]
    got = found(artifacts.quotes(art, spark.createDataFrame([("s1",), ("s3",)], "source_path string")), "path", "level", "message")
    assert got == [
        ("r/a.yaml", "error", "quotes[1]: missing context"), ("r/a.yaml", "error", "quotes[1]: missing observation_type"), ("r/a.yaml", "error", "quotes[2]: source must have path and location"),
        ("r/a.yaml", "error", "quotes[3]: invalid observation_type"), ("r/a.yaml", "error", "quotes[3]: source not in manifest: s2"), ("r/t.yaml", "error", "quotes[1]: unknown speaker: sp9"),
        ("r/t.yaml", "error", "quotes[2]: invalid attestation_tier"), ("r/t.yaml", "error", "quotes[2]: missing speaker_id"), ("r/t.yaml", "warn", "quotes[2]: observation_type is ignored here"),
    ]
    sources = spark.createDataFrame([("s1", "The\nthe  quick\nbrown fox."), ("s3", None)], "source_path string, text string")
    assert found(artifacts.verbatim_quotes(art, sources), "path", "level", "message") == [("r/a.yaml", "error", "quotes[1]: not verbatim in s1"), ("r/a.yaml", "error", "quotes[3]: source file missing: s2"), ("r/f.yaml", "warn", "quotes[1]: source has no text: s3")]
    assert found(artifacts.lifecycle(artifacts.entries(art, "quotes")), "path", "message") == [("r/a.yaml", "quotes[1]: duplicate id: q1")]
    refs = found(artifacts.reference_checks(art, ["quotes", "entities_referenced"]), "check_name", "message")
    assert refs == [("contradictions", "contradictions[0]: needs two positions"), ("cross_refs", "quotes[3]: reference to no entry: zz"), ("entities_referenced", "entities_referenced[0]: reference to no quote: q9")]
    assert found(artifacts.hypothesis_citations(art), "message") == [("hypothesis_evaluation[1]: a source must name one target, its anchor and a description",), ("hypothesis_evaluation[1]: status should have 10 to 300 characters",), ("hypothesis_evaluation[1]: unknown hypothesis: h2",), ("hypothesis_evaluation[2]: needs sources",), ("hypothesis_evaluation[2]: status should have 10 to 300 characters",)]
    assert found(artifacts.layer_references(art), "path", "message") == [("r/a.yaml", "$.note.deep[0]: reference to a higher layer"), ("r/f.yaml", "$.x: reference to a higher layer")]
    assert found(artifacts.finding_sources(art), "message") == [("quotes[1]: source is cited by no entity: s3",)]
    assert found(artifacts.string_lists(art), "message") == [("establishes[1]: must be a non-empty string",), ("establishes[2]: must be a non-empty string",)]
    assert found(artifacts.paused_without_path(art.withColumn("target_status", F.lit("paused"))), "path") == [("r/i.yaml",)]
    assert found(artifacts.speaker_baselines(art, spark.createDataFrame([("c",)], "slug string")), "message") == [("speakers[0]: no baseline image of b",)]
    drift = artifacts.prose_drift(art, sources, {"person": ["background"]}, {}).collect()
    assert [(r["level"], r["tokens"]) for r in drift] == [("warn", ["unicorn", "zebra"])]


def test_cross_layer_checks(spark, art):
    body = "# A\n## Description\nBob met Zed in 1999 at \"the quick\" place, per K-18.\n## Q\n> the quick brown fox\n[`/people/b`]\n## Associated Nodes\nold\n"
    pairs = art.where("path = 'r/a.yaml'").withColumn("node_body", F.lit(body)).withColumn("source_text", F.lit("In 1999 the quick brown k-18"))
    assert found(artifacts.coverage(pairs), "message") == [("quotes[1]: not in the node: a slow fox",)]
    assert found(artifacts.stub_linking(pairs), "message") == [("not linked: /people/z",)]
    assert found(artifacts.description_drift(pairs), "message") == [("not in source: Zed",)]
    same = spark.createDataFrame([("r/a.yaml", body.replace("old", "new"))], "path string, body string")
    assert not artifacts.boundary(pairs, same).count() and artifacts.boundary(pairs, same.withColumn("body", F.lit("else"))).count() == 1


def test_raw_and_parse(spark):
    raw = spark.createDataFrame([("a", "x: see issue #3 of the list\ny: 'a #b c d'\nz: http://x # one two\nw: He said: no way out\nv: at 10: 30 or so\n")], "path string, raw string")
    assert found(artifacts.raw_line_traps(raw), "message") == [("line[0]: text after ' #' is lost; quote the value",), ("line[3]: inner ': ' needs quotes",)]
    docs = spark.createDataFrame([("ok", "a: 1\nb: [x]\n"), ("twice", "a: 1\na: 2\n"), ("list", "- 1\n"), ("bad", "a: [\n")], "path string, raw string")
    parsed = files.parse_documents(docs)
    assert [p for p, _ in found(artifacts.artifact_parse(parsed))] == ["bad", "list", "twice"]
    nodes_ = files.split_nodes(spark.createDataFrame([("a", "---\nid: x\n---\nbody"), ("b", "no header")], "path string, raw string")).collect()
    assert [(r["raw_frontmatter"], r["body"]) for r in nodes_] == [("id: x", "body"), (None, None)]


def entry_rows(spark, rows):
    return spark.createDataFrame([(p, s, i, json.dumps(e)) for p, s, i, e in rows], "path string, section string, idx int, j string").select("path", "section", "idx", F.parse_json("j").alias("entry"))


SRC = {"path": "s1", "location": "p. 1"}


@pytest.mark.parametrize(
    "section, entry, want",
    [
        ("timeline", {"date": "x", "event": "y", "source": SRC}, []),
        ("rumors", {"claim": "c", "status": "odd"}, ["status not in vocabulary: odd"]),
        ("rumors", {"claim": "c", "status": ""}, ["status not in vocabulary: "]),
        ("program_involvement", {"program": "p", "role": "r", "evidentiary_basis": "odd", "confidence": "", "source": SRC}, ["evidentiary_basis not in vocabulary: odd"]),
        ("vouching_chain", {"voucher_path": "x", "attestation": "a", "confidence": "sure", "source": SRC}, ["confidence not in vocabulary: sure", "voucher_path must start with /"]),
        ("speakers", {"name": "n", "node_link": "people/x", "source": SRC}, ["node_link must start with /"]),
        ("speakers", {"name": "n", "node_link": "", "source": SRC}, []),
        ("media_versioning", {"aspect": "odd", "parent_form": "a", "this_form": "b", "source": SRC}, ["warn: aspect not in vocabulary: odd"]),
        ("key_personnel", {"person_path": "/p", "role": "r", "leadership_class": "", "source": SRC}, ["leadership_class not in vocabulary: "]),
        ("key_personnel", {"person_path": "", "role": "r", "leadership_class": None, "source": SRC}, []),
        ("org_relationships", {"organization_path": "/o", "relationship_type": "", "source": SRC}, ["relationship_type not in vocabulary: "]),
        ("contracts", {"contract_number": " ", "contracting_agency": "x", "period_start": "p", "primary_counterparty_path": "o", "deliverables": ["/a", "b"], "source": {"path": "s2", "location": None}}, ["blank contract_number", "deliverables must be a list of paths that start with /", "primary_counterparty_path must start with /", "source not in manifest: s2"]),
        ("top_scope_activity", {"period_start": "p", "activity": "a", "actor_paths": "x", "source": SRC}, ["actor_paths must be a list of paths that start with /"]),
        ("top_scope_activity", {"period_start": "p", "activity": "a", "actor_paths": [], "source": SRC}, []),
        ("cited_findings", {"finding_path": "/people/x", "relevance": "r"}, ["finding_path must start with /findings/"]),
        ("naming_quirks", {"observed": "o", "canonical": "c", "location": 1, "source_path": "s9", "resolution": ""}, ["resolution not in vocabulary: ", "source not in manifest: s9"]),
        ("affiliations", {"organization_path": "org/x", "role": "r", "source": "s1"}, ["organization_path must start with /", "source must have path and location"]),
        ("affiliations", {"organization_path": "/o", "role": "r", "source": {"path": "s1"}}, ["source must include path and location"]),
    ],
)
def test_entry_rules(spark, section, entry, want):
    known = spark.createDataFrame([("s1",)], "source_path string")
    got = rules.entry_issues(entry_rows(spark, [("a", section, 0, {"added_date": "d"} | entry)]), known).collect()
    assert sorted(("warn: " if r["level"] == "warn" else "") + r["message"].split(": ", 1)[1] for r in got) == want


def test_vocabularies_of_a_schema(spark):
    mine = rules.vocabularies_of({"confidence_values": ["sure"], "naming_quirk_entry": {"resolution_values": ["kept"]}, "key_personnel_entry": {"leadership_class_values": ["head"]}})
    assert mine["confidence"] == ("sure",) and mine["naming_quirks.resolution"] == ("kept",) and mine["key_personnel.leadership_class"] == ("head",) and mine["rumors.status"] == rules.VOCABULARIES["rumors.status"]
    known = spark.createDataFrame([("s1",)], "source_path string")
    row = entry_rows(spark, [("a", "key_personnel", 0, {"added_date": "d", "person_path": "/p", "role": "r", "leadership_class": "head", "source": SRC})])
    assert not rules.entry_issues(row, known, rules.entry_rules(mine)).count() and rules.entry_issues(row, known).count() == 1


def test_derived_media_and_crashing_checks(spark):
    rows = [("a", {"media_versioning": []}, "/media/x"), ("b", {"media_versioning": [{}]}, "/media/x"), ("c", {"media_versioning": []}, ""), ("d", {}, "/media/x")]
    df = spark.createDataFrame([(p, json.dumps(d), x) for p, d, x in rows], "path string, j string, derivation_of string").select("path", F.parse_json("j").alias("data"), "derivation_of")
    assert found(rules.empty_while_derived(df), "path") == [("a",)]
    broken = issues.Check("broken", 0, lambda t: t["rows"].select("nothing"))
    late = issues.Check("late", 1, lambda t: issues.issues(t["rows"], F.col("path"), F.lit("late"), "late"))
    got = issues.run_checks({"rows": df}, [late, broken]).collect()
    assert {(r["check_name"], r["fatal"]) for r in got} == {("broken", True)} and len(got) == 4 and "check crashed" in got[0]["message"]


def test_manifest_reading(spark):
    raw = [("m", json.dumps([{"url": "u2", "artifacts": [{"path": "b", "extraction_type": None}, {"path": "a", "extraction_type": "odd"}, {"path": "c"}], "status": "pending"}, {"url": "u1"}])), ("n", "{}"), ("o", "[")]
    parsed = files.parse_documents(spark.createDataFrame(raw, "path string, raw string"), "json")
    assert [p for p, _ in found(manifest.parse_gate(parsed))] == ["n", "o"]
    entries = manifest.load(parsed)
    assert found(manifest.extraction_types(entries), "path", "message") == [("u2", "invalid extraction_type: null of b"), ("u2", "invalid extraction_type: odd of a")]
    saved = [(r["url"], json.loads(r["json"])) for r in manifest.ordered_entries(entries).orderBy("url").collect()]
    assert [u for u, _ in saved] == ["u1", "u2"] and [a["path"] for a in saved[1][1]["artifacts"]] == ["a", "b", "c"] and saved[1][1]["fields"] == {"status": "pending"}


def test_presence(spark):
    df = spark.createDataFrame([('{"a": null, "b": "", "c": " ", "d": 0, "e": false, "f": [], "g": "x"}',)], "j string").select(F.parse_json("j").alias("b"))
    r = df.select(*[fn(F.col("b"), k).alias(f"{fn.__name__}_{k}") for fn in (rules.absent, rules.is_none, rules.falsy, rules.blank) for k in "abcdefgz"]).first().asDict()
    flags = {n: "".join("1" if r[f"{n}_{k}"] else "0" for k in "abcdefgz") for n in ("absent", "is_none", "falsy", "blank")}
    assert flags == {"absent": "00000001", "is_none": "10000001", "falsy": "11011101", "blank": "11100001"}


def test_manifest(spark):
    art_t = "array<struct<format:string,path:string,sha256:string,extraction_type:string>>"
    rows = [("u1", "archived", 3, "2025", None, [("html", "a", "h1", None)]), ("u2", "pending", 1, None, None, []), ("u3", "archived", None, None, None, []), ("u4", "odd", 2, "2025", True, [("zip", "a", None, "odd")]), ("u4", "pending", 7, None, None, None)]
    m = spark.createDataFrame(rows, f"url string, status string, archive_status int, wayback_date string, wayback_skip boolean, artifacts {art_t}")
    assert found(manifest.archive_status(m), "path", "message") == [("u2", "archive_status: local bit"), ("u3", "archive_status: missing"), ("u4", "archive_status: out of range"), ("u4", "archive_status: skipped but has a snapshot")]
    assert found(manifest.value_enums(m), "message") == [("invalid extraction_type: odd",), ("invalid format: zip",), ("invalid status: odd",)]
    assert found(manifest.artifact_shape(m), "path", "message") == [("u1", "path occurs more than once: a"), ("u3", "artifacts do not agree with status"), ("u4", "artifacts do not agree with status"), ("u4", "url occurs more than once")]
    assert found(manifest.checksums(m, spark.createDataFrame([("a", "h2")], "path string, sha256 string")), "path", "message") == [("u1", "a: sha256 mismatch"), ("u4", "a: no sha256")]
    assert [r["archive_status"] for r in manifest.refreshed(m).orderBy("url", "status").collect()] == [3, 0, 0, 2, 0]


def test_interval_lookup(spark):
    rng = random.Random(3)
    segs = [(i, a := round(rng.uniform(0, 300), 2), a + round(rng.uniform(0, 9), 2)) for i in range(80)]
    ticks = [(k, rng.choice([float(rng.randrange(0, 310)), segs[k % 80][1], segs[k % 80][2]])) for k in range(200)]
    want = {}
    for k, t in ticks:
        inside = [i for i, a, b in segs if a <= t <= b]
        near = min(((max(a - t, t - b), i) for i, a, b in segs))
        want[k] = inside[0] if inside else near[1] if near[0] <= 1.0 else None
    got = timeline.locate(spark.createDataFrame(ticks, "id int, ts double"), spark.createDataFrame(segs, "idx int, start double, end double"), 4.0)
    assert {r["id"]: r["idx"] for r in got.collect()} == want


def test_similarity(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    nums = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & ((1 << 64) - 1) for b in base for _ in range(12)]
    df = spark.createDataFrame([(i, format(n, "064b")) for i, n in enumerate(nums)], "id long, bits string")
    want = sorted((i, j, (nums[i] ^ nums[j]).bit_count()) for i in range(len(nums)) for j in range(i + 1, len(nums)) if (nums[i] ^ nums[j]).bit_count() <= 5)
    pairs = similarity.close_pairs(df, 5)
    assert sorted(map(tuple, pairs.collect())) == want and want
    kept: list[int] = []
    for i in range(len(nums)):
        if all((nums[i] ^ nums[k]).bit_count() > 5 for k in kept):
            kept.append(i)
    got = similarity.greedy_keep(df.select("id"), pairs.select("a", "b"), lambda d: written(d, "t"))
    assert sorted(r["id"] for r in got.where("kept").collect()) == kept


def test_walk_render_and_order(spark):
    doc = {"a": ["x", {"b": "y"}], "c": 1, "d": {"e": {"f": "z"}}}
    rows = spark.createDataFrame([(7, json.dumps(doc))], "k int, j string").select("k", F.parse_json("j").alias("v"))
    assert sorted(map(tuple, integrity.walk_strings(rows, "k", "v").collect())) == [(7, "$.a[0]", "x"), (7, "$.a[1].b", "y"), (7, "$.d.e.f", "z")]
    t = spark.createDataFrame([(1, 2, "b|c"), (1, 1, "a\nb")], "k int, o int, t string")
    assert render.table(t, ["k"], ["T"], [F.col("t")], F.col("o")).first()["body"] == "| T |\n|---|\n| a b |\n| b\\|c |"
    s = spark.createDataFrame([("x<!-- s -->old<!-- e -->y",)], "d string").select(render.splice(F.col("d"), "<!-- s -->", "<!-- e -->", F.lit("new")).alias("d")).first()["d"]
    assert s == "x<!-- s -->\nnew\n<!-- e -->y"
    runs = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True, False])], "g int, p int, m boolean")
    assert ordering.run_counts(runs, ["g"], "p", F.col("m")).first()["n_runs"] == 2


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, g string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, g string, value double").parquet(f"{tmp_path}/in")
    check = lambda b: issues.issues(b.where("value > 1"), F.col("id"), F.lit("large"), "large")
    streaming.run_checks_on(stream, check, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["2"]


@pytest.mark.parametrize("most", [0, 1, 3, 16, 20])
def test_close_hashes_below_all_pairs(spark, most):
    """Equal to brute force, from a part of all pairs; equal hashes and copies of ids apart by nothing are found once."""
    rng = random.Random(most)
    hashes = [rng.getrandbits(64) for _ in range(300)]
    for k in range(150):  # near copies at every distance about the limit
        h = hashes[k]
        for b in rng.sample(range(64), rng.randint(0, most + 3)):
            h ^= 1 << b
        hashes.append(h)
    df = spark.createDataFrame([(i, f"{h:064b}") for i, h in enumerate(hashes)], "id long, bits string")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= most}
    assert sorted(map(tuple, similarity.close_pairs(df, most).collect())) == sorted(want) and len(want) > (10 if most > 1 else 0)
    two = similarity.close_between(df.where("id < 300"), df.where("id >= 300"), most).collect()
    assert sorted(map(tuple, two)) == sorted(w for w in want if w[0] < 300 <= w[1])
    if most == 16:
        met = similarity._meetings(df, df, most).where("x.id < y.id").count()
        assert met < len(hashes) * (len(hashes) - 1) / 2 / 10
    plan = similarity.plan_blocks(most)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == most + 1


def test_wide_radii_compare_groups_side_by_side(spark, monkeypatch):
    """No flipped values at 16 bits; every two groups are compared once, nulls and equal ids are no pairs, and a mean is taken once a row."""
    monkeypatch.setattr(similarity, "GROUP", 40)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = base + [base[k % 30] ^ sum(1 << b for b in rng.sample(range(64), k % 20)) for k in range(120)] + base[:3] * 2
    df = spark.createDataFrame([*((i, f"{h:064b}") for i, h in enumerate(hashes)), (0, f"{hashes[0]:064b}"), (900, None), (None, f"{hashes[1]:064b}")], "id long, bits string")
    got = similarity.close_pairs(df.where("id is null or id <> 0"), 16)
    assert "flip" not in plan_of(got) and "MapInArrow" in plan_of(got)
    want = [(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if 0 < i < j and (a ^ b).bit_count() <= 16]
    assert sorted(map(tuple, got.collect())) == want
    assert not similarity.close_pairs(df.where("id = 0"), 16).collect() and not similarity.close_pairs(df.limit(0), 16).collect()
    few = spark.createDataFrame([([1.0, 3.0, 2.5], ), ([], ), (None, )], "v array<double>").select(similarity.mean_bits(F.col("v")).alias("bits"))
    assert "transform(array((aggregate(" in plan_of(few.where("bits <> 'x'")) and [r["bits"] for r in few.collect()] == ["011", "", None]


def test_containment_stores_no_word_of_a_text(spark):
    """Both directions against brute force, with passages of every length; only the passages' keys are stored."""
    rng = random.Random(5)
    words = ["a", "ab", "abc", "bcd", "longerword", "anotherword", "é"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, line(rng.randrange(40))) for k in range(80)] + [(900, ""), (901, "gerword anotherwo")]
    cut = lambda t: t[(i := rng.randrange(len(t) + 1)) : i + rng.randrange(60)]
    passages = [(k, " ".join(cut(texts[rng.randrange(80)][1]).split())) for k in range(60)] + [(k, line(k % 5)) for k in range(60, 80)]
    t, p = spark.createDataFrame(texts, "doc_id long, norm string"), spark.createDataFrame(passages, "item_id long, norm string")
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = len(list(root.glob("words-*")))
    assert sorted(map(tuple, verbatim.containment(t, p).collect())) == sorted((i, j) for i, x in texts for j, y in passages if y in x)
    assert len(list(root.glob("words-*"))) == before
    assert sorted(r[0] for r in verbatim.within(p.select("norm"), t).collect()) == sorted({y for _, y in passages if any(y in x for _, x in texts)})
    assert verbatim.containment(t, p.limit(0)).count() == 0 == verbatim.within(p.select("norm"), t.limit(0)).count()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_are_told_within_a_row(spark):
    """Of equal titles the first, without a shuffle of the texts."""
    df = spark.createDataFrame([("p", "t", None, "# A\n## X \none\n## Y\ntwo\n## X\nthree\n## Z"), ("q", "t", None, "none"), ("r", "t", None, None)], "path string, node_type string, fm string, body string")
    got = nodes.sections(df)
    assert sorted((r["path"], r["ord"], r["title"], r["text"]) for r in got.collect()) == [("p", 0, "X", "one\n"), ("p", 1, "Y", "two\n"), ("p", 3, "Z", "")]
    assert "Window" not in plan_of(got)
