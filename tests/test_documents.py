"""Artifacts rendered to node bodies."""

import json

from pyspark.sql import functions as F

from plumbline.operators import documents

Q = [
    {"id": "q10", "text": "Long enough to be shown\nwith its own table of fields.", "source": {"path": "s", "location": "p. 1"}, "context": "Talk, 2004", "statement_date": "2004", "observation_type": "direct", "speaker_id": "sp1", "significance": "Point"},
    {"id": "q2", "text": "Yes.", "source": {"path": "s", "location": "p. 2"}, "statement_date": "2001-05", "observation_type": "relayed"},
]


def rows(spark, *data):
    table = [(f"r/{i}", t, k, json.dumps(d), json.dumps(fm)) for i, (t, k, d, fm) in enumerate(data)]
    df = spark.createDataFrame(table, "path string, node_type string, kind string, d string, f string")
    return df.select("path", "node_type", "kind", F.parse_json("d").alias("data"), F.parse_json("f").alias("fm"))


def test_bodies(spark):
    person = {"target_node": "people/jane-doe", "quotes": Q, "background": "B.", "affiliations": [{"id": "a1", "organization_path": "/o/x", "role": "r|s", "period_start": "2004", "period_end": "2005", "source": {"path": "s"}}, {"id": "a2", "organization_path": "/o/y", "flagged": True}],
              "rumors": [{"claim": "C", "status": "primary-source-disputed", "observed_sources": ["a", "b"], "note": "N"}], "naming_quirks": [{"observed": "o", "canonical": "c", "resolution": "disputed"}]}
    talk = {"target_node": "t/x", "context_extrinsic": {"display_title": "Talk"}, "quotes": Q, "speakers": [{"id": "sp1", "name": "Jane", "node_link": "/people/jane"}]}
    case = {"target_node": "i/x", "hypotheses": [{"id": "h1", "statement": "It is."}], "hypothesis_evaluation": [{"hypothesis_id": "H1", "status": "open", "text": "T.", "sources": [{"entity_path": "/e", "anchor": "q1", "description": "d"}]}]}
    hearing = {"target_node": "e/x", "participants": [{"participant_path": "/p/a", "capacity": "committee-member"}, {"participant_path": "/p/b", "capacity": "odd"}, {"participant_path": "/p/c", "flagged": True}], "timeline": [{"id": "t1", "date": "2005", "event": "second thing"}, {"id": "t2", "date": "2004-11", "event": "first thing"}, {"id": "t3", "event": "no day"}]}
    every = [(t, None, {"target_node": f"{t}s/x-y"}, {}) for t in documents.bodies("T")]
    out = {r["path"]: r["body"] for r in documents.render(rows(spark, ("person", None, person, {}), ("transcript", None, talk, {}), ("investigation", None, case, {"status": "paused", "question": "Why?"}), ("event", "hearing", hearing, {}), *every)).collect()}
    assert len(out) == 4 + len(every) and all(b.startswith("# ") and "\n---\n\n" in b and "null" not in b for b in out.values())
    p = out["r/0"]
    assert p.startswith("# Jane Doe\n\n## Identity") and "| [`/o/x`] | r\\|s | 2004 – 2005 | s |  |" in p and "### Flagged\n\n| Organization" in p
    assert '### "C"\n\n**Circulates in:** a; b\n\n**Primary-source refutation:** N' in p and "## Preserved Disagreements" in p and "## Source-Form Notes" not in p
    assert "> Yes.\n\n_2001-05; [archived source](../sources/s); p. 2_" in p and "| Attributed to | Talk, 2004 |" in p
    t = out["r/1"]
    assert t.index("> Yes.") < t.index("> Long enough") and "| Speaker | Jane ([`/people/jane`]) |" in t and "### Point\n\n> Long enough to be shown\n> with its own" in t
    i = out["r/2"]
    assert "## Question\n\nWhy?" in i and "### H1 — It is.\n\n**Status:** open\n\nT.\n\n**Sources:**\n\n- [`/e`] q1 — d" in i and "## Closure Path" in i and "## Counter-Evidence" not in i
    e = out["r/3"]
    assert e.index("#### Committee Members") < e.index("#### Other") < e.index("### Flagged") and e.index("first thing") < e.index("second thing") < e.index("no day")
