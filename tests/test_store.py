"""Folders that are replaced as a whole: manifests and single documents."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files, store


def entries(spark, n, mark=""):
    rows = [(f"u{(k * 37) % n:04d}", json.dumps({"url": f"u{(k * 37) % n:04d}", "note": f"é {k}{mark}\n x", "artifacts": [{"path": f"p{k}"}]}, ensure_ascii=False)) for k in range(n)]
    return spark.createDataFrame(rows, "url string, json string").repartition(5)


def read(spark, folder):
    return [(r["position"], r["url"], json.loads(r["j"])) for r in store.load_manifest(spark, folder).select("position", "url", F.to_json("data").alias("j")).orderBy("position").collect()]


def attempt(writer, rows):
    return writer.write(iter([dict(zip(("path", "raw"), r)) for r in rows]))


def test_manifest_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    store.save_manifest(entries(spark, 300), folder, 4)
    got = read(spark, folder)
    assert [r[0] for r in got] == list(range(300)) and [r[1] for r in got] == sorted(r[1] for r in got)
    assert got[5][2]["note"].startswith("é ") and store.load_manifest(spark, folder).where("error is not null").count() == 0
    assert store.load_manifest(spark, folder).rdd.getNumPartitions() > 1
    state = store.current(store.local(folder))
    text = "".join((store.local(folder) / state["version"] / f).read_text() for f, _ in state["parts"])
    assert text.startswith("- {") and text.count("\n- {") == 299  # the parts one after the other are one YAML list


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "m")
    store.save_manifest(entries(spark, 40), folder)
    before = read(spark, folder)
    bad = entries(spark, 60, "new").unionByName(spark.createDataFrame([("zzz", '{"a": 1, "a": 2}')], "url string, json string"))
    with pytest.raises(Exception, match="duplicate key"):
        store.save_manifest(bad, folder)
    assert read(spark, folder) == before
    # a driver that ends before the commit leaves a version that nothing names
    writer = store._ManifestWriter({"path": folder}, True)
    (writer.root / "part-0").write_text('- {"url": "x"}\n')
    assert read(spark, folder) == before
    with pytest.raises(ValueError, match="overwrite"):
        store._ManifestWriter({"path": folder}, False)


def test_replacing_is_one_act_and_old_readers_end(spark, tmp_path):
    folder = str(tmp_path / "m")
    store.save_manifest(entries(spark, 20, "a"), folder)
    old = store._ManifestReader({"path": folder})
    pieces = old.partitions()
    store.save_manifest(entries(spark, 30, "b"), folder)
    assert len(read(spark, folder)) == 30 and all(r[2]["note"].endswith("b\n x") for r in read(spark, folder))
    assert sum(len(list(old.read(p))) for p in pieces) == 20
    store.save_manifest(entries(spark, 10, "c"), folder)
    store.save_manifest(entries(spark, 1, "d"), folder)
    assert len([p for p in os.listdir(folder) if p.startswith("v-")]) == store.KEPT and len(read(spark, folder)) == 1
    store.save_manifest(entries(spark, 5).limit(0), folder)
    assert read(spark, folder) == []


def test_single_files_and_faults(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"url": "a"}, {"x": 1}, 7]')
    got = store.load_manifest(spark, str(tmp_path / "one.json")).orderBy("position").collect()
    assert [(r["position"], r["url"], r["error"]) for r in got] == [(0, "a", None), (1, None, None), (2, None, None)]
    for text in ('{"url": 1}', '[{"a": 1, "a": 2}]', "["):
        (tmp_path / "bad.json").write_text(text)
        rows = store.load_manifest(spark, str(tmp_path / "bad.json")).collect()
        assert len(rows) == 1 and rows[0]["error"] and rows[0]["data"] is None
    with pytest.raises(Exception, match="no version"):
        store.load_manifest(spark, str(tmp_path / "nothing")).collect()
    with pytest.raises(ValueError, match="mounts"):
        store.local("s3a://bucket/x")


def test_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    rows = [(f"people/p{k}.md", f"---\nid: p{k}\n---\n# é {k}\r\nline\n") for k in range(50)] + [("empty.md", None), ("deep/er/x.md", "")]
    df = spark.createDataFrame(rows, "path string, raw string").repartition(6)
    store.save_documents(df, folder)
    assert {(r["path"], r["raw"]) for r in store.load_documents(spark, folder).collect()} == {(p, t or "") for p, t in rows}
    nodes = {r["path"]: r for r in files.split_nodes(store.load_documents(spark, folder)).collect()}
    assert nodes["people/p3.md"]["raw_frontmatter"] == "id: p3" and nodes["deep/er/x.md"]["body"] is None
    for bad in ("../x", "/x", "", "a/../../b"):
        with pytest.raises(Exception, match="no name"):
            store.save_documents(spark.createDataFrame([("ok.md", "new"), (bad, "t")], "path string, raw string"), folder)
    with pytest.raises(ValueError, match="two documents"):
        store.save_documents(df.unionByName(df.limit(1)), folder)
    assert store.load_documents(spark, folder).count() == 52 and store.load_documents(spark, folder).where("raw = 'new'").count() == 0


def test_a_part_of_documents_has_a_folder_of_its_own(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "d")
    rows = [(f"people/p{k}.md", f"t{k}\r\né") for k in range(60)]
    store.save_documents(spark.createDataFrame(rows, "path string, raw string").repartition(6, "path"), folder)
    state = store.current(store.local(folder))
    tree = store.local(folder) / state["version"] / "files"
    parts = {p: n for p, n in state["parts"] if n}
    assert len(parts) > 1 and {p.name: len(list((p / "people").iterdir())) for p in tree.iterdir()} == parts  # tasks share no folder, and nothing but documents stays
    # what a repeated attempt writes after the first one, of other content even, changes nothing that is read
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    writer = store._DocumentWriter({"path": folder}, True)
    first = attempt(writer, [("a/x.md", "first"), ("y.md", None)])
    attempt(writer, [("a/x.md", "late"), ("y.md", "late")])
    writer.commit([first])
    assert {(r["path"], r["raw"]) for r in store.load_documents(spark, folder).collect()} == {("a/x.md", "first"), ("y.md", "")}


def test_two_spellings_of_one_file_do_not_lose_a_document(spark, tmp_path):
    folder = str(tmp_path / "d")
    rows = spark.createDataFrame([("a/x.md", "one"), ("a//x.md", "two")], "path string, raw string")
    with pytest.raises(Exception, match="exists"):
        store.save_documents(rows.coalesce(1), folder)
    store.save_documents(rows.where("raw = 'one'"), folder)
    assert [tuple(r) for r in store.load_documents(spark, folder).collect()] == [("a/x.md", "one")]


def test_documents_of_a_version_without_folders_of_parts_are_read(spark, tmp_path):
    (tmp_path / "v-1" / "files" / "people").mkdir(parents=True)
    (tmp_path / "v-1" / "files" / "people" / "p.md").write_text("old é")
    (tmp_path / "v-1" / "part-000000-x").write_text("people/p.md\n")
    store.replace_current(tmp_path, {"version": "v-1", "parts": [["part-000000-x", 1]]})
    assert [tuple(r) for r in store.load_documents(spark, str(tmp_path)).collect()] == [("people/p.md", "old é")]


def test_documents_are_read_in_batches_of_bounded_size(spark, tmp_path):
    folder = str(tmp_path / "d")
    rows = [(f"d/{k:04d}.md", f"{k} é" + "x" * (3 << 20 if k % 100 == 7 else k % 3)) for k in range(2 * store.AHEAD + 3)]
    store.save_documents(spark.createDataFrame(rows, "path string, raw string").coalesce(1), folder)
    reader = store._DocumentReader({"path": folder})
    (piece,) = reader.partitions()
    batches = list(reader.read(piece))
    assert len(batches) == 2 and all(sum(map(len, b["raw"].to_pylist())) < store.BATCH + (4 << 20) for b in batches)  # three texts of 3 MB
    assert [r for b in batches for r in zip(b["path"].to_pylist(), b["raw"].to_pylist())] == rows
    assert [tuple(r) for r in store.load_documents(spark, folder).orderBy("path").collect()] == rows
    store.save_documents(spark.createDataFrame(rows[:1], "path string, raw string").limit(0), folder)
    assert store.load_documents(spark, folder).collect() == []


def test_nodes_and_documents_read_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\nid: a\n---\nbody")
    (tmp_path / "b.md").write_text("no header")
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "d.json").write_text('{"x": 1, "x": 2}')
    nodes = {os.path.basename(r["path"]): r for r in files.read_nodes(spark, str(tmp_path)).collect()}
    assert nodes["a.md"]["body"] == "body" and nodes["b.md"]["raw_frontmatter"] is None and len(nodes) == 2
    docs = {os.path.basename(r["path"]): r["error"] for r in files.read_documents(spark, str(tmp_path), "*.json", "json").select("path", "error").collect()}
    assert docs == {"c.json": None, "d.json": "duplicate key: x"}


def test_transcripts_one_a_slug(spark):
    rows = [("a", "u1", 5.0, " two "), ("a", "u1", 0.0, "one"), ("b", "u2", 61.0, "x")]
    got = {r["path"]: r["raw"] for r in files.transcript_documents(spark.createDataFrame(rows, "slug string, url string, start double, text string")).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].startswith("# Transcript — a\n\nSource URL: u1\n\n[") and got["a.md"].endswith("] two\n") and got["a.md"].index("one") < got["a.md"].index("two")
    turns = [("a", "s1", 0.0, 2.0), ("a", "s2", 2.0, 9.5), ("a", "s1", 10.0, 11.0), ("b", "s1", 0.0, 1.0)]
    maps = {r["path"]: r["raw"] for r in files.speaker_maps(spark.createDataFrame(turns, "slug string, speaker string, start double, end double")).collect()}
    assert maps == {"a-speakers.csv": "speaker,name,total_seconds,segments\ns2,,7.500,1\ns1,,3.000,2\n", "b-speakers.csv": "speaker,name,total_seconds,segments\ns1,,1.000,1\n"}
