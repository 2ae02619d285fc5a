"""Connectors for folders that are replaced as a whole: manifests and single documents.

A folder holds versions; ``CURRENT`` names the one that counts and the parts
that its tasks wrote. A write puts all it has into a new version; only when every
task has ended does the driver replace ``CURRENT``, in one rename. A write that
fails, at whatever point, leaves the version before it as it was, and readers
that have begun keep theirs. What a lost or repeated task wrote is in no part
that ``CURRENT`` names.

Two formats are given to Spark (``register``):

``plumbline-manifest``: entries (url, json), one a line of YAML, in the order of
the partitions and rows written. Reading gives position, url, json and error; the
position follows from the counts in ``CURRENT``, so nothing is numbered by a
global window. A single YAML or JSON file is read, too.

``plumbline-documents``: rows (path, raw), each a file of that name under the
folder of its part, ``<version>/files/<part>``. A folder for each attempt of a task
needs no second name and rename for a file, and no two tasks wait for one another's
folder, so a file costs the same however many there are. Reading gives them back,
one partition a part.

Folders are reached by the workers themselves, so they are on a file system that
all executors mount; another scheme than ``file:`` raises.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import batched
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import strict_json, strict_yaml

CURRENT = "CURRENT"
#: Versions that stay when a new one is committed, itself included; a reader that began with the one before can end.
KEPT = 2
#: Documents that a task has open at once, bytes of each that are asked for ahead, and characters from which a batch is given to Spark.
AHEAD, ASKED, BATCH = 128, 1 << 20, 1 << 22


def local(path: str) -> Path:
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and "/" not in scheme:
        raise ValueError(f"the folder must be on a file system that every executor mounts: {path}")
    return Path("/" + rest.lstrip("/") if colon and scheme == "file" else path)


def current(folder: Path) -> dict | None:
    """The version that counts; none before the first commit."""
    try:
        return json.loads((folder / CURRENT).read_text())
    except FileNotFoundError:
        return None


def replace_current(folder: Path, state: dict) -> None:
    """One rename; whoever opens CURRENT meets the old one or the new one."""
    fresh = folder / f".{CURRENT}-{uuid.uuid4().hex}"
    with fresh.open("w") as f:
        json.dump(state, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(fresh, folder / CURRENT)


@dataclass
class Part(WriterCommitMessage):
    task: int
    file: str
    rows: int


@dataclass
class Piece(InputPartition):
    file: str
    position: int
    version: str


class VersionWriter(DataSourceWriter):
    """Writes a new version beside the current one. Subclasses write the rows of a task."""

    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ValueError("a version is replaced as a whole; write with mode('overwrite')")
        self.folder = local(options["path"])
        self.version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.root = self.folder / self.version
        self.root.mkdir(parents=True)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex[:8]}"
        rows = 0
        with (self.root / name).open("w", encoding="utf-8", newline="\n") as out:
            for row in iterator:
                out.write(self.line(row, name) + "\n")
                rows += 1
        return Part(task, name, rows)

    def line(self, row, part: str) -> str:
        raise NotImplementedError

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        replace_current(self.folder, {"version": self.version, "parts": [[m.file, m.rows] for m in parts]})
        for old in sorted(p for p in self.folder.glob("v-*") if p.name <= self.version)[:-KEPT]:
            shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


class VersionReader(DataSourceReader):
    """A partition for each part of the version that is current when the read is planned."""

    def __init__(self, options: dict):
        self.folder = local(options["path"])

    def partitions(self) -> list[Piece]:
        state = current(self.folder)
        if state is None:
            raise FileNotFoundError(f"no version has been committed to {self.folder}")
        out, position = [], 0
        for file, rows in state["parts"]:
            if rows:
                out.append(Piece(file, position, state["version"]))
            position += rows
        return out or [Piece("", 0, state["version"])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if piece.file:
            with (self.folder / piece.version / piece.file).open(encoding="utf-8", newline="\n") as lines:
                for k, line in enumerate(lines):
                    yield self.row(piece, k, line.rstrip("\n"))

    def row(self, piece: Piece, k: int, line: str) -> tuple:
        raise NotImplementedError


# -- manifests
class _ManifestWriter(VersionWriter):
    def line(self, row, part: str) -> str:
        return "- " + strict_json(row["json"])  # an entry of a YAML list; JSON has no line breaks inside


def _entry(text: str, parse) -> tuple:
    """(url, json, error) of an entry; one that can't be read is a row with its error."""
    try:
        body = parse(text)
        value = json.loads(body)
        url = value.get("url") if isinstance(value, dict) else None
        return (None if url is None else str(url)), body, None
    except Exception as e:
        return None, None, str(e).split("\n")[0][:200]


class _ManifestReader(VersionReader):
    def partitions(self) -> list[Piece]:
        return [Piece(str(self.folder), 0, "")] if self.folder.is_file() else super().partitions()

    def read(self, piece: Piece) -> Iterator[tuple]:
        if piece.version:
            yield from super().read(piece)
            return
        text = Path(piece.file).read_text(encoding="utf-8")
        try:
            body = json.loads(strict_json(text) if piece.file.endswith(".json") else strict_yaml(text))
            if not isinstance(body, list):
                raise ValueError("root is no list")
        except Exception as e:  # a manifest that can't be read is one row with its error
            yield 0, None, None, str(e).split("\n")[0][:200]
            return
        for k, entry in enumerate(body):
            yield k, *_entry(json.dumps(entry, ensure_ascii=False), str)

    def row(self, piece: Piece, k: int, line: str) -> tuple:
        return piece.position + k, *_entry(line.removeprefix("- "), strict_json)


class Manifests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline-manifest"

    def schema(self) -> str:
        return "position long, url string, json string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "json" not in schema.fieldNames():
            raise ValueError("a manifest is written from a column json")
        return _ManifestWriter(self.options, overwrite)


# -- single documents
class _DocumentWriter(VersionWriter):
    def write(self, iterator: Iterator) -> Part:
        self.made: set[str] = set()  # folders that this task has made
        return super().write(iterator)

    def line(self, row, part: str) -> str:
        """Writes the row's file under the part's folder and gives its name for the part's list. Plain strings: a Path for each file costs as much as the file."""
        name = row["path"]
        if not name or name.startswith("/") or ".." in name.split("/") or "\n" in name:
            raise ValueError(f"no name for a document: {name!r}")
        target = f"{self.root}/files/{part}/{name}"
        parent = target.rpartition("/")[0]
        if parent not in self.made:
            os.makedirs(parent, exist_ok=True)
            self.made.add(parent)
        with open(target, "xb") as f:
            f.write((row["raw"] or "").encode("utf-8"))
        return name


def _texts(folder: str, names: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(name, text) of files, opened and asked for some at a time: on a cold disk they come side by side, not each after a wait of its own."""
    for some in batched(names, AHEAD):
        with ExitStack() as opened:
            held = [opened.enter_context(open(f"{folder}/{name}", "rb", buffering=0)) for name in some]
            for f in held:
                os.posix_fadvise(f.fileno(), 0, ASKED, os.POSIX_FADV_WILLNEED)
            for name, f in zip(some, held):
                yield name, f.readall().decode("utf-8")


class _DocumentReader(VersionReader):
    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        tree = f"{self.folder / piece.version}/files"
        own = f"{tree}/{piece.file}"
        folder = own if os.path.isdir(own) else tree  # versions of before parts had folders are one tree
        schema = pa.schema([("path", pa.string()), ("raw", pa.string())])
        rows, size = {"path": [], "raw": []}, 0
        for path, text in _texts(folder, super().read(piece)):
            rows["path"].append(path)
            rows["raw"].append(text)
            size += len(text)
            if size >= BATCH:
                yield pa.RecordBatch.from_pydict(rows, schema)
                rows, size = {"path": [], "raw": []}, 0
        yield pa.RecordBatch.from_pydict(rows, schema)

    def row(self, piece: Piece, k: int, line: str) -> str:
        return line


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline-documents"

    def schema(self) -> str:
        return "path string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _DocumentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"path", "raw"} <= set(schema.fieldNames()):
            raise ValueError("documents are written from columns path and raw")
        return _DocumentWriter(self.options, overwrite)


# -- what a user calls
def register(spark: SparkSession) -> None:
    for source in (Manifests, Documents):
        spark.dataSource.register(source)


def save_manifest(entries: DataFrame, folder: str, parts: int | None = None) -> None:
    """Entries (url, json) in order of url and json, in sorted parts: as many as are asked for, or as adaptive execution finds their size to need."""
    register(entries.sparkSession)
    by = ["url", "json"] if parts is None else [parts, "url", "json"]
    rows = entries.select("url", "json").repartitionByRange(*by).sortWithinPartitions("url", "json")
    rows.write.format("plumbline-manifest").mode("overwrite").save(folder)


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(position, url, data VARIANT, error) of a saved manifest or of a single file."""
    register(spark)
    rows = spark.read.format("plumbline-manifest").load(folder)
    return rows.select("position", "url", F.try_parse_json("json").alias("data"), "error")


def save_documents(rows: DataFrame, folder: str) -> None:
    """One file a row (path, raw), committed together. Two rows of one name raise before anything is written."""
    register(rows.sparkSession)
    twice = rows.groupBy("path").count().where("count > 1").select("path").head(1)
    if twice:
        raise ValueError(f"two documents have the name {twice[0]['path']!r}")
    rows.select("path", "raw").write.format("plumbline-documents").mode("overwrite").save(folder)


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of saved documents."""
    register(spark)
    return spark.read.format("plumbline-documents").load(folder)
