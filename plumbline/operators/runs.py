"""Runs that survive faulty documents, gated stages, and re-runs on what has changed.

Guarded checks: a check of single documents is a Python function over the parsed
document; it runs in one pass of batches, and a document on which it raises gets
one fatal issue while all others get theirs (``document_issues``). A check over
tables (``issues.Check``) that raises while it runs is helped by ``surviving``: the
documents that make it raise are found by splitting them again and again, get a fatal issue, and the
check runs once more over all the others.

Stages: each takes the documents that are left and gives their new rows and
issues; a fatal issue takes its document, not the run, out of all later stages.

Re-runs: the digests of the last run and the links between documents give the
documents that a change touches; only these are checked again, and their issues
replace the stored ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, written
from .issues import ISSUE, Check, fatal_cut, issues

ORDERED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ISSUE.fields) + ", ord int"


# -- one document at a time
@dataclass(frozen=True)
class DocumentCheck:
    """A check of a parsed document: fn gives (level, message), or (level, message, True) for a fatal one."""

    name: str
    order: int
    fn: Callable[[dict], Iterable[tuple]]


def _crash(e: BaseException) -> str:
    first = str(e).splitlines()[0][:200] if str(e) else ""
    return f"check crashed: {type(e).__name__}: {first}"


def _judged(path: str, text: str | None, checks: list[DocumentCheck]) -> Iterator[tuple]:
    try:
        document = None if text is None else json.loads(text)
    except ValueError as e:
        yield path, "error", _crash(e), "document_parse", True, [], -1
        return
    for c in checks:
        found = []
        try:
            for level, message, *fatal in c.fn(document):
                found.append((path, level, message, c.name, bool(fatal and fatal[0]), [], c.order))
        except Exception as e:
            found = [(path, "error", _crash(e), c.name, True, [], c.order)]
        yield from found
        if any(f[4] for f in found):  # what stands after a fatal issue is not asked
            return


def document_issues(documents: DataFrame, checks: list[DocumentCheck]) -> DataFrame:
    """The issues of every document, up to its first fatal one, in one narrow pass. documents: path, json."""
    ordered = sorted(checks, key=lambda c: c.order)
    names = [x.split()[0] for x in ORDERED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, text in zip(frame["path"], frame["json"]) for row in _judged(path, text, ordered)]
            yield pd.DataFrame(rows, columns=names)

    return documents.select(F.col("path").cast("string"), F.col("json").cast("string")).mapInPandas(run, ORDERED)


# -- checks over tables
#: Into how many parts a faulty set of documents is split at once.
FAN = 8


def _fails(check: Check, tables: dict[str, DataFrame]) -> str | None:
    """What a check raises when it runs over the tables."""
    try:
        check.fn(tables).select(*ISSUE.names).write.format("noop").mode("overwrite").save()
    except PySparkException as e:
        return _reason(e)
    return None


def _reason(e: BaseException) -> str:
    """The error class where Spark gives one, else the first line."""
    name = e.getCondition() if isinstance(e, PySparkException) else None
    return f"check crashed: {name or _crash(e).removeprefix('check crashed: ')}"


def faulty(check: Check, tables: dict[str, DataFrame], key: str = "path") -> list[tuple[str, str]]:
    """(path, what was raised) of the documents of the first table on which a check raises.

    Documents are split by a hash of their paths, and only parts that raise are split again, those of a level all at once: one write a level,
    and a job for each part, of which many run at a time. A part of one path is that path. About FAN times the depth jobs for each faulty
    document; faults are meant to be rare, and the number of paths that come to the driver is theirs.
    """
    first = next(iter(tables))
    spark, schema = tables[first].sparkSession, tables[first].schema
    left = tables[first].withColumn("_part", F.lit("p"))
    found: list[tuple[str, str]] = []
    level = 0
    with ThreadPoolExecutor(2 * spark.sparkContext.defaultParallelism) as pool:
        while True:
            # stored in a folder each: a filter in the plan might come after those of the check
            folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
            digit = F.pmod(F.xxhash64(F.lit(level), key), F.lit(FAN)).cast("string")
            left.withColumn("_part", F.concat("_part", F.lit("."), digit)).hint("rebalance", "_part").write.partitionBy("_part").parquet(folder)
            stored = spark.read.schema(left.schema).parquet(folder)
            # one row for each part: at most FAN for each faulty document
            held = stored.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
            read = lambda k: tables | {first: spark.read.schema(schema).parquet(f"{folder}/_part={k}")}  # noqa: B023, E731
            raised = list(pool.map(inheritable_thread_target(spark)(lambda r: _fails(check, read(r["_part"]))), held))  # noqa: B023
            bad = [(r, reason) for r, reason in zip(held, raised) if reason is not None]
            found += [(r["low"], reason) for r, reason in bad if r["low"] == r["high"]]
            again = [(r["_part"],) for r, _ in bad if r["low"] != r["high"]]
            if not again:
                return found
            left = stored.join(F.broadcast(spark.createDataFrame(again, "_part string")), "_part", "left_semi").select(*left.columns)
            level += 1


def surviving(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """All issues up to each path's first fatal one, of checks of which some may raise while they run over some documents of the first table.

    Every check's issues are stored; one that raises costs the search for its faulty documents and a second run without them.
    """
    first = next(iter(tables))
    spark = tables[first].sparkSession
    parts: list[DataFrame] = []
    for c in sorted(checks, key=lambda c: c.order):
        run = lambda t: written(c.fn(t).select(*ISSUE.names, F.lit(c.order).alias("ord")), "issues")  # noqa: B023, E731
        crashed = lambda rows, reason: parts.append(issues(rows, F.col("path"), reason, c.name, fatal=True).withColumn("ord", F.lit(c.order)))  # noqa: B023, E731
        try:
            parts.append(run(tables))
            continue
        except PySparkException as e:
            reason = F.lit(_reason(e))
        # what raises over no documents at all is not the fault of one
        lost = [] if _fails(c, tables | {first: tables[first].limit(0)}) else faulty(c, tables)
        rest = tables[first]
        if lost:
            gone = spark.createDataFrame(lost, "path string, reason string")
            crashed(gone, F.col("reason"))
            rest = written(rest.join(gone, "path", "left_anti"), "sound")
        try:
            if lost:
                parts.append(run(tables | {first: rest}))
            else:
                crashed(rest.select("path").distinct(), reason)
        except PySparkException:  # it raises over documents that do not raise by themselves
            crashed(rest.select("path").distinct(), reason)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return fatal_cut(out)


# -- stages
@dataclass(frozen=True)
class Stage:
    """fn maps the documents left to (their rows after the stage, the stage's issues); both have a column path."""

    name: str
    fn: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def run_stages(documents: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """(documents that passed every stage, issues with the stage they are of). Each stage's results are stored, so a lost executor costs no more than its tasks."""
    ledger: DataFrame | None = None
    for s in stages:
        after, found = s.fn(documents)
        found = written(found.select(*ISSUE.names, F.lit(s.name).alias("stage")), "issues")
        ledger = found if ledger is None else ledger.unionByName(found)
        documents = written(after.join(found.where("fatal").select("path").distinct(), "path", "left_anti"), "stage")
    return documents, ledger


# -- re-runs
@dataclass(frozen=True)
class State:
    """What a run leaves: digests (path, digest), edges (src, dst: src's checks look at dst), issues (path, ...)."""

    digests: DataFrame
    edges: DataFrame
    issues: DataFrame


def digests(documents: DataFrame, columns: list[str]) -> DataFrame:
    """(path, digest) over all the columns that a check may look at."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return documents.select("path", F.sha2(F.concat(*map(part, columns)), 256).alias("digest"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of documents that are new, gone or other than before."""
    both = before.select("path", F.col("digest").alias("was")).join(now.select("path", F.col("digest").alias("is")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def affected(changed: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(path) of the changed documents and of those that look at one, over up to ``depth`` links.

    A check of a document looks at the documents it names (depth 1); where checks look at what those name in turn, depth is larger. It ends early when nothing new is met.
    """
    out = written(changed.select("path").distinct(), "affected")
    reached = out
    for _ in range(depth):
        more = edges.join(reached, edges["dst"] == reached["path"]).select(F.col("src").alias("path")).distinct().join(out, "path", "left_anti")
        reached = written(more, "affected")
        if not reached.head(1):
            break
        out = out.unionByName(reached)
    return out


def rerun(state: State, documents: DataFrame, columns: list[str], links: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], depth: int = 1) -> tuple[State, DataFrame]:
    """The state after a run that checks only what a change touches, and the paths it checked.

    links gives the edges (src, dst) of documents; check gives the issues of the documents it is handed, and may read all others. The edges of before and
    after count both, as a document that has stopped naming another is changed itself. The merged issues equal those of a full run.
    """
    now = written(digests(documents, columns), "digests")
    changed = written(changes(state.digests, now), "changes")
    edges = written(state.edges.join(changed, state.edges["src"] == changed["path"], "left_anti").select("src", "dst").unionByName(links(documents.join(changed, "path", "left_semi")).select("src", "dst")), "edges")
    touched = affected(changed, edges, depth)
    fresh = check(documents.join(touched, "path", "left_semi"))
    merged = written(state.issues.join(touched, "path", "left_anti").unionByName(fresh.select(*state.issues.columns)), "issues")
    return State(now, edges, merged), touched


def first_run(documents: DataFrame, columns: list[str], links: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]) -> State:
    return State(written(digests(documents, columns), "digests"), written(links(documents).select("src", "dst"), "edges"), written(check(documents), "issues"))
