"""The uniform issue table, the check registry, the fatal cut and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("check_name", T.StringType()), T.StructField("fatal", T.BooleanType()), T.StructField("tokens", T.ArrayType(T.StringType())),
])


def issues(rows: DataFrame, path: Column, message: Column, check: str | Column, level: str | Column = "error", fatal: bool | Column = False, tokens: Column | None = None) -> DataFrame:
    """One issue for each row; F.lit takes a column of levels, of checks or of what is fatal as it is."""
    return rows.select(
        path.cast("string").alias("path"), F.lit(level).alias("level"), message.alias("message"), F.lit(check).alias("check_name"), F.lit(fatal).alias("fatal"),
        (F.array().cast("array<string>") if tokens is None else tokens).alias("tokens"),
    )


def each_told(found: list[Column]) -> Column:
    """A row for each message; rows of null are to be left out by the caller.

    What explode takes is asked for its size before, and so evaluated two more times, unless it is an array literal or explode_outer takes it.
    """
    return F.explode(F.array(*found, F.lit(None).cast("string")))


@dataclass(frozen=True)
class Check:
    """An entry of the ordered registry; fn maps the named tables to an issue table."""

    name: str
    order: int
    fn: Callable[[dict[str, DataFrame]], DataFrame]


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """All issues with their check's order, without those that stand after the first fatal one of their path."""
    parts = [_guarded(c, tables).select(*ISSUE.names, F.lit(c.order).alias("ord")) for c in sorted(checks, key=lambda c: c.order)]
    return fatal_cut(reduce(DataFrame.unionByName, parts))


def _guarded(check: Check, tables: dict[str, DataFrame]) -> DataFrame:
    """A check that can't be planned over the tables, as for a missing column or a faulty schema, is a fatal issue of every path of the first one."""
    try:
        return check.fn(tables).select(*ISSUE.names)
    except Exception as e:
        message = F.lit(f"check crashed: {type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
        return issues(next(iter(tables.values())), F.col("path"), message, check.name, fatal=True)


def fatal_cut(found: DataFrame) -> DataFrame:
    """Fatal rows are few, so their minimum per path is joined back; nothing is windowed over a path's issues."""
    first = found.where("fatal").groupBy("path").agg(F.min("ord").alias("last"))
    return found.join(first, "path", "left").where("last is null or ord <= last").drop("last")


def report(found: DataFrame) -> DataFrame:
    """Counts by check and level."""
    return found.groupBy("check_name", "level").agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("path").alias("n_paths"), F.sum(F.col("fatal").cast("int")).cast("long").alias("n_fatal"))
