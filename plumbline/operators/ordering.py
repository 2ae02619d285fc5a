"""Order of rows: chronology, natural sorts, runs, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_out_of_order(rows: DataFrame, group: list[str], position: str, value: str) -> DataFrame:
    """Per group the first row whose value lies before that of the nearest earlier row with a value."""
    w = W.partitionBy(*group).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    bad = rows.withColumn("previous", F.last(value, True).over(w)).where(F.col(value) < F.col("previous"))
    return bad.groupBy(*group).agg(F.min(F.struct(position, "previous", value)).alias("_f")).select(*group, f"_f.{position}", "_f.previous", f"_f.{value}")


def run_counts(rows: DataFrame, group: list[str], position: str, member: Column) -> DataFrame:
    """Per group the number of runs of neighbouring member rows."""
    w = W.partitionBy(*group).orderBy(position)
    starts = member & ~F.coalesce(F.lag(member).over(w), F.lit(False))
    return rows.withColumn("_s", starts).groupBy(*group).agg(F.count_if("_s").alias("n_runs"))


def label_changes(rows: DataFrame, group: list[str], position: str, label: str) -> DataFrame:
    """The rows with ``shown``: the label where it changes, the first row included, else null."""
    w = W.partitionBy(*group).orderBy(position)
    new = (F.row_number().over(w) == 1) | ~F.lag(label).over(w).eqNullSafe(F.col(label))
    return rows.withColumn("shown", F.when(new, F.col(label)))


def every_nth(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where((F.col("_r") - 1) % n == 0).drop("_r")


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def over_budget(rows: DataFrame, text: Column, most: int) -> DataFrame:
    """Rows whose text has more words than the budget, with their number."""
    return rows.withColumn("n_words", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")).where(F.col("n_words") > most)
