"""Tables written to the folder that all executors share, and row ids over stable scans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the context's own; a temporary one only where neither is set in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """Fewer rows and bytes to an Arrow batch while a table is written, as texts may be long; the session's settings come back after."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The dataframe written as Parquet to the shared folder and read again.

    This cuts the lineage, survives the loss of any executor, and lets later
    reads prune columns.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_UNSTABLE = re.compile(r"\b(Join|Aggregate|Sort|Repartition\w*|LocalRelation|LocalTableScan|Window|Union|Sample|Distinct|Deduplicate|LogicalRDD|Map\w+|Generate|Limit|GlobalLimit)\b")


def with_row_ids(docs: DataFrame, column: str) -> DataFrame:
    """The rows with a unique number that every later use of the result finds the same.

    Numbers follow the scan, so anything but a plain scan is written first.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if _UNSTABLE.search(plan):
        docs = materialize(docs, "rows")
    return docs.withColumn(column, F.monotonically_increasing_id())


def input_bytes(df: DataFrame) -> int:
    """What Spark reckons the dataframe's size to be, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
