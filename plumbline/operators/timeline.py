"""Ticks, labelled intervals and speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def locate(ticks: DataFrame, segments: DataFrame, width: float, tolerance: float = 1.0, key: str | None = None) -> DataFrame:
    """Each tick with the segment it falls in: the first listed one that holds it, both ends included, else the nearest within the tolerance.

    ticks: id, ts (and key); segments: idx, start, end (and key). Segments are
    spread over buckets of ``width``, so the join has an equality and no task
    sees more than a bucket; choose a width near the usual segment's length.
    """
    on = ["bucket"] if key is None else [key, "bucket"]
    low, high = F.floor((F.col("start") - tolerance) / width), F.floor((F.col("end") + tolerance) / width)
    spread = segments.withColumn("bucket", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    pairs = ticks.withColumn("bucket", F.floor(F.col("ts") / width).cast("long")).join(spread, on)
    far = F.greatest(F.col("start") - F.col("ts"), F.col("ts") - F.col("end"), F.lit(0.0))
    near = pairs.withColumn("dist", far).where(F.col("dist") <= tolerance)
    best = near.groupBy("id").agg(F.min(F.struct("dist", "idx")).alias("b")).select("id", F.col("b.idx").alias("idx"), F.col("b.dist").alias("dist"))
    return ticks.join(best, "id", "left")


def resolve_speakers(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Per speaker the dominant identity and how sure it is. segments: speaker, seg; matches: speaker, seg, identity, seq.

    Ties go to the identity met first. An identity that dominates two
    speakers lowers what would be sure.
    """
    n = segments.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_segments"))
    counts = matches.groupBy("speaker", "identity").agg(F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("seen"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("speaker").orderBy(F.desc("cnt"), "seen")))
    top = ranked.groupBy("speaker").agg(F.max(F.when(F.col("r") == 1, F.col("identity"))).alias("identity"), F.max(F.when(F.col("r") == 1, F.col("cnt"))).alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("cnt"))), F.lit(0)).alias("next"))
    out = n.join(top, "speaker", "left")
    level = (
        F.when(F.col("identity").isNull(), "none")
        .when((F.col("top") > F.col("next")) & (F.col("top") >= F.greatest(F.lit(1), F.floor(F.col("n_segments") / 2))), "high")
        .when(F.col("top") >= F.greatest(F.lit(1), F.floor(F.col("n_segments") / 3)), "medium")
        .otherwise("low")
    )
    shared = out.where("identity is not null").groupBy("identity").agg(F.count(F.lit(1)).alias("speakers"))
    out = out.withColumn("level", level).join(shared, "identity", "left")
    sure = F.when((F.col("level") == "high") & (F.col("speakers") > 1), "medium").otherwise(F.col("level"))
    return out.select("speaker", "identity", "n_segments", F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("next", F.lit(0)).alias("next"), sure.alias("confidence"))


def totals(segments: DataFrame) -> DataFrame:
    """Per speaker the number, the total seconds and the percentage of all. segments: speaker, seconds."""
    out = segments.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("seconds").alias("total_seconds"))
    everything = segments.agg(F.sum("seconds").alias("_all"))  # one row
    return out.join(F.broadcast(everything), F.lit(True)).select("speaker", "n_segments", "total_seconds", (F.col("total_seconds") / F.col("_all") * 100).alias("percent"))


#: Where in a recording anchor frames are taken.
ANCHORS = (0.05, 0.15, 0.25, 0.35, 0.50, 0.65, 0.80, 0.95)


def anchors(durations: DataFrame, key: str, seconds: str, fractions: tuple[float, ...] = ANCHORS) -> DataFrame:
    """(key, frac, ts): fractions of a duration, rounded half to even, short of its end."""
    each = F.explode(F.array(*[F.lit(f) for f in fractions])).alias("frac")
    out = durations.select(key, F.col(seconds).alias("_d"), each).withColumn("ts", F.bround(F.col("_d") * F.col("frac")))
    return out.where("ts < _d").drop("_d")


def sweep(durations: DataFrame, key: str, seconds: str, start: float, end: float, every: float, span: float) -> DataFrame:
    """(key, ts): start, start + every, ... up to end, as long as a span still fits."""
    n = int((end - start) // every)
    ts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(start) + k * F.lit(every))).alias("ts")
    return durations.select(key, F.col(seconds).alias("_d"), ts).where(F.col("ts") + span <= F.col("_d")).drop("_d")


def burst(ts, span: float):
    """The start of a window centred on a time, not before nought."""
    return F.greatest(F.lit(0.0), ts - span / 2)


def bursts(stamps: DataFrame, ts: str, span: float, duration: str) -> DataFrame:
    """The times whose span ends before the recording does, with ``start``, where their window starts."""
    return stamps.where(F.col(ts) + span < F.col(duration)).withColumn("start", burst(F.col(ts), span))


def stitched(lines: DataFrame) -> DataFrame:
    """(path, body): caption lines with the speaker named where it changes. lines: path, line, ts_display, text, speaker (null outside all segments), identity."""
    label = F.when(F.col("speaker").isNull(), "_unanalyzed_").otherwise(F.coalesce("identity", "speaker"))
    shown = F.when(F.col("speaker").isNull(), "_(unanalyzed)_").when(F.col("identity").isNotNull(), F.concat(F.lit("**"), "identity", F.lit(":**"))).otherwise(F.concat(F.lit("_("), "speaker", F.lit(")_")))
    before = W.partitionBy("path").orderBy("line")
    rows = lines.withColumn("_label", label).withColumn("_last", F.lag("_label").over(before))
    line = F.concat(F.lit("["), "ts_display", F.lit("] "), F.when(F.col("_label").eqNullSafe(F.col("_last")), "").otherwise(F.concat(shown, F.lit(" "))), "text")
    return rows.groupBy("path").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n")).alias("body"))
