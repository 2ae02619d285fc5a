"""Which passages occur verbatim in which texts, and what of a text no passage covers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written

#: Most rows of a stated set that are broadcast at once.
BLOCK = 10_000


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out evenly; larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def blocks(rows: DataFrame, key: str, size: int = BLOCK) -> Iterator[DataFrame]:
    """A stated set in parts of about ``size`` rows, each to be broadcast by itself; none for an empty set."""
    n = math.ceil(rows.count() / size)
    for k in range(n):
        yield F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))


def containment(texts: DataFrame, passages: DataFrame, text_key: str = "doc_id", passage_key: str = "item_id") -> DataFrame:
    """(text key, passage key) of normalized passages that stand inside normalized texts. Both tables: key, norm.

    A passage of three words or more can only occur where its rarest inner
    word does (its outer words may be parts of longer ones), so texts and
    passages meet on that word and the substring test confirms. Shorter
    passages, the empty one included, are compared with all texts. Passages
    are few next to texts: they are broadcast, a block at a time, so a pass
    over the texts counts the words asked for and another meets them, and
    no word of a text is stored or shuffled.
    """
    words = F.split("norm", " ")
    inner = passages.where(F.size(words) >= 3).select(passage_key, "norm", F.explode(F.array_distinct(F.slice(words, F.lit(2), F.size(words) - 2))).alias("word"))
    each = texts.select(text_key, "norm", F.explode(F.array_distinct(words)).alias("word"))
    rarity = each.select("word").join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    counted = inner.join(rarity, "word", "left").groupBy(passage_key, F.col("norm").alias("passage")).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("best"))
    keys = written(counted.where("best.df > 0").select(passage_key, "passage", F.col("best.word").alias("word")), "keys")
    short = passages.where(F.size(words) < 3).select(passage_key, F.col("norm").alias("passage"))
    found = [each.join(part, "word").where(F.instr(F.col("norm"), F.col("passage")) > 0).select(text_key, passage_key) for part in blocks(keys, passage_key)]
    found += [texts.join(part, F.expr("instr(norm, passage) > 0 or passage = ''")).select(text_key, passage_key) for part in blocks(short, passage_key)]
    return reduce(DataFrame.union, found) if found else texts.join(short, F.lit(False)).select(text_key, passage_key)


#: Length of the starts by which short texts are looked up in long ones.
START = 16


def within(shorts: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct norms of ``shorts`` that stand inside some norm of ``texts``, of which there are fewer: they meet on the first START characters of the one, at any place of
    the other; forms below that length are compared with all texts."""
    at = F.sequence(F.lit(1), F.length("text") - (START - 1))
    text = texts.select(F.col("norm").alias("text")).distinct()
    starts = text.where(F.length("text") >= START).select("text", F.explode(F.array_distinct(F.transform(at, lambda i: F.col("text").substr(i, F.lit(START))))).alias("start"))
    long = shorts.where(F.length("norm") >= START).withColumn("start", F.substring("norm", 1, START))
    # lines that begin like nothing in the texts are out before they are shuffled
    long = long.join(starts.select(F.col("start").alias("s")).distinct(), F.col("start") == F.col("s"), "left_semi").distinct()
    out = long.join(starts, "start").where(F.instr(F.col("text"), F.col("norm")) > 0).select("norm").distinct()
    few = shorts.where(F.length("norm") < START).select("norm").distinct()
    for part in blocks(text, "text"):
        out = out.union(few.join(part, F.expr("instr(text, norm) > 0 or norm = ''"), "left_semi"))
    return out.distinct()


def inside_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """The tokens (form, without spaces) that stand inside some word. Both meet on the token's first three letters, or on all of a shorter one."""
    out = None
    for k in (1, 2, 3):
        asked = tokens.where(F.length("form") == k if k < 3 else F.length("form") >= 3).withColumn("g", F.substring("form", 1, k))
        starts = F.sequence(F.lit(1), F.length("word") - (k - 1))
        grams = words.where(F.length("word") >= k).select("word", F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("word").substr(i, F.lit(k))))).alias("g"))
        grams = grams.join(asked.select("g").distinct(), "g", "left_semi")
        hit = grams.join(asked, "g").where(F.instr(F.col("word"), F.col("form")) > 0).select("form").distinct()
        out = hit if out is None else out.union(hit)
    return out


def uncovered(parts: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs that neither hold a quote of their source nor stand in one. parts: keys, idx, norm; quotes: keys, norm."""
    q = quotes.select(*keys, F.col("norm").alias("quote"))
    touches = F.expr("instr(norm, quote) > 0 or instr(quote, norm) > 0")
    return parts.join(q, [*(parts[k] == q[k] for k in keys), touches], "left_anti")


def drift(prose: DataFrame, pool: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_tokens, n_unmatched, level): tokens of prose that the pool lacks; a warning if any, an error if all. prose: key, tokens; pool: token."""
    each = prose.select(*key, F.explode("tokens").alias("token"))
    flagged = each.join(pool.select("token", F.lit(1).alias("known")).distinct(), "token", "left")
    out = flagged.groupBy(*key).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("known").isNull()).alias("n_unmatched"))
    return out.where("n_unmatched > 0").withColumn("level", F.when(F.col("n_unmatched") == F.col("n_tokens"), "error").otherwise("warn"))


def description_tokens(text: Column) -> Column:
    """Designators, numbers, capital words and quoted strings of a description, sorted and distinct."""
    designator, number = r"\b[A-Z][A-Z0-9]*[-/][A-Z0-9/-]*[A-Z0-9]\b", r"\b\d[\d,.]*\+?\b"
    bare = F.regexp_replace(text, r"\s*\(\s*\[`/[^`]+`\]\s*\)|\[`/[^`]+`\]", "")
    rest = F.regexp_replace(F.regexp_replace(bare, designator, " "), number, " ")
    parts = [F.regexp_extract_all(bare, F.lit(designator), F.lit(0)), F.regexp_extract_all(bare, F.lit(number), F.lit(0)), F.regexp_extract_all(rest, F.lit(r"\b[A-Z][A-Za-z0-9-]*\b"), F.lit(0)), F.regexp_extract_all(bare, F.lit(r'"([^"]+)"'), F.lit(1))]
    return F.array_sort(F.array_distinct(F.concat(*parts)))
