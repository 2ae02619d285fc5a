"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, in code-point order with the null source last, weigh 3, 1, 2 in
turn. They share 150 % of all words; a target stops at twice its source, the
excess going to the others by weight. Each source is dealt into blocks by a
hash of its documents. Whole passes over a source take every block; the rest
of the target takes blocks in a permuted order, and in the one block that
straddles it documents in a permuted order, the last of them in part, so that
every source meets its target to a word.

The drawn blocks of all sources are dealt to the output shards by a splitting
tree: at each node the exact block counts of the sources are split between
the two halves of its shards by one multivariate-hypergeometric draw, source
after source from a uniform number that hashes seed, node and source. A shard
then takes the next blocks of each source's permuted order, disjoint by
construction, and orders its documents by a hash.

Defined results: a null text has no words and is never drawn; documents
without an id are drawn like others; repeated rows are drawn each by itself;
an empty table gives no rows; further columns of any name pass through ``mix``, where a
row number ties each row to its own draws; its own three columns replace such of their names. All draws depend on the data and the seed alone, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize, with_row_ids

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1 << 16
BLOCKS = 4096
SHARDS = 32
SEED = 17


_CARRIED = ["row", "doc_id", "source", "digest", "nameless"]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch.column("text")):
            counts = K.find_words(data, offsets, K.SPACED).counts
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in _CARRIED), pa.array(counts, pa.int64())], [*_CARRIED, "size"])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target. One row per source; the water level is found from running sums."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long"))
    by = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    src = src.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(rest))
    src = src.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("level"))).over(everything))
    target = F.least((F.col("source_size") * most).cast("double"), F.col("water") * F.col("weight"))
    return src.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, F.coalesce(target, F.lit(0.0))).otherwise(0.0).alias("target"))


_LOG_FACTORIAL = np.vectorize(lambda n: math.lgamma(n + 1), otypes=[float])


def hypergeometric(u: float, marked: int, total: int, take: int) -> int:
    """How many marked ones are among ``take`` drawn of ``total``: the quantile of u."""
    low, high = max(0, take - (total - marked)), min(marked, take)
    if low >= high:
        return low
    k = np.arange(low, high + 1)
    f = _LOG_FACTORIAL
    p = np.exp(f(marked) - f(k) - f(marked - k) + f(total - marked) - f(take - k) - f(total - marked - take + k) - (f(total) - f(take) - f(total - take)))
    return min(high, low + int((np.cumsum(p) <= u).sum()))


def uniform(seed: int, lo: int, hi: int, source: str) -> float:
    """The uniform number of a source at the node of shards lo to hi."""
    return (int(hashlib.md5(f"{seed}:{lo}:{hi}:{source}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def split_tree(counts: list[int], sources: list[str], shards: int, seed: int) -> np.ndarray:
    """Exact block counts of each source for each shard (shards x sources)."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, [int(c) for c in counts])]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total, left = (lo + hi) // 2, sum(have), []
        take = total * (mid - lo) // (hi - lo)
        for n, source in zip(have, sources):
            left.append(hypergeometric(uniform(seed, lo, hi, source), n, total, take))
            total, take = total - n, take - left[-1]
        todo += [(lo, mid, left), (mid, hi, [n - k for n, k in zip(have, left)])]
    return out


def _quotas(pdf: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    names = [None if pd.isna(s) else s for s in pdf["source"]]
    order = sorted(range(len(names)), key=lambda k: (names[k] is None, (names[k] or "").encode()))
    names = [names[k] for k in order]
    counts = pdf["n_draws"].to_numpy()[order]
    ends = np.cumsum(split_tree(counts, ["" if x is None else f"s{x}" for x in names], shards, seed), axis=0)
    starts = np.vstack([np.zeros((1, ends.shape[1]), np.int64), ends[:-1]])
    k, s = np.nonzero(ends > starts)
    return pd.DataFrame({"source": [names[x] for x in s], "shard": k.astype(np.int32), "from_draw": starts[k, s], "to_draw": ends[k, s]})


def draws(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: size, source_size, target, taken, and ``drawn``, an array of (pass, shard, words)."""
    return _draws(docs.select("doc_id", "source", "text", F.lit(0).cast("long").alias("row")), shards, seed).drop("row")


def _draws(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """The draws with the ``row`` of each document.

    Only ids, sources, sizes and digests are shuffled. The block keys spread a source
    that holds any part of the rows over up to ``BLOCKS`` groups. Where a target cuts a
    block, rows alike in key, size and id stand in the order of their texts' digests.
    """
    text = F.col("text").cast("string")
    sized = docs.select("row", F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("digest"), F.when(F.col("doc_id").isNull(), F.concat(F.lit("n"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).alias("nameless"), text.alias("text")).mapInArrow(_sizes, "row long, doc_id long, source string, digest long, nameless string, size long")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.col("nameless")), F.lit(str(seed))).cast("binary"))
    sized = materialize(sized.withColumn("key", key).drop("nameless"), "sizes")
    src = targets(sized)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    src = src.withColumn("passes", full).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    src = materialize(src.withColumn("n_blocks", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long")), "sources")
    rows = sized.join(src, sized["source"].eqNullSafe(src["source"])).select("row", "doc_id", sized["source"], "digest", "size", "key", "source_size", "target", "passes", "rest", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("n_blocks")).alias("block"))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    blocks = rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("source").alias("source"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    order = W.partitionBy("src").orderBy(F.md5(F.concat_ws(":", "src", F.col("block").cast("string"), F.lit(str(seed))).cast("binary")), "block")
    blocks = blocks.withColumn("cum", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    left = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("cum") + F.col("words")))
    blocks = blocks.withColumn("part", left)
    taken = F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("passes"))).otherwise(F.array().cast("array<long>")), F.when(F.col("part") > 0, F.array(F.col("passes") + 1)).otherwise(F.array().cast("array<long>")))
    each = blocks.select("src", "source", "block", "words", "part", "place", "passes", F.explode(taken).alias("pass"))
    each = materialize(each.withColumn("draw", F.row_number().over(W.partitionBy("src").orderBy("pass", "place")).cast("long") - 1), "draws")
    quotas = each.groupBy("source").agg(F.count(F.lit(1)).alias("n_draws")).groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: _quotas(pdf, shards, seed), "source string, shard int, from_draw long, to_draw long")
    dealt = each.join(quotas, each["source"].eqNullSafe(quotas["source"]) & (F.col("draw") >= F.col("from_draw")) & (F.col("draw") < F.col("to_draw"))).drop(quotas["source"])
    dealt = dealt.groupBy("src", "block").agg(F.max("words").alias("block_words"), F.max("part").alias("part"), F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    rows = rows.join(dealt, ["src", "block"], "left")
    straddles = (F.col("part") > 0) & (F.col("part") < F.col("block_words"))
    cut = rows.where(straddles)
    inside = W.partitionBy("src", "block").orderBy("key", "size", "doc_id", "digest", "row").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("in_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    whole = rows.where(~F.coalesce(straddles, F.lit(False))).withColumn("in_part", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    rows = cut.unionByName(whole)
    words = F.transform(F.coalesce(F.col("dealt"), F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("in_part")).alias("words")))
    return rows.select("row", "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("in_part")).alias("taken"), F.filter(words, lambda d: d["words"] > 0).alias("drawn"), "key")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each draw of a document: its columns, with ``mix_shard``, ``mix_pass`` and ``mix_words``.

    The text of the at most one document per source that a target cuts is the
    words taken of it, joined by spaces. Shards are written by one task group each, in a
    locally shuffled order.
    """
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]
    doc_id, source, text = (F.col(own[names.index(c)]) for c in ("doc_id", "source", "text"))
    docs = with_row_ids(docs.toDF(*own), "_row")
    drawn = _draws(docs.select(doc_id.alias("doc_id"), source.alias("source"), text.alias("text"), F.col("_row").alias("row")), shards, seed)
    taken = drawn.where(F.size("drawn") > 0).select("row", F.col("size").alias("_size"), F.col("key").alias("_key"), F.explode("drawn").alias("_d"))
    rows = docs.join(taken, docs["_row"] == taken["row"])
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_d.words").cast("int")), " ")
    cols = [F.when(F.col("_d.words") < F.col("_size"), short).otherwise(text).alias(c) if n == "text" else F.col(c) for c, n in zip(own, names)]
    rows = rows.select(*cols, "_row", F.col("_d.shard").alias("mix_shard"), F.col("_d.pass").alias("mix_pass"), F.col("_d.words").alias("mix_words"), F.md5(F.concat_ws(":", "_key", F.col("_d.pass").cast("string")).cast("binary")).alias("_order"))
    salt = F.pmod(F.xxhash64("_order", "_row"), F.lit(8))
    rows = rows.repartition(F.col("mix_shard"), salt).sortWithinPartitions("mix_shard", "_order", "_row")
    added = ["mix_shard", "mix_pass", "mix_words"]
    return rows.select(*[F.col(c).alias(n) for c, n in zip(own, names) if n not in added], *added)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draws(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("drawn", lambda d: d["shard"].cast("string")), ",").alias("shards"))


OP2_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, ''))) || ':17') AS key FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM s0
), s2 AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
    / (sum(weight) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM s1
), s3 AS (SELECT *, max(CASE WHEN lev * weight <= source_size * 2 THEN lev END) OVER () AS water FROM s2
), s4 AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN coalesce(least((source_size * 2)::DOUBLE, water * weight), 0.0) ELSE 0.0 END AS target FROM s3
), src AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
         least(4096, greatest(1, ceil(source_size / 65536)))::BIGINT AS n_blocks FROM s4
), rows_ AS (
  SELECT doc_id, size, key, d.source, source_size, target, passes, round(target - passes * source_size)::BIGINT AS rest,
         coalesce('s' || d.source, '') AS sk, ('0x' || substr(key, 1, 8))::BIGINT % n_blocks AS block
  FROM sized d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), blocks AS (
  SELECT sk, block, sum(size)::BIGINT AS words, any_value(rest) AS rest, any_value(passes) AS passes, md5(sk || ':' || block || ':17') AS o FROM rows_ GROUP BY sk, block
), cums AS (SELECT *, sum(words) OVER (PARTITION BY sk ORDER BY o, block ROWS UNBOUNDED PRECEDING)::BIGINT AS cum, row_number() OVER (PARTITION BY sk ORDER BY o, block) AS place FROM blocks
), parts AS (SELECT sk, block, passes, words, place, greatest(0, least(words, rest - cum + words)) AS part FROM cums
), each AS (
  SELECT sk, block, pass, row_number() OVER (PARTITION BY sk ORDER BY pass, place) - 1 AS draw
  FROM (SELECT sk, block, place, unnest(generate_series(1, passes + (part > 0)::BIGINT)) AS pass FROM parts)
), named AS (SELECT sk, count(*)::BIGINT AS n FROM each GROUP BY sk
), top AS (SELECT list(n ORDER BY sk = '', encode(sk)) AS have, list(sk ORDER BY sk = '', encode(sk)) AS sks FROM named
), tree AS (
  SELECT 0::BIGINT AS lo, 32::BIGINT AS hi, have, 1::BIGINT AS s, []::BIGINT[] AS lefts, list_sum(have)::BIGINT AS total, list_sum(have)::BIGINT // 2 AS take, sks FROM top
  UNION ALL
  SELECT CASE WHEN s > len(have) AND c = 1 THEN mid ELSE lo END, CASE WHEN s > len(have) AND c = 0 THEN mid ELSE hi END,
         CASE WHEN s <= len(have) THEN have ELSE new END, CASE WHEN s <= len(have) THEN s + 1 ELSE 1 END,
         CASE WHEN s <= len(have) THEN list_append(lefts, k) ELSE [] END,
         CASE WHEN s <= len(have) THEN total - m ELSE list_sum(new)::BIGINT END, CASE WHEN s <= len(have) THEN take - k ELSE list_sum(new)::BIGINT // 2 END, sks
  FROM (
    SELECT *, CASE WHEN kmin >= kmax THEN kmin ELSE least(kmax, kmin + len(list_filter(range(1, kmax - kmin + 2), lambda i: list_sum(prob[1:i]) <= u))) END AS k FROM (
      SELECT *, list_transform(range(kmin, kmax + 1), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(total - m + 1) - lgamma(take - j + 1) - lgamma(total - m - take + j + 1)
          - (lgamma(total + 1) - lgamma(take + 1) - lgamma(total - take + 1)))) AS prob FROM (
        SELECT *, greatest(0, take - (total - m)) AS kmin, least(m, take) AS kmax FROM (
          SELECT tree.*, c, (lo + hi) // 2 AS mid, coalesce(have[s], 0) AS m, (('0x' || substr(md5('17:' || lo || ':' || hi || ':' || coalesce(sks[s], '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u,
                 CASE WHEN c = 0 THEN lefts ELSE list_transform(range(1, len(have) + 1), lambda i: have[i] - coalesce(lefts[i], 0)) END AS new
          FROM tree, (VALUES (0), (1)) v(c) WHERE hi - lo > 1 AND (s > len(have) OR c = 0)))))
), leaves AS (SELECT lo AS shard, unnest(have) AS n, unnest(sks) AS sk FROM tree WHERE hi - lo = 1
), quotas AS (SELECT sk, shard, n, sum(n) OVER (PARTITION BY sk ORDER BY shard ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM leaves
), dealt AS (SELECT each.sk, block, list(struct_pack(pass := pass, shard := shard) ORDER BY pass) AS d FROM each JOIN quotas q ON q.sk = each.sk AND draw >= upto - n AND draw < upto GROUP BY ALL
), taken AS (
  SELECT rows_.*, greatest(0, least(size, part - coalesce(sum(size) OVER (PARTITION BY sk, block ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS in_part, d
  FROM rows_ JOIN parts USING (sk, block) LEFT JOIN dealt USING (sk, block)
)
SELECT doc_id, size, source_size, target, (passes * size + in_part)::BIGINT AS taken,
       coalesce(array_to_string(list_transform(list_filter(d, lambda x: CASE WHEN x.pass <= passes THEN size ELSE in_part END > 0), lambda x: x.shard), ','), '') AS shards
FROM taken
"""
