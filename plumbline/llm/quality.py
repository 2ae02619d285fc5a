"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and keeps the failure
bits beside the measurements they came from. Policies are versioned sets of
rules; applying one, or finding what each rule alone decides, needs only
bitwise work on the ledger and never reads the texts again.

Defined results: a null or empty text has no words and fails ``few_words``;
ties and repeated rows are judged row by row; an empty table gives an empty
ledger; columns other than doc_id and text are not looked at by the ledger
and pass through ``keep_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Fixed order of the rules; a rule's bit never changes once ledgers are stored.
RULES = ("few_words", "repeated_words", "symbols", "shouting", "stutter", "repeated_lines", "word_length")
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "stutter"),
    "strict": RULES,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_stutter", "n_lines")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_WINDOW = 8


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[number] > 1


def _window_classes(word: np.ndarray) -> np.ndarray:
    """A number for each run of eight neighbouring words, equal for equal runs alone: pairs of words, of pairs and of fours are numbered in turn."""
    for step in (1, 2, 4):
        pair = word[:-step] * (int(word.max(initial=0)) + 1) + word[step:]
        word = np.unique(pair, return_inverse=True)[1]
    return word


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text of a slice."""
    n_texts = len(offsets) - 1
    words = K.find_words(data, offsets, K.SPACED)
    rows = words.rows()
    word = K.classes(data, words.starts, words.ends)
    salt = K.mix64(np.arange(1, n_texts + 1, dtype=np.uint64))
    out = {"n_words": words.counts}
    inside = K.SPACED[data]
    out["word_chars"] = K.sums(inside & _HEAD[data], offsets)
    out["n_symbols"] = K.sums(_SYMBOL[data], offsets)
    out["n_upper"] = K.sums(_UPPER[data], offsets)
    out["n_letters"] = K.sums(_LETTER[data], offsets)
    # 8-word windows found twice or more in their text
    at = K.gram_starts(words, _WINDOW)
    cover = np.zeros(len(words.starts) + 1, np.int64)
    if len(at):
        hit = at[_repeats(_window_classes(word)[at] * n_texts + rows[at])]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + _WINDOW, -1)
    out["n_repeat_words"] = K.sums(np.cumsum(cover)[:-1] > 0, words.first)
    # neighbouring equal words
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    out["n_stutter"] = K.sums(same, words.first)
    # lines that hold a word and equal an earlier one
    lines = K.find_words(data, offsets, _NOT_NEWLINE)
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=held[1:])
    full = held[lines.ends] > held[lines.starts]
    line_rows = lines.rows()[full]
    keys = K.classes(data, lines.starts[full], lines.ends[full], salt[line_rows])
    _, once = np.unique(keys, return_index=True)
    total = np.bincount(line_rows, minlength=n_texts)
    out["n_lines"] = total
    out["n_dup_lines"] = total - np.bincount(line_rows[once], minlength=n_texts)
    return out


def judge(m: dict[str, np.ndarray]) -> np.ndarray:
    """Failure bits, from whole-number comparisons only."""
    n = m["n_words"]
    fails = {
        "few_words": n < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * n,
        "symbols": 100 * m["n_symbols"] > 30 * n,
        "shouting": (100 * m["n_upper"] > 60 * m["n_letters"]) & (m["n_letters"] >= 40),
        "stutter": 100 * m["n_stutter"] > 30 * n,
        "repeated_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n),
    }
    bits = np.zeros(len(n), np.int64)
    for name, failed in fails.items():
        bits |= np.where(failed, BIT[name], 0)
    return bits


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _ledger_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch.column("text")):
            m = measure(data, offsets)
            cols = [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(judge(m))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *MEASURES, "failed"])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules the text fails. One narrow pass, no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ledger_batches, LEDGER)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows failing it, rows that only it rejects, and rows kept if it were left out.

    One pass over the ledger; every task sends one row of counts.
    """
    m = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(m))
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((hit == 0).cast("long")), F.lit(0)).alias("kept"), F.bit_or(hit).alias("any_failed"), F.bit_and(hit).alias("all_failed")]
    for r in POLICIES[policy]:
        aggs.append(F.coalesce(F.sum((hit.bitwiseAND(F.lit(BIT[r])) != 0).cast("long")), F.lit(0)).alias(f"f_{r}"))
        aggs.append(F.coalesce(F.sum((hit == BIT[r]).cast("long")), F.lit(0)).alias(f"o_{r}"))
    total = rows.agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in POLICIES[policy]]))
    return total.select("n", "kept", "any_failed", "all_failed", each.alias("e")).select("e.rule", "n", "kept", "e.n_failed", "e.n_only", "e.kept_without")


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    m = mask(policy)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.slices(batch.column("text")):
                yield batch.slice(lo, hi - lo).filter(pa.array((judge(measure(data, offsets)) & m) == 0))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+')"
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, {_W} AS w FROM documents
), line_parts AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), line_counts AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line_parts WHERE regexp_matches(line, '[^\x{{20}}\x{{09}}-\x{{0D}}]') GROUP BY rid
), pos AS (
  SELECT rid, w, unnest(generate_series(1, len(w)::BIGINT)) AS i FROM d
), win AS (
  SELECT rid, i, array_to_string(w[i:i+7], chr(10)) AS g FROM pos WHERE i + 7 <= len(w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, generate_series(0, 7) AS s(k) GROUP BY rid
), stut AS (
  SELECT rid, count(*) AS n_stutter FROM pos WHERE i > 1 AND w[i] = w[i-1] GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stutter, 0)::BIGINT AS n_stutter
  FROM d LEFT JOIN line_counts USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN stut USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * n_letters AND n_letters >= 40 THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_stutter > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed FROM f
""".replace("\\x{20}", "\\x20").replace("\\x{{20}}", "\\x20").replace("\\x{09}-\\x{0D}", "\\x09-\\x0D").replace("\\x{{09}}-\\x{{0D}}", "\\x09-\\x0D")
