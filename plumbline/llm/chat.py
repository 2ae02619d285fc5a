"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant
turns in alternation from user to assistant. For each turn the repair may
keep it, merge it into the one before, give it another role, or put an empty
turn before it; dynamic programming over the automaton's states finds the
cheapest choices, and the repaired turns are rendered.

One shuffle brings the turns of a conversation together, in order, and a task
repairs one conversation after the other. Those of more than ``BLOCK`` turns
or ``BLOCK_BYTES`` bytes go another way: range-partitioned on conversation and
turn and cut into blocks of their own turns, each summed up in a matrix of
least costs from state to state. Such matrices multiply (minimum of sums), so
the states at the borders of blocks come from one small step over them; each
block is then repaired by itself and the rendered parts are joined. Either way
a conversation is one row, which does not depend on the partitions.

Defined results: a null role or one that is not known must be given another;
a null text is empty; turns without a number come last; turns of one number
are taken in order of role and text; repeated rows are further turns;
conversations without an id form one; an empty table gives no rows; further
columns, of any name, are not looked at; a conversation whose rendered text is
beyond what a row can hold (2 GB) fails ``format_chats`` and is for
``format_parts``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize

MERGE, INSERT, RELABEL = 10, 21, 32
#: Turns and bytes of a block; conversations beyond either are cut.
BLOCK = 4096
BLOCK_BYTES = 8 << 20
ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2, "ai": 2}
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
#: (role, inserted role or None, merged) that lead from a state to a state; the state after is that of the role.
_MOVES: dict[int, list[tuple[int, int | None, bool]]] = {
    START: [(0, None, False), (1, None, False), (2, 1, False)],
    SYSTEM: [(0, None, True), (1, None, False), (2, 1, False)],
    USER: [(1, None, True), (2, None, False), (1, 2, False)],
    ASSISTANT: [(2, None, True), (1, None, False), (2, 1, False)],
}
_END = [0, 2 * INSERT, INSERT, 0]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
RESULT = "conv_id long, n_turns long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string"
_PART = RESULT.replace("n_turns", "segment int, n_turns")


def _steps(role: int | None) -> list[tuple[int, int, int, tuple[int, int | None, bool]]]:
    """(from, to, cost, move) for a turn of a role."""
    out = []
    for s, moves in _MOVES.items():
        for move in moves:
            to, inserted, merged = move
            out.append((s, to + 1, RELABEL * (to != role) + INSERT * (inserted is not None) + MERGE * merged, move))
    return out


_STEPS = {r: _steps(r) for r in (None, 0, 1, 2)}


def role_number(role: str | None) -> int | None:
    return None if role is None else ALIASES.get(role.strip().lower())


def least_costs(roles: list[int | None]) -> list[list[int]]:
    """The matrix of least costs of a run of turns, from each state to each."""
    rows = [[0 if s == t else _FAR for t in range(4)] for s in range(4)]
    for r in roles:
        for k in range(4):
            old, new = rows[k], [_FAR] * 4
            for s, t, c, _ in _STEPS[r]:
                if old[s] + c < new[t]:
                    new[t] = old[s] + c
            rows[k] = new
    return rows


def repair(roles: list[int | None], entry: int = START, exit_: int | None = None) -> tuple[int, list[tuple[int, int | None, bool]], int]:
    """The least cost from entry to exit (the best end if None), the moves, and the state reached."""
    cost = [_FAR] * 4
    cost[entry] = 0
    back: list[list[tuple[int, tuple[int, int | None, bool]] | None]] = []
    for r in roles:
        new: list[int] = [_FAR] * 4
        how: list = [None] * 4
        for s, t, c, move in _STEPS[r]:
            if cost[s] + c < new[t]:
                new[t], how[t] = cost[s] + c, (s, move)
        cost = new
        back.append(how)
    if exit_ is None:
        exit_ = min(range(4), key=lambda s: (cost[s] + _END[s], s))
        total = cost[exit_] + _END[exit_]
    else:
        total = cost[exit_]
    moves, s = [], exit_
    for how in reversed(back):
        s, move = how[s]
        moves.append(move)
    return total, moves[::-1], exit_


def render(texts: list[str], moves: list[tuple[int, int | None, bool]], entry: int, last: int | None) -> str:
    """The repaired turns; last: the state to close the conversation from, or None if it goes on."""
    out = []
    begun = entry != START
    for text, (role, inserted, merged) in zip(texts, moves):
        if merged:
            out.append(f"\n\n{text}")
            continue
        out.append(CLOSE if begun else "")
        if inserted is not None:
            out.append(f"{OPEN}{ROLES[inserted]}\n{CLOSE}")
        out.append(f"{OPEN}{ROLES[role]}\n{text}")
        begun = True
    if last is not None and begun:
        out.append(CLOSE)
        if last == SYSTEM:
            out.append(f"{OPEN}user\n{CLOSE}")
        if last in (SYSTEM, USER):
            out.append(f"{OPEN}assistant\n{CLOSE}")
    return "".join(out)


def _counts(roles: list[int | None], moves: list[tuple[int, int | None, bool]], last: int | None) -> tuple[int, int, int, int]:
    """Turns, and those merged, relabelled and inserted; last: the state a conversation ends in, or None if it goes on."""
    return len(roles), sum(m[2] for m in moves), sum(m[0] != r for m, r in zip(moves, roles)), sum(m[1] is not None for m in moves) + {USER: 1, SYSTEM: 2}.get(last, 0)


_COUNTED = ["conv_id", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"]


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of turns of one conversation."""

    def rows(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in itertools.groupby(stream, key=lambda t: t[0]):
            _, names, texts = zip(*turns)
            roles = [role_number(r) for r in names]
            cost, moves, last = repair(roles)
            yield (conv, *_counts(roles, moves, last), cost, render([t or "" for t in texts], moves, START, last))

    types = [pa.int64()] * 6 + [pa.string()]
    stream = (t for batch in batches for t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    done = rows(stream)
    while part := list(itertools.islice(done, 512)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], _COUNTED)


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    m = least_costs([role_number(r) for r in pdf.sort_values("at", kind="stable")["role"]])
    return _conversations([(pdf["conv_id"].iloc[0], pdf["block"].iloc[0], [x for row in m for x in row])], ["conv_id", "block", "matrix"])


def _conversations(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at the borders of a conversation's blocks, from their matrices."""
    pdf = pdf.sort_values("block")
    cost, back = [0, _FAR, _FAR, _FAR], []
    for m in pdf["matrix"]:
        best = [min(range(4), key=lambda s: (cost[s] + m[4 * s + t], s)) for t in range(4)]
        cost = [cost[best[t]] + int(m[4 * best[t] + t]) for t in range(4)]
        back.append(best)
    s = min(range(4), key=lambda t: (cost[t] + _END[t], t))
    exits = []
    for best in reversed(back):
        exits.append(s)
        s = best[s]
    exits = exits[::-1]
    out = pdf[["conv_id", "block"]].copy()
    out["entry"] = np.array([START, *exits[:-1]], np.int32)
    out["leave"] = np.array(exits, np.int32)
    out["final"] = np.arange(len(pdf)) == len(pdf) - 1
    return out


def _repair_block(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    pdf, b = pdf.sort_values("at", kind="stable"), state.iloc[0]
    roles = [role_number(r) for r in pdf["role"]]
    cost, moves, last = repair(roles, int(b["entry"]), int(b["leave"]))
    ending = last if b["final"] else None
    text = render([t or "" for t in pdf["text"]], moves, int(b["entry"]), ending)
    row = (b["conv_id"], int(b["block"]), *_counts(roles, moves, ending), cost + (0 if ending is None else _END[last]), text)
    return _conversations([row], [c.split()[0] for c in _PART.split(", ")])


def _sized(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns, and the number and size of the blocks of each conversation that is cut."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    per_block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(float(BLOCK_BYTES)) * F.col("n") / F.greatest(F.lit(1), F.col("bytes"))))).cast("long")
    long = materialize(size.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select(F.col("conv_id").alias("long_id"), per_block.alias("per_block")), "long")
    return turns, long


_ORDER = ["conv_id", "turn", "role", "text"]


def _parts(turns: DataFrame, long: DataFrame) -> DataFrame:
    """The repaired blocks of the conversations that are cut, with ``segment`` for their order."""
    own = turns.join(long, F.col("conv_id").eqNullSafe(F.col("long_id"))).drop("long_id")
    parts = max(8, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = own.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("id", F.monotonically_increasing_id())
    own = materialize(own.select("conv_id", "role", "text", "per_block", "id", F.shiftright("id", 33).alias("part")), "turns")
    # a turn's place in its conversation: that in its partition, less the first one's, plus what partitions before hold
    held = own.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("here"), F.min("id").alias("first"))
    held = held.withColumn("before", F.sum("here").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    held = held.select(F.col("conv_id").alias("held_id"), F.col("part").alias("held_part"), "first", F.coalesce("before", F.lit(0)).alias("before"))
    own = own.join(held, F.col("conv_id").eqNullSafe(F.col("held_id")) & (F.col("part") == F.col("held_part")))
    own = own.withColumn("at", F.col("id") - F.col("first") + F.col("before"))
    own = materialize(own.select("conv_id", "role", "text", "at", F.floor(F.col("at") / F.col("per_block")).cast("long").alias("block")), "blocks")
    matrices = own.groupBy("conv_id", "block").applyInPandas(_matrix, "conv_id long, block long, matrix array<long>")
    states = matrices.groupBy("conv_id").applyInPandas(_states, "conv_id long, block long, entry int, leave int, final boolean")
    return own.groupBy("conv_id", "block").cogroup(states.groupBy("conv_id", "block")).applyInPandas(_repair_block, _PART)


def format_parts(conversations: DataFrame) -> DataFrame:
    """The conversations that are cut, as one row for each block; the parts in order of ``segment`` make the text."""
    return _parts(*_sized(conversations))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per conversation the counts of repairs, their cost and the rendered turns."""
    turns, long = _sized(conversations)
    short = turns.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti")
    whole = short.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "role", "text").mapInArrow(_repair_whole, RESULT)
    if not long.limit(1).count():
        return whole
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "rendered"))), lambda x: x["rendered"]), "")
    cut = _parts(turns, long).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _COUNTED[1:6]], joined.alias("rendered"))
    return whole.union(cut.select(*_COUNTED))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The dynamic programme over the turns of all conversations at once; each state carries the text rendered on its cheapest way.
OP6_SQL = r"""
WITH RECURSIVE names(name, num) AS (VALUES ('system', 0), ('developer', 0), ('user', 1), ('human', 1), ('prompter', 1), ('assistant', 2), ('gpt', 2), ('bot', 2), ('model', 2), ('ai', 2)),
roles(num, word) AS (VALUES (0, 'system'), (1, 'user'), (2, 'assistant')),
moves(s, k, num, ins, mrg) AS (VALUES (0, 1, 0, NULL, 0), (0, 2, 1, NULL, 0), (0, 3, 2, 1, 0), (1, 1, 0, NULL, 1), (1, 2, 1, NULL, 0), (1, 3, 2, 1, 0),
  (2, 1, 1, NULL, 1), (2, 2, 2, NULL, 0), (2, 3, 1, 2, 0), (3, 1, 2, NULL, 1), (3, 2, 1, NULL, 0), (3, 3, 2, 1, 0)),
turns AS (
  SELECT conv_id, coalesce(text, '') AS text, num AS own,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 9223372036854775807), encode(role) NULLS FIRST, encode(text) NULLS FIRST) AS i
  FROM conversations LEFT JOIN names ON trim(lower(role)) = name
),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, 0::BIGINT AS merged, 0::BIGINT AS relabelled, 0::BIGINT AS inserted, '' AS rendered FROM turns
  UNION ALL
  SELECT conv_id, i, t, cost, merged, relabelled, inserted, rendered FROM (
    SELECT dp.conv_id, turns.i, m.num + 1 AS t, dp.s, m.k,
           cost + CASE WHEN m.num IS DISTINCT FROM own THEN 32 ELSE 0 END + CASE WHEN ins IS NOT NULL THEN 21 ELSE 0 END + 10 * mrg AS cost,
           merged + mrg AS merged, relabelled + (m.num IS DISTINCT FROM own)::BIGINT AS relabelled, inserted + (ins IS NOT NULL)::BIGINT AS inserted,
           CASE WHEN mrg = 1 THEN rendered || chr(10) || chr(10) || text
                ELSE rendered || CASE WHEN dp.s > 0 THEN '<|im_end|>' || chr(10) ELSE '' END
                  || CASE WHEN ins IS NOT NULL THEN '<|im_start|>' || e.word || chr(10) || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>' || r.word || chr(10) || text END AS rendered
    FROM dp JOIN turns ON turns.conv_id IS NOT DISTINCT FROM dp.conv_id AND turns.i = dp.i + 1 JOIN moves m ON m.s = dp.s JOIN roles r ON r.num = m.num LEFT JOIN roles e ON e.num = ins
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, s, k) = 1
),
ends AS (
  SELECT *, cost + CASE s WHEN 1 THEN 42 WHEN 2 THEN 21 ELSE 0 END AS total FROM dp JOIN (SELECT conv_id AS c, max(i) AS n FROM turns GROUP BY conv_id) ON c IS NOT DISTINCT FROM conv_id AND i = n
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total, s) = 1
)
SELECT conv_id, n AS n_turns, merged AS n_merged, relabelled AS n_relabelled, inserted + CASE s WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_inserted, total AS cost,
       rendered || '<|im_end|>' || chr(10) || CASE WHEN s = 1 THEN '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END
         || CASE WHEN s IN (1, 2) THEN '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END AS rendered
FROM ends
"""
