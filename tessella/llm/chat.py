"""Operator 2: chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, cut off after each turn. Method: every
turn's prefix is known by rolling sums of its turns' hashes; a conversation whose
whole is a proper prefix of another is dropped by an anti-join, equal conversations
keep the one of least key, and what stays is rendered.

The sums (four sums of 32-bit parts of two hashes, with the count of turns) roll in
two levels, inside runs of ``RUN`` turns and over the runs' totals, so no window
ever holds more than ``RUN`` turns of a conversation, and all keys combine before
shuffles. A first turn shared by a third of all conversations is one row among the
prefixes. Only rendering brings a conversation together, as its result does.

Defined cases: turns are told apart by number, role and text; rows that repeat
within a conversation count once; turns of the same number are ordered by role and
text; null turn, role and text are values like others (turn 0, empty strings when
rendered); rows with a null conversation key are left out; other columns stay
behind; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.session import written
from tessella.sources import table

#: Turns of a conversation that one window holds.
RUN = 1024
SUMS = ["s0", "s1", "s2", "s3"]


def _parts() -> list[Column]:
    """32-bit halves of two hashes of a turn, as longs: their sums do not overflow below 2^31 turns."""
    out = []
    for salt in ("a", "b"):
        h = F.xxhash64(F.lit(salt), "turn", "role", "text")
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF)]
    return [x.cast("long").alias(name) for x, name in zip(out, SUMS, strict=True)]


def turns(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    df = chats.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return df.filter("conv_id is not null").distinct()


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``n`` and the sums after each turn."""
    hashed = rows.select("conv_id", "turn", F.floor(F.col("turn") / RUN).alias("run"), *_parts())
    # turns of one number make one step, so their order never matters
    steps = hashed.groupBy("conv_id", "run", "turn").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    columns = ["n", *SUMS]
    runs = steps.groupBy("conv_id", "run").agg(*[F.sum(c).alias(c) for c in columns])
    before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns])
    within = W.partitionBy("conv_id", "run").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.select("conv_id", "run", *[F.sum(c).over(within).alias(c) for c in columns])
    return steps.join(runs, ["conv_id", "run"]).select("conv_id", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in columns])


def collapse(
    chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Turns (``conv_id``, ``turn``, ``role``, ``text``) of the maximal conversations."""
    rows = turns(chats, conv_col, turn_col, role_col, text_col)
    columns = ["n", *SUMS]
    steps = written(prefixes(rows), "chat-prefixes")
    whole = steps.groupBy("conv_id").agg(F.max("n").alias("n"), *[F.max_by(s, "n").alias(s) for s in SUMS])
    first = whole.groupBy(*columns).agg(F.min("conv_id").alias("conv_id"))  # equal conversations: the least key
    proper = steps.join(whole.select("conv_id", F.col("n").alias("all")), "conv_id").filter("n < all").select(*columns).distinct()
    kept = first.join(proper, columns, "left_anti").select("conv_id")
    return rows.join(kept, "conv_id", "left_semi")


def render(rows: DataFrame, system: str = "") -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered``: each turn as a role line, its text and an end mark."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    texts = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    df = rows.groupBy("conv_id").agg(ordered.alias("turns"))
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat(F.lit(system), F.array_join(texts, "")).alias("rendered"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(turn || chr(1) || role || chr(1) || text ORDER BY turn, role, text) AS x, list(turn ORDER BY turn, role, text) AS ts,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id
), w AS (SELECT conv_id, len(x) AS n, array_to_string(x, chr(2)) AS whole, rendered FROM c),
proper AS (
  SELECT DISTINCT array_to_string(x[1 : k], chr(2)) AS whole
  FROM (SELECT x, ts, unnest(range(1, len(x))) AS k FROM c) WHERE ts[k] <> ts[k + 1]
)
SELECT min(conv_id) AS conv_id, any_value(n)::BIGINT AS n_turns, any_value(rendered) AS rendered
FROM w WHERE whole NOT IN (SELECT whole FROM proper) GROUP BY whole
"""

QUERIES = {"op2_chat": op2_chat}
ORACLE = {"op2_chat": SQL}
