"""Preference formatting: one prompt from the common turns of two conversations, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before a turn's role, after it, and after its text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def turn_lists(turns: DataFrame) -> DataFrame:
    """``pair_id, turns``: each conversation's turns (role, text) in order of turn, nulls first; equal turns by role, then text."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("pair_id").agg(F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit(""))


def _text(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def rendered(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role(t), F.lit(MIDDLE), _text(t), F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Trained spans of ``rendered(turns)`` as ``start:end`` joined by commas: texts and closings of assistant turns, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        text_at = state["at"] + len(OPEN) + F.length(_role(t)) + len(MIDDLE)
        end = text_at + F.length(_text(t)) + len(CLOSE)
        span = F.array(F.concat_ws(":", text_at.cast("string"), end.cast("string")))
        spans = F.when(_role(t) == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Preference pairs from two tables of turns (``pair_id, turn, role, text``).

    Returns ``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, identical``. The prompt is the longest common
    prefix of turns, equal in role and text (nulls equal nulls), rendered once; a completion is the rest of its side, and its mask lists
    the spans that are trained on. A pair with no common turn has an empty prompt; if one side ends within the other or both are
    the same, its completion is empty, and ``identical`` tells the latter. Pairs of which a side has no rows are left out. Null roles and
    texts render as empty. Turns with a null ``pair_id`` are one conversation like others. Two conversations meet by a join on ``pair_id``; a row holds one pair.
    """
    c = turn_lists(chosen).withColumnRenamed("turns", "_c")
    r = turn_lists(rejected).select(F.col("pair_id").alias("_id"), F.col("turns").alias("_r"))
    both = c.join(r, F.col("pair_id").eqNullSafe(F.col("_id"))).drop("_id")
    same = F.zip_with("_c", "_r", lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False)))
    shorter = F.least(F.size("_c"), F.size("_r"))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    common = F.when((first_other == 0) | (first_other > shorter), shorter).otherwise(first_other - 1)
    cut = both.withColumn("_n", common)
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    return cut.select(
        "pair_id",
        F.col("_n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
        rendered(rest("_c")).alias("chosen"),
        rendered(rest("_r")).alias("rejected"),
        mask(rest("_c")).alias("chosen_mask"),
        mask(rest("_r")).alias("rejected_mask"),
        ((F.col("_n") == F.size("_c")) & (F.col("_n") == F.size("_r"))).alias("identical"),
    )


def neighbour_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from one table of conversations, which has no preferences of its own.

    Chosen is a conversation as it is. Rejected is the same one with one answer taken from the neighbour (2k and 2k+1 are
    neighbours): the first answer where conv_id divides by 3, else the last. Without an answer on both sides, nothing is replaced;
    a null conv_id has no neighbour.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = turns.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(
        F.min(F.struct("turn", "text")).alias("first"), F.max(F.struct("turn", "text")).alias("last")
    )
    early = F.col("pair_id") % 3 == 0
    swaps = answers.select("pair_id", F.when(early, F.col("first.turn")).otherwise(F.col("last.turn")).alias("_turn"))
    other = answers.select(
        F.expr("CASE WHEN pair_id % 2 = 0 THEN pair_id + 1 ELSE pair_id - 1 END").alias("pair_id"),
        F.col("first.text").alias("_first"), F.col("last.text").alias("_last"),
    )
    planned = swaps.join(other, "pair_id").select("pair_id", "_turn", F.when(early, F.col("_first")).otherwise(F.col("_last")).alias("_new"))
    swapped = (F.col("turn") == F.col("_turn")) & (F.col("role") == TRAINED_ROLE)
    rejected = turns.join(planned, "pair_id", "left").select("pair_id", "turn", "role", F.when(swapped, F.col("_new")).otherwise(F.col("text")).alias("text"))
    return turns, rejected


def op10_format_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference examples from all conversations."""
    return format_preferences(*neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_RENDER = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
OP10_SQL = f"""
WITH a AS (
  SELECT conv_id, min(turn) AS t0, max(turn) AS t1, arg_min_null(text, turn) AS x0, arg_max_null(text, turn) AS x1
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
s AS (
  SELECT a.conv_id, CASE WHEN a.conv_id % 3 = 0 THEN a.t0 ELSE a.t1 END AS at, CASE WHEN a.conv_id % 3 = 0 THEN b.x0 ELSE b.x1 END AS new
  FROM a JOIN a b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
t AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS k, c.role, c.text,
         CASE WHEN c.turn = s.at AND c.role = 'assistant' THEN s.new ELSE c.text END AS other
  FROM conversations c LEFT JOIN s USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE text IS DISTINCT FROM other) - 1, count(*)) AS n, count(*) AS size FROM t GROUP BY conv_id),
r AS (
  SELECT conv_id, k, n, size, role, {_RENDER} AS c, {_RENDER.replace('text', 'other')} AS o,
         length('<|im_start|>') + length(coalesce(role, '')) + 1 AS head
  FROM t JOIN n USING (conv_id)),
e AS (
  SELECT *, sum(CASE WHEN k > n THEN length(c) ELSE 0 END) OVER w AS ce, sum(CASE WHEN k > n THEN length(o) ELSE 0 END) OVER w AS oe
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id AS pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (WHERE k <= n), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (WHERE k > n), '') AS chosen,
       coalesce(string_agg(o, '' ORDER BY k) FILTER (WHERE k > n), '') AS rejected,
       coalesce(string_agg(CAST(CAST(ce - length(c) + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ce AS BIGINT) AS VARCHAR), ',' ORDER BY k)
         FILTER (WHERE k > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(CAST(oe - length(o) + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(oe AS BIGINT) AS VARCHAR), ',' ORDER BY k)
         FILTER (WHERE k > n AND role = 'assistant'), '') AS rejected_mask,
       any_value(n) = any_value(size) AS identical
FROM e GROUP BY conv_id
"""

QUERIES = {"op10_format_preferences": op10_format_preferences}
SQL = {"op10_format_preferences": OP10_SQL}
