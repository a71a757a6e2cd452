"""Preference formatting: the common start of a chosen and a rejected conversation is the prompt.

The longest common prefix of whole turns (equal role and text) is rendered once. What follows in
each conversation is a completion; its mask lists the stretches, in characters of the completion,
that the assistant wrote. Conversations are paired by a table or, in the query, 2k with 2k + 1.

Defined results: a null role or text counts as empty; turns stand in the order of their number,
ties by role and text; equal conversations have the whole as prompt and two empty completions; a
conversation without a partner gives no pair; rows with a null conv_id are left out; an empty table
gives no rows; extra columns are ignored; a repeated row is a turn of its own, and a null turn number stands first. A pair is one output row, so it is
handled as one, with its whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is shown as <|role|>, a line break, the text, a line break; so many characters are not role or text before the text.
AROUND = 5


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """pair_id, prompt, chosen, rejected, n_common and the masks. pairs: (pair_id, conv_id, side), side 0 is chosen."""
    t = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    if pairs is None:
        t = t.withColumns({"pair_id": F.floor(F.col("conv_id") / 2), "side": F.pmod("conv_id", F.lit(2)).cast("int")})
    else:
        t = t.join(pairs, "conv_id")
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in ((0, "c"), (1, "r"))]
    both = t.groupBy("pair_id").agg(*sides).filter("size(c) > 0 AND size(r) > 0")
    same = "c[i].role = r[i].role AND c[i].text = r[i].text"
    shared = f"coalesce(array_min(filter(sequence(0, least(size(c), size(r)) - 1), i -> NOT ({same}))), least(size(c), size(r)))"
    both = both.withColumn("n_common", F.expr(shared).cast("long"))
    shown = r"concat('<|', x.role, '|>\n', x.text, '\n')"
    both = both.withColumn("prompt", F.expr(f"array_join(transform(slice(c, 1, CAST(n_common AS INT)), x -> {shown}), '')"))
    for name, col in (("c", "chosen"), ("r", "rejected")):
        rest = f"transform(slice({name}, CAST(n_common AS INT) + 1, greatest(size({name}) - CAST(n_common AS INT), 0)), x -> struct(x.role AS role, {shown} AS shown))"
        both = both.withColumn(f"_{name}", F.expr(rest))
        both = both.withColumn(col, F.expr(f"array_join(transform(_{name}, x -> x.shown), '')"))
        step = (
            f"aggregate(_{name}, struct(0 AS at, CAST(array() AS array<string>) AS spans), (a, x) -> struct(a.at + length(x.shown) AS at, "
            f"IF(x.role = 'assistant', concat(a.spans, array(concat(CAST(a.at + length(x.role) + {AROUND} AS STRING), '-', CAST(a.at + length(x.shown) AS STRING)))), a.spans) AS spans), a -> array_join(a.spans, ','))"
        )
        both = both.withColumn(f"{col}_mask", F.expr(step))
    return both.select("pair_id", "n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def report(turns: DataFrame) -> DataFrame:
    return preference_pairs(turns)


SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT pair_id FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2
), d AS (
  SELECT pair_id, min(k) - 1 AS n_common
  FROM (SELECT pair_id, k FROM t GROUP BY pair_id, k HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text))
  GROUP BY pair_id
), n AS (
  SELECT pair_id, max(k) AS n_turns FROM t GROUP BY pair_id
), u AS (
  SELECT t.*, coalesce(n_common, n_turns) AS n_common, '<|' || role || '|>' || chr(10) || text || chr(10) AS shown
  FROM t JOIN whole USING (pair_id) JOIN n USING (pair_id) LEFT JOIN d USING (pair_id)
), v AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, k > n_common ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u
)
SELECT pair_id, CAST(min(n_common) AS BIGINT) AS n_common,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k <= n_common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k > n_common), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k > n_common), '') AS rejected,
       coalesce(string_agg((before + length(role) + 5)::BIGINT || '-' || (before + length(shown))::BIGINT, ',' ORDER BY k) FILTER (side = 0 AND k > n_common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((before + length(role) + 5)::BIGINT || '-' || (before + length(shown))::BIGINT, ',' ORDER BY k) FILTER (side = 1 AND k > n_common AND role = 'assistant'), '') AS rejected_mask
FROM v GROUP BY pair_id
"""
