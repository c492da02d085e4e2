"""Preference formatting: one prompt and two masked completions per pair of conversations.

A pair's chosen and rejected conversations are compared turn by turn.  The longest common
prefix of turns (equal role and text) is rendered once, as the prompt; what is left of
each conversation is its completion, with the code-point spans of assistant turns as its
training mask.  Only DataFrame functions are used, and turns are shuffled once, by pair.

Edge cases: null role or text counts as empty; a row that repeats another one exactly is
the same turn, not one more; other turns that share a number are ordered by role, then
text; rows without a pair, side or turn number are left out; a pair that lacks one side
has an empty prompt and an empty completion on that side; equal conversations give a
prompt and two empty completions; a text of any length is rendered whole; columns besides
the named ones, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table


@dataclass(frozen=True)
class Template:
    """A turn is opened by ``before`` + role + ``after`` and closed by ``end``; ``trained`` roles are unmasked."""

    before: str = "<|"
    after: str = "|>\n"
    end: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)


def _head(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.before), turn["role"], F.lit(t.after))


def _render(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x, t), x["text"], F.lit(t.end))), "")


def _mask(turns: Column, t: Template) -> Column:
    """Spans of what a trained turn says, its end marker included, within the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(_head(x, t))
        end = begin + F.char_length(x["text"]) + len(t.end)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"].isin(*t.trained), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _ordered(turns: Column) -> Column:
    return F.array_distinct(F.sort_array(turns))


def format_sides(sides: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per pair from (pair, chosen, rejected), arrays of (turn, role, text) in order."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    common = F.coalesce(F.array_position(same, False) - 1, F.lit(0).cast("long"))
    common = F.when(common < 0, F.size(same)).otherwise(common).cast("int")
    cut = sides.withColumn("n_common", common)
    rest = lambda s: F.slice(s, F.col("n_common") + 1, F.size(s))
    cut = cut.select("pair", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return cut.select(
        "pair", "n_common", _render(F.col("p"), template).alias("prompt"), _render(F.col("c"), template).alias("chosen"), _render(F.col("r"), template).alias("rejected"),
        _mask(F.col("c"), template).alias("chosen_mask"), _mask(F.col("r"), template).alias("rejected_mask"),
    )


def format_pairs(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per pair from (pair, side, turn, role, text), side ``chosen`` or ``rejected``."""
    clean = turns.where("pair is not null and turn is not null and side in ('chosen', 'rejected')").select("pair", "side", _turn().alias("x"))
    sides = clean.groupBy("pair").agg(*[_ordered(F.collect_list(F.when(F.col("side") == s, F.col("x")))).alias(s) for s in ("chosen", "rejected")])
    return format_sides(sides, template)


def answered_otherwise(conversations: DataFrame) -> DataFrame:
    """(pair, chosen, rejected): each conversation, and the same with another last answer.

    Conversations 2i and 2i + 1 lend each other the text of their last assistant turn
    (empty where the neighbour has none), so a pair shares all turns before its answer.
    """
    known = conversations.where("conv_id is not null and turn is not null")
    couple = known.groupBy(F.floor(F.col("conv_id") / 2).alias("couple")).agg(
        *[_ordered(F.collect_list(F.when(F.pmod("conv_id", F.lit(2)) == k, _turn()))).alias(f"s{k}") for k in (0, 1)]
    )
    spoken = lambda turns: F.filter(turns, lambda x: x["role"] == "assistant")
    answer = lambda turns: F.coalesce(F.try_element_at(spoken(turns), F.lit(-1))["text"], F.lit(""))

    def other(own: Column, text: Column) -> Column:
        last = F.try_element_at(spoken(own), F.lit(-1))
        return F.transform(own, lambda x: F.when(x == last, F.struct(x["turn"].alias("turn"), x["role"].alias("role"), text.alias("text"))).otherwise(x))

    one = lambda k: F.struct(
        (2 * F.col("couple") + k).alias("pair"), F.col(f"s{k}").alias("chosen"), other(F.col(f"s{k}"), answer(F.col(f"s{1 - k}"))).alias("rejected")
    )
    return couple.select(F.inline(F.array(one(0), one(1)))).where(F.size("chosen") > 0)


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_sides(answered_otherwise(table(spark, sf_dir, "conversations")))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return made.select(F.col("pair").alias("pair_id"), F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask"))


SQL = r"""
WITH u AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
a AS (SELECT conv_id, max(k) AS k, arg_max(text, k) AS answer FROM u WHERE role = 'assistant' GROUP BY conv_id),
t AS (
  SELECT conv_id AS pair, 0 AS side, role, text, k FROM u
  UNION ALL
  SELECT u.conv_id, 1, role, CASE WHEN u.k = a.k THEN coalesce(o.answer, '') ELSE text END, u.k
  FROM u LEFT JOIN a ON a.conv_id = u.conv_id LEFT JOIN a o ON o.conv_id = xor(u.conv_id, 1)),
n AS (SELECT pair, max(k) FILTER (WHERE side = 0) AS a, max(k) FILTER (WHERE side = 1) AS b FROM t GROUP BY pair),
d AS (
  SELECT x.pair, min(x.k) AS k FROM t x JOIN t y ON x.pair = y.pair AND x.k = y.k AND x.side = 0 AND y.side = 1
  WHERE x.role <> y.role OR x.text <> y.text GROUP BY x.pair),
c AS (SELECT n.pair, coalesce(d.k - 1, least(coalesce(a, 0), coalesce(b, 0))) AS n_common FROM n LEFT JOIN d USING (pair)),
r AS (
  SELECT t.*, n_common, t.k <= n_common AS in_prompt, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS full_text FROM t JOIN c USING (pair)),
m AS (
  SELECT *, coalesce(sum(length(full_text)) OVER (PARTITION BY pair, side, in_prompt ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM r)
SELECT pair AS pair_id, any_value(n_common)::BIGINT AS n_common,
       coalesce(string_agg(full_text, '' ORDER BY k) FILTER (WHERE in_prompt AND side = 0), '') AS prompt,
       coalesce(string_agg(full_text, '' ORDER BY k) FILTER (WHERE NOT in_prompt AND side = 0), '') AS chosen,
       coalesce(string_agg(full_text, '' ORDER BY k) FILTER (WHERE NOT in_prompt AND side = 1), '') AS rejected,
       coalesce(string_agg((off + length(head)) || ':' || (off + length(full_text)), ',' ORDER BY k)
         FILTER (WHERE NOT in_prompt AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((off + length(head)) || ':' || (off + length(full_text)), ',' ORDER BY k)
         FILTER (WHERE NOT in_prompt AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair
"""
