"""Preference pairs: one prompt of the turns that both conversations share, and two masked completions.

Inputs are tables of turns (pair_id, turn, role, text), one of chosen and one of rejected conversations. Turns are
ordered by (turn, role, text). The longest common prefix counts turns equal in role and text; it is rendered once, as
the prompt, and the rest of either side as its completion. A completion's mask lists the character spans, in prompt
plus completion, of what assistants say, with the closing mark: there the loss is taken.

Null role or text counts as empty. Repeated rows are turns of their own. Pairs that lack a side are left out; a side
that is a prefix of the other has an empty completion and mask. Rows whose pair_id is null are left out. Extra columns
are ignored. Only DataFrame functions are used; a conversation is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CLOSE_CHARS = len(CLOSE) - 1


def _gathered(turns: DataFrame, name: str) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.where("pair_id is not null").select("pair_id", turn.alias("t")).groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias(name))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, base: Column) -> Column:
    """"from:to" of each assistant turn's text and closing mark, joined by commas; a fold keeps the place."""
    start = F.struct(base.cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.lit(len(OPEN) + 1) + F.char_length(t["role"])
        end = begin + F.char_length(t["text"]) + F.lit(_CLOSE_CHARS)
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per pair: pair_id, n_prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    pairs = _gathered(chosen, "c").join(_gathered(rejected, "r"), "pair_id")
    # the first position at which the sides differ, or the shorter side's length
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    pairs = pairs.withColumn("n", F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    pairs = pairs.select("pair_id", F.col("n").cast("long").alias("n_prefix_turns"), _text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    base = F.char_length("prompt")
    return pairs.select("pair_id", "n_prefix_turns", "prompt", _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"), _mask(F.col("c"), base).alias("chosen_mask"), _mask(F.col("r"), base).alias("rejected_mask"))


def with_foreign_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns: every conversation, and the same with its last turn's text from its neighbour's last turn.

    The neighbour of id c is c + 1 for even c and c - 1 for odd c; without one the last turn is missing.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("pair_id is not null")
    last = turns.groupBy("pair_id").agg(F.max(F.struct("turn", "role", "text")).alias("l"))
    foreign = last.select((F.col("pair_id") + F.when(F.pmod("pair_id", F.lit(2)) == 0, 1).otherwise(-1)).alias("pair_id"), F.col("l.text").alias("reply"))
    before = turns.join(last, "pair_id").where(F.struct("turn", "role", "text") < F.col("l")).select("pair_id", "turn", "role", "text")
    replies = last.join(foreign, "pair_id").select("pair_id", F.col("l.turn").alias("turn"), F.col("l.role").alias("role"), F.col("reply").alias("text"))
    return turns, before.unionByName(replies)


#: The same in DuckDB, over with_foreign_replies(conversations).
SQL = """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT pair_id, max({'turn': turn, 'role': role, 'text': text}) AS l FROM turns GROUP BY pair_id
), rejected_turns AS (
  SELECT t.pair_id, t.turn, t.role, t.text FROM turns t JOIN last USING (pair_id) WHERE {'turn': t.turn, 'role': t.role, 'text': t.text} < last.l
  UNION ALL
  SELECT a.pair_id, a.l.turn, a.l.role, b.l.text FROM last a JOIN last b ON b.pair_id = a.pair_id + CASE WHEN a.pair_id % 2 = 0 THEN 1 ELSE -1 END
), c0 AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM turns),
r0 AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM rejected_turns),
lcp AS (
  SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same), max(i) + 1) - 1 AS n FROM (
    SELECT pair_id, i, c0.role IS NOT DISTINCT FROM r0.role AND c0.text IS NOT DISTINCT FROM r0.text AS same FROM c0 FULL JOIN r0 USING (pair_id, i)
    WHERE pair_id IN (SELECT pair_id FROM rejected_turns)) GROUP BY pair_id
), sides AS (
  SELECT 'c' AS side, * FROM c0 UNION ALL SELECT 'r', * FROM r0
), drawn AS (
  SELECT side, s.pair_id, i, n, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS out FROM sides s JOIN lcp USING (pair_id)
), placed AS (
  SELECT *, sum(length(out)) OVER (PARTITION BY side, pair_id ORDER BY i) - length(text) - 11 AS b FROM drawn
)
SELECT pair_id, any_value(n)::BIGINT AS n_prefix_turns,
  coalesce(string_agg(out, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(out, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(out, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(b::BIGINT || ':' || (b + length(text) + 10)::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(b::BIGINT || ':' || (b + length(text) + 10)::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
