"""Preference formatting of conversation pairs. DataFrame functions only.

The turns that chosen and rejected have in common from the start (role and text) are rendered once, as
prompt; what follows on either side is a completion, with the character spans that a trainer may learn
from: the assistant's texts with their end marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources.tables import table

END_MARK = "<|end|>"


def _render(turn: str) -> str:
    return f"concat('<|', {turn}.role, '|>\\n', {turn}.text, '{END_MARK}\\n')"


def _spans(turns: str) -> str:
    """The mask of rendered turns, as ``begin-end`` spans with commas between."""
    begin = "s.at + length(x.role) + 5"
    upto = f"{begin} + length(x.text) + {len(END_MARK)}"
    step = f"struct(s.at + length({_render('x')}) as at, if(x.role = 'assistant', concat(s.spans, array(concat({begin}, '-', {upto}))), s.spans) as spans)"
    return f"array_join(aggregate({turns}, struct(0 as at, cast(array() as array<string>) as spans), (s, x) -> {step}, s -> s.spans), ',')"


def preference_pairs(turns: DataFrame, pair: str = "pair_id", rejected: str = "is_rejected") -> DataFrame:
    """A row for each pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, chosen_turns, rejected_turns.

    turns: (pair, rejected, turn, role, text), a row for each turn. A null role is ``unknown``, a null
    text empty. Turns come in the order of their numbers, null first; equal numbers by role and text;
    repeated rows are turns of their own. Turns without a pair belong to none and give no row. A pair
    with one side only has that side whole as completion, and an empty prompt. Masks are spans of the
    completion's characters. A conversation is one string at last, so it must fit a task's memory.
    """
    chosen = turns.where(F.col(pair).isNotNull()).select(F.col(pair).alias("pair_id"), F.col(rejected).alias("side"), _turn().alias("t"))
    return _formatted(chosen.groupBy("pair_id").agg(_listed(~F.col("side")).alias("c"), _listed(F.col("side")).alias("r")))


def _turn() -> F.Column:
    return F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _listed(which: F.Column) -> F.Column:
    return F.array_sort(F.collect_list(F.when(which, F.col("t"))))


def _formatted(sides: DataFrame) -> DataFrame:
    """Of (pair_id, c, r), the turns of both sides in order."""
    # The first place where they differ; sequence() counts down where its end is below its start.
    common = "aggregate(if(size(c) = 0 or size(r) = 0, array(), sequence(1, least(size(c), size(r)))), 0, (n, i) -> if(n = i - 1 and c[i - 1].role = r[i - 1].role and c[i - 1].text = r[i - 1].text, i, n))"
    cut = sides.withColumn("n", F.expr(common)).withColumns({"p": F.expr("slice(c, 1, n)"), "c": F.expr("slice(c, n + 1, size(c) - n)"), "r": F.expr("slice(r, n + 1, size(r) - n)")})
    joined = {k: F.expr(f"array_join(transform({v}, x -> {_render('x')}), '')") for k, v in (("prompt", "p"), ("chosen", "c"), ("rejected", "r"))}
    return cut.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"), *(v.alias(k) for k, v in joined.items()), F.expr(_spans("c")).alias("chosen_mask"), F.expr(_spans("r")).alias("rejected_mask"),
        F.size("c").cast("long").alias("chosen_turns"), F.size("r").cast("long").alias("rejected_turns"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs of a table that names none, as ``preference_pairs`` formats them, one for each conversation (pair_id: its conv_id).

    Chosen is the conversation; rejected is the same up to its last assistant turn, in place of which stands the last
    assistant turn of the conversation that shares its half: 2k and 2k + 1. A conversation without an assistant turn
    is kept whole on both sides before that answer; a neighbour without one gives no answer. Both conversations of a
    half meet in one group, so the table is shuffled once.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id"), _turn().alias("t"))
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    both = turns.groupBy(F.shiftright("conv_id", 1).alias("half")).agg(_listed(even).alias("x"), _listed(~even).alias("y"))
    back = "array_position(reverse(transform({0}, t -> t.role)), 'assistant')"
    before = f"slice({{0}}, 1, size({{0}}) - cast({back} as int))"
    answer = f"slice({{0}}, size({{0}}) - cast({back} as int) + 1, if({back} > 0, 1, 0))"
    pair = "if(size({0}) > 0, named_struct('pair_id', half * 2 + {2}, 'c', {0}, 'r', concat(" + before + ", " + answer.replace("{0}", "{1}") + ")), null)"
    each = both.select(F.explode(F.expr(f"filter(array({pair.format('x', 'y', 0)}, {pair.format('y', 'x', 1)}), p -> p is not null)")).alias("p"))
    return _formatted(each.select("p.*"))


_SIDE = """(SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS s,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(off + length(role) + 5 AS BIGINT) || '-' || CAST(off + length(role) + 5 + length(text) + 7 AS BIGINT) END, ',' ORDER BY pos) AS m, count(*) AS n
  FROM (SELECT *, sum(size) OVER (PARTITION BY pair_id ORDER BY pos) - size AS off FROM after WHERE side = {}) GROUP BY pair_id)"""
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id AS pair_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT pair_id, max(pos) FILTER (role = 'assistant') AS answered, coalesce(max(pos) FILTER (role = 'assistant') - 1, max(pos)) AS upto FROM c GROUP BY pair_id),
answers AS (SELECT c.pair_id, c.text FROM c JOIN ends ON c.pair_id = ends.pair_id AND c.pos = ends.answered),
t AS (SELECT pair_id, 0 AS side, role, text, pos FROM c
    UNION ALL SELECT c.pair_id, 1, c.role, c.text, c.pos FROM c JOIN ends ON c.pair_id = ends.pair_id WHERE c.pos <= ends.upto
    UNION ALL SELECT ends.pair_id, 1, 'assistant', answers.text, ends.upto + 1 FROM ends JOIN answers ON answers.pair_id = xor(ends.pair_id, 1)),
n AS (SELECT pair_id, side, max(pos) AS n FROM t GROUP BY pair_id, side),
shared AS (SELECT c.pair_id, least(c.n, r.n) AS most FROM (SELECT * FROM n WHERE side = 0) c JOIN (SELECT * FROM n WHERE side = 1) r ON c.pair_id = r.pair_id),
differ AS (SELECT c.pair_id, min(c.pos) AS pos FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.side = 0 AND r.side = 1 WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
cut AS (SELECT p.pair_id, coalesce(d.pos - 1, s.most, 0) AS n FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN shared s ON p.pair_id = s.pair_id LEFT JOIN differ d ON p.pair_id = d.pair_id),
after AS (SELECT t.*, length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)) AS size FROM t JOIN cut ON t.pair_id = cut.pair_id WHERE t.pos > cut.n),
prompt AS (SELECT t.pair_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS s FROM t JOIN cut ON t.pair_id = cut.pair_id WHERE t.side = 0 AND t.pos <= cut.n GROUP BY t.pair_id)
SELECT cut.pair_id, CAST(cut.n AS BIGINT) AS prompt_turns, coalesce(prompt.s, '') AS prompt, coalesce(c.s, '') AS chosen, coalesce(r.s, '') AS rejected,
    coalesce(c.m, '') AS chosen_mask, coalesce(r.m, '') AS rejected_mask, coalesce(c.n, 0) AS chosen_turns, coalesce(r.n, 0) AS rejected_turns
FROM cut LEFT JOIN prompt ON cut.pair_id = prompt.pair_id LEFT JOIN {_SIDE.format(0)} c ON cut.pair_id = c.pair_id LEFT JOIN {_SIDE.format(1)} r ON cut.pair_id = r.pair_id
"""


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swapped_answers(table(spark, sf_dir, "conversations"))
