"""Preference formatting of chat conversations (native).

A pair holds a chosen and a rejected conversation as arrays of (role, text)
turns.  Their longest common prefix of turns is rendered once as the prompt;
the rest of each side is rendered as a completion with the character spans
that a loss covers: the text and end mark of its assistant turns.

Only higher-order functions on arrays run here; a conversation is grouped once
by its id (its size is the size of the row it becomes).

Defined results: NULL roles and texts count as empty ones; turns are ordered
by number, then role, then text, and a repeated row counts once; rows without
a conversation id belong to no conversation; equal sides give a prompt and two
empty completions, an empty side an empty completion; template marks inside a
text are broken up, so that a text cannot open or close a turn; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# --- fixed values: the template ---------------------------------------------
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ANSWER = "assistant"
# ---------------------------------------------------------------------------


def conversations(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per conversation: its id and ``turns`` in order."""
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (df.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias(conv))
            .agg(F.array_sort(F.array_distinct(F.collect_list(t))).alias("turns"))
            .select(conv, F.transform("turns", lambda x: F.struct(
                x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that both sides share."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    miss = F.array_position(same, False)
    return F.when(miss == 0, F.size(same)).otherwise(miss - 1).cast("int")


def _safe(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        _head(t), _safe(t["text"]), F.lit(CLOSE + "\n"))), "")


def answer_spans(turns: Column) -> Column:
    """[start, end) of the text and end mark of every assistant turn in the
    rendered turns, in characters."""
    def step(acc, t):
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_safe(t["text"])) + len(CLOSE)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(
            t["role"] == ANSWER, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, first, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, *, chosen: str = "chosen",
                       rejected: str = "rejected") -> DataFrame:
    """Replaces the two turn arrays by ``n_prompt_turns``, ``prompt``, the two
    rendered completions and their spans (``<side>_mask``)."""
    from .common import hidden
    n, a, b = hidden(pairs, "n", "a", "b")
    made = {chosen, rejected, "n_prompt_turns", "prompt", f"{chosen}_mask", f"{rejected}_mask"}
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.withColumns({a: F.coalesce(F.col(chosen), empty), b: F.coalesce(F.col(rejected), empty)})
    p = p.withColumn(n, common_turns(F.col(a), F.col(b)))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col(n) + 1, F.greatest(F.size(side) - F.col(n), F.lit(0)))

    p = p.withColumn("prompt", render(F.slice(F.col(a), F.lit(1), F.col(n))))
    p = p.withColumns({a: rest(a), b: rest(b)})
    return p.select(
        *[F.col(f"`{c}`") for c in pairs.columns if c not in made],
        F.col(n).alias("n_prompt_turns"), "prompt",
        render(F.col(a)).alias(chosen), render(F.col(b)).alias(rejected),
        answer_spans(F.col(a)).alias(f"{chosen}_mask"), answer_spans(F.col(b)).alias(f"{rejected}_mask"))


def _spans_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(
        "-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def borrowed_pairs(convs: DataFrame) -> DataFrame:
    """Pairs from conversations that have no ratings: the chosen side is the
    conversation up to its last answer, the rejected side gives the last
    answer of the conversation with the next id (none: an empty answer)."""
    where = F.transform("turns", lambda t: t["role"] == ANSWER)
    last = F.size("turns") - F.array_position(F.reverse(where), True).cast("int") + 1
    cut = convs.withColumn("n", F.when(F.array_contains(where, True), last).otherwise(0))
    cut = cut.withColumn("answer", F.when(F.col("n") > 0, F.element_at("turns", F.col("n"))["text"]))
    other = cut.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("wrong"))
    wrong = F.array(F.struct(F.lit(ANSWER).alias("role"), F.coalesce("wrong", F.lit("")).alias("text")))
    before = F.slice("turns", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))
    return cut.join(other, "conv_id", "left").select(
        "conv_id", F.slice("turns", F.lit(1), F.col("n")).alias("chosen"),
        F.when(F.col("n") > 0, F.concat(before, wrong)).otherwise(before).alias("rejected"))


def op5_chat_preferences(spark, sf_dir: str) -> DataFrame:
    """Pairs of the whole ``conversations`` table."""
    pairs = borrowed_pairs(conversations(table(spark, sf_dir, "conversations")))
    out = format_preferences(pairs)
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected",
                      _spans_text("chosen_mask").alias("chosen_mask"),
                      _spans_text("rejected_mask").alias("rejected_mask"))


def _side(name: str, turns: str) -> str:
    return f"""
{name} AS (
  SELECT conv_id, i, '<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) AS head,
         replace(t.text, '<|', '< |') || '<|im_end|>' AS body, t.role AS role
  FROM (SELECT conv_id, unnest(range(n + 1, len({turns}) + 1)) AS i, {turns} AS ts,
               {turns}[unnest(range(n + 1, len({turns}) + 1))] AS t FROM lcp) x),
{name}_at AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
           PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(head) AS s FROM {name}),
{name}_out AS (
  SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY i) AS txt,
         string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY i)
           FILTER (WHERE role = 'assistant') AS mask
  FROM {name}_at GROUP BY conv_id)"""


OP5_SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
              FROM conversations WHERE conv_id IS NOT NULL),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM rows),
lst AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS n FROM pos GROUP BY conv_id),
ans AS (SELECT l.conv_id, l.n, p.text FROM lst l LEFT JOIN pos p ON p.conv_id = l.conv_id AND p.i = l.n),
a AS (SELECT l.conv_id, list({{'role': p.role, 'text': p.text}} ORDER BY p.i) FILTER (WHERE p.i <= l.n) AS ch,
             list({{'role': p.role, 'text': p.text}} ORDER BY p.i) FILTER (WHERE p.i < l.n) AS before,
             any_value(l.n) AS last
      FROM lst l JOIN pos p ON p.conv_id = l.conv_id GROUP BY l.conv_id),
pair AS (
  SELECT a.conv_id, coalesce(a.ch, []) AS ch,
         CASE WHEN a.last > 0 THEN list_concat(coalesce(a.before, []),
           [{{'role': 'assistant', 'text': coalesce(o.text, '')}}]) ELSE coalesce(a.before, []) END AS re
  FROM a LEFT JOIN ans o ON o.conv_id = a.conv_id + 1),
lcp AS (
  SELECT *, CAST(coalesce(list_position(list_transform(range(1, greatest(len(ch), len(re)) + 1),
           lambda k: coalesce(ch[k].role = re[k].role AND ch[k].text = re[k].text, false)), false) - 1,
           greatest(len(ch), len(re))) AS INTEGER) AS n FROM pair),
{_side('c', 'ch')},
{_side('r', 're')}
SELECT l.conv_id, l.n AS n_prompt_turns,
       array_to_string(list_transform(l.ch[1:l.n], lambda t: '<|im_start|>' || replace(t.role, '<|', '< |')
         || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS prompt,
       coalesce(c.txt, '') AS chosen, coalesce(r.txt, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM lcp l LEFT JOIN c_out c ON c.conv_id = l.conv_id LEFT JOIN r_out r ON r.conv_id = l.conv_id"""
