"""Dialogues from the view of each participant (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one rendered part; a dialogue of any length is a row per so many turns.
PART_TURNS = 64
#: The markers of the rendered text.
ASSISTANT, USER_OPEN, USER_CLOSE, END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
NOBODY = "unknown"


def in_order(messages: DataFrame, conv: str, turn: str, role: str, text: str, span: int) -> DataFrame:
    """Messages as (conv, at, speaker, said), numbered from 0 within their dialogue.

    Order: turn (nulls first), two digits of a hash, speaker, text. Counts of stretches of turns are added
    up first, then counts within a stretch, so that no task sorts a dialogue of any size.
    """
    speaker, said = F.coalesce(F.col(role).cast("string"), F.lit(NOBODY)), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), speaker.alias("speaker"), said.alias("said"))
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / span))
    rows = rows.withColumn("tie", F.substring(F.md5(F.concat_ws("\x1f", "speaker", "said")), 1, 2))
    small = rows.groupBy("conv", "stretch", "turn", "tie").agg(F.count(F.lit(1)).alias("n"))
    before = lambda keys, order: (
        Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    small = small.withColumn("inside", F.coalesce(F.sum("n").over(before(["conv", "stretch"], ["turn", "tie"])), F.lit(0)))
    large = small.groupBy("conv", "stretch").agg(F.sum("n").alias("n"))
    large = large.withColumn("outside", F.coalesce(F.sum("n").over(before(["conv"], ["stretch"])), F.lit(0)))
    starts = _joined(small, large.drop("n"), ["conv", "stretch"])
    starts = starts.select("conv", "turn", "tie", (F.col("inside") + F.col("outside")).alias("start"))
    within = Window.partitionBy("conv", "turn", "tie").orderBy("speaker", "said")
    rows = rows.drop("stretch").withColumn("nth", F.row_number().over(within) - 1)
    rows = _joined(rows, starts, ["conv", "turn", "tie"])
    return rows.select("conv", (F.col("start") + F.col("nth")).alias("at"), "speaker", "said")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return left.join(right, on).drop(*(f"_{k}" for k in keys))


def _rendered(message: Column, view: Column) -> Column:
    other = F.concat(F.lit(USER_OPEN), message["speaker"], F.lit(USER_CLOSE))
    return F.concat(F.when(message["speaker"] == view, F.lit(ASSISTANT)).otherwise(other), message["said"], F.lit(END))


def _targets(messages: Column, view: Column) -> Column:
    """Stretches of the rendered text that the view's speaker wrote, each with its end marker."""
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def add(state, message):
        end = state["upto"] + F.length(_rendered(message, view))
        own = F.struct((state["upto"] + len(ASSISTANT)).alias("first"), end.alias("last"))
        found = F.when(message["speaker"] == view, F.concat(state["found"], F.array(own))).otherwise(state["found"])
        return F.struct(end.alias("upto"), found.alias("found"))

    return F.aggregate(messages, empty, add)["found"]


def rotate(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Every dialogue once per participant, with that speaker as assistant and the others as named users.

    Returns per dialogue, perspective and part of ``part_turns`` turns: conv, perspective, part (from 0),
    n_turns, text, targets ("first-last" characters of the text that count for the loss, last excluded, joined
    by ";"), n_target_chars. Parts in order make up the dialogue. A null speaker is "unknown", a null text is
    empty, null turns come first, rows of a null dialogue are one dialogue; tied and repeated turns are all
    rendered, in a fixed order; an empty table gives none; other columns are not read.
    """
    rows = in_order(messages, conv, turn, role, text, part_turns)
    part = F.floor(F.col("at") / part_turns).cast("int")
    people = rows.select("conv", F.col("speaker").alias("perspective")).distinct()
    parts = rows.groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "speaker", "said"))).alias("m"))
    both = _joined(parts, people, ["conv"])
    view = F.col("perspective")
    both = both.withColumn("spans", _targets(F.col("m"), view))
    size = F.aggregate("spans", F.lit(0), lambda total, s: total + s["last"] - s["first"])
    return both.select(
        F.col("conv").alias(conv),
        "perspective",
        "part",
        F.size("m").alias("n_turns"),
        F.array_join(F.transform("m", lambda x: _rendered(x, view)), "").alias("text"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ";").alias("targets"),
        size.alias("n_target_chars"),
    )


#: The same for DuckDB, over the whole table.
ROTATE_SQL = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS said FROM conversations
), placed AS (
    SELECT conv_id, speaker, said, row_number() OVER (
        PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, substr(md5(speaker || chr(31) || said), 1, 2), speaker, said) - 1 AS place
    FROM said
), people AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM said
), lines AS (
    SELECT p.conv_id, q.perspective, p.place, p.place // {PART_TURNS} AS part, p.speaker = q.perspective AS own,
        CASE WHEN p.speaker = q.perspective THEN '<|assistant|>' || chr(10)
             ELSE '<|user name=' || p.speaker || '|>' || chr(10) END || p.said || '<|end|>' || chr(10) AS line
    FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), spans AS (
    SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) AS upto FROM lines
)
SELECT conv_id, perspective, CAST(part AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_turns,
    string_agg(line, '' ORDER BY place) AS text,
    coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(line) + {len(ASSISTANT)} AS VARCHAR) || '-' || CAST(upto AS VARCHAR) END, ';' ORDER BY place), '') AS targets,
    CAST(coalesce(sum(CASE WHEN own THEN length(line) - {len(ASSISTANT)} END), 0) AS INTEGER) AS n_target_chars
FROM spans GROUP BY conv_id, perspective, part
"""
