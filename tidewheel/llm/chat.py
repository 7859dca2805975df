"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as
the assistant and all others as named users; the mask covers what the assistant says.
Turns with the role ``system`` are instructions in every rendering and no participant.

A turn is rendered as ``<|im_start|>HEAD\\nTEXT<|im_end|>\\n``, where HEAD is ``system``,
``assistant`` or ``user name=SPEAKER``.  ``<|`` within a text or name is written ``<\\|``, so
markers can't be forged.  The mask spans cover TEXT and ``<|im_end|>`` of the assistant's
turns, in code points of the rendering.

Turns stand in the order of (turn, role, text).  A null role is the participant
``unknown``, a null text is empty, a null turn comes first.  Repeated rows are turns of their own.
A null conv_id is one conversation.  A conversation with more than ``part_turns`` turn numbers gives
a row for each stretch of them, so that no task gathers a dialogue of any length;
the parts in order make up the whole.  No participants, no rows.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 1024
SYSTEM = "system"


def rotate(turns: DataFrame, *, speaker: str = "role", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_assistant, rendered, turn_mask, spans of every conversation and participant.

    turn_mask: 0 or 1 for each turn.  spans: array of (start, end) in code points of ``rendered``.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("ckey"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long"))
    # speakers meet the turns part by part, so that a long conversation is many groups of the join, too
    each = t.groupBy("ckey", "part", "who").count().select("ckey", "part", "who")
    who = each.filter(F.col("who") != SYSTEM).select("ckey", F.col("who").alias("speaker")).distinct()
    who = each.select("ckey", "part").distinct().join(who, "ckey").groupBy("ckey", "part").agg(F.collect_list("speaker").alias("speakers"))
    t = t.join(who, ["ckey", "part"]).withColumn("speaker", F.explode("speakers"))
    mine = F.col("who") == F.col("speaker")
    head = F.when(F.col("who") == SYSTEM, F.lit(SYSTEM)).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), safe(F.col("who"))))
    opening = F.concat(F.lit("<|im_start|>"), head, F.lit("\n"))
    body = F.concat(safe(F.col("text")), F.lit("<|im_end|>"))
    t = t.select("ckey", "part", "speaker", "conv_id", "turn", "who", "text", mine.alias("mine"), opening.alias("opening"), body.alias("body"))
    order = W.partitionBy("ckey", "part", "speaker").orderBy("turn", "who", "text").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("end", F.sum(F.length("opening") + F.length("body") + 1).over(order) - 1)
    t = t.withColumn("i", F.row_number().over(W.partitionBy("ckey", "part", "speaker").orderBy("turn", "who", "text")))
    row = F.struct("i", F.concat("opening", "body", F.lit("\n")).alias("line"), "mine", (F.col("end") - F.length("body")).alias("start"), "end")
    g = t.groupBy("ckey", "part", "speaker").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select(
        "conv_id",
        "speaker",
        "part",
        F.size("rows").cast("long").alias("n_turns"),
        F.size(F.filter("rows", lambda r: r["mine"])).cast("long").alias("n_assistant"),
        F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("rendered"),
        F.array_join(F.transform("rows", lambda r: r["mine"].cast("int").cast("string")), "").alias("turn_mask"),
        F.transform(F.filter("rows", lambda r: r["mine"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
    )


def with_text_spans(rotated: DataFrame) -> DataFrame:
    """``rotate``'s rows with spans as text: start-end, joined by commas."""
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return rotated.withColumn("spans", F.array_join(spans, ","))


ROTATE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text,
         CAST(coalesce(floor(turn / 1024), 0) AS BIGINT) AS part
  FROM conversations
), s AS (
  SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'
), r AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.who, t.text, t.who = s.speaker AS mine,
         '<|im_start|>' || CASE WHEN t.who = 'system' THEN 'system' WHEN t.who = s.speaker THEN 'assistant'
           ELSE 'user name=' || replace(t.who, '<|', '<\|') END || chr(10) AS opening,
         replace(t.text, '<|', '<\|') || '<|im_end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, row_number() OVER w AS i,
         sum(length(opening) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS stop
  FROM r WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, who, text)
)
SELECT conv_id, speaker, part, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(CASE WHEN mine THEN 1 ELSE 0 END) AS BIGINT) AS n_assistant,
       string_agg(opening || body || chr(10), '' ORDER BY i) AS rendered,
       string_agg(CASE WHEN mine THEN '1' ELSE '0' END, '' ORDER BY i) AS turn_mask,
       coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY i)
         FILTER (WHERE mine), '') AS spans
FROM o GROUP BY conv_id, speaker, part
"""
