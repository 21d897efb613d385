"""Chat formatting: one rendering of a dialogue for every participant.

Every speaker of a conversation (each distinct role but ``system``) becomes the
assistant once; the others become named users and system turns stay system
turns. A turn renders as ``<|role|>`` or ``<|role name=...|>``, a line end, the
text, ``<|end|>`` and a line end. The mask lists the character spans (from 0,
end exclusive, within the row's text) of the assistant's texts with their end
marks: what a loss would be taken over.

A rendering comes in segments of ``SEGMENT`` turn numbers, so that a
conversation of any length is spread over rows and no task gathers more than a
segment; segments of a rendering concatenate to the whole. Only DataFrame
functions are used. Turns meet their conversation's speakers in an equi-join,
whose hot keys adaptive execution splits; the speakers are aggregated first.

Defined cases: null texts render as empty ones; turns with a null conversation,
turn or role are left out (they have no place in a dialogue); equal turn
numbers are ordered by role, then text, and repeated rows stay repeated; a
conversation of system turns only has no rendering; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

SEGMENT = 32


def render(conversations: DataFrame, segment: int = SEGMENT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, segment, n_turns, n_trained, trained_chars, mask, rendered)."""
    turns = pick(conversations, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null and role is not null")
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))
    speakers = turns.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    rotated = turns.join(speakers, "conv_id").select(
        "conv_id", "perspective", F.floor(F.col("turn") / segment).cast("long").alias("segment"), "turn", "role", own.alias("own"), head.alias("head"), F.concat("text", F.lit("<|end|>")).alias("body")
    )
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "own", "head")))
    parts = rotated.groupBy("conv_id", "perspective", "segment").agg(messages.alias("m"))
    rendered = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + 1
    # one fold: the place so far, and the spans of the assistant's bodies
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))
    span = lambda a, x: F.concat(F.when(a["spans"] == "", "").otherwise(F.concat(a["spans"], F.lit(","))), (a["at"] + F.length(x["head"])).cast("string"), F.lit("-"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).cast("string"))
    fold = F.aggregate("m", start, lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.when(x["own"], span(a, x)).otherwise(a["spans"]).alias("spans")))
    trained = F.filter("m", lambda x: x["own"])
    chars = F.aggregate(trained, F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"]).cast("long"))
    return parts.select(
        "conv_id", "perspective", "segment", F.size("m").cast("long").alias("n_turns"), F.size(trained).cast("long").alias("n_trained"), chars.alias("trained_chars"), fold["spans"].alias("mask"), rendered.alias("rendered")
    )


SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
 speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
 rotated AS (SELECT conv_id, perspective, CAST(floor(turn / {SEGMENT}.0) AS BIGINT) AS segment, turn, role, role = perspective AS own,
   CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
   text || '<|end|>' AS body FROM turns JOIN speakers USING (conv_id)),
 placed AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM rotated)
SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
 CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars,
 coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY a) FILTER (WHERE own), '') AS mask,
 string_agg(head || body || chr(10), '' ORDER BY a) AS rendered
FROM placed GROUP BY conv_id, perspective, segment"""
