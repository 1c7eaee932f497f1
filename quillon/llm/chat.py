"""Multi-party perspective rotation: each participant in turn is the assistant.

Only DataFrame expressions are used. A conversation is rendered in parts of at
most ``span`` consecutive turn numbers, so a conversation of any length is spread
over tasks; the parts of a perspective, joined in order, are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 256


def rotate_perspectives(turns: DataFrame, context: tuple[str, ...] = ("system",), span: int = SPAN) -> DataFrame:
    """One row per conversation, participant and part: (conv_id, perspective, part, n_turns, rendered, mask, n_masked).

    Messages read ``<|system|>``, ``<|assistant|>`` or ``<|user name=NAME|>``, a
    newline, the text, ``<|end|>`` and a newline. Roles of ``context`` are no
    participants and stay system messages. ``mask`` lists start:end (code points,
    end exclusive) of what the assistant said, with its end mark; ``n_masked`` is
    their length. In texts and names ``<|`` becomes ``< |``, so that no text can pose as
    a mark. A null conv_id is one conversation; a null role is the participant
    ``unknown``, a null turn comes first in part -1, a null text is empty; equal
    turns go by role and text, and repeated rows are repeated. A conversation of
    context alone has no row. Other columns are not read.
    """
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / span), F.lit(-1)).cast("long").alias("part"),
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    speakers = rows.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    head = lambda x: (
        F.when(x["role"].isin(*context), F.lit("<|system|>\n"))
        .when(x["role"] == F.col("perspective"), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), plain(x["role"]), F.lit("|>\n")))
    )
    said = seen.withColumn("said", F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), (x["role"] == F.col("perspective")).alias("own"))))
    spans = F.aggregate(
        "said",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["own"], F.array_append(a["out"], F.concat_ws(":", a["at"] + F.length(x["head"]), a["at"] + F.length(x["head"]) + F.length(x["body"]) - 1))).otherwise(a["out"]).alias("out"),
            (a["n"] + F.when(x["own"], F.length(x["body"]) - 1).otherwise(0)).alias("n"),
        ),
    )
    return said.withColumn("s", spans).select(
        "conv_id",
        "perspective",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join("s.out", ",").alias("mask"),
        F.col("s.n").cast("long").alias("n_masked"),
    )


ORACLE = f"""
WITH r AS (
  SELECT conv_id, coalesce(turn // {SPAN}, -1)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
m AS (
  SELECT r.conv_id, perspective, part, turn, role, text, role = perspective AS own,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
              WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head,
         text || '<|end|>' || chr(10) AS body
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, row_number() OVER w AS k,
         coalesce(sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM m WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY k) AS rendered,
       coalesce(string_agg((off + length(head))::VARCHAR || ':' || (off + length(head) + length(body) - 1)::VARCHAR, ',' ORDER BY k) FILTER (own), '') AS mask,
       coalesce(sum(length(body) - 1) FILTER (own), 0)::BIGINT AS n_masked
FROM o GROUP BY conv_id, perspective, part
"""
