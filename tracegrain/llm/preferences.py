"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common turn prefix of the two is rendered once, as the prompt; what follows in each is its completion. Every
turn reads <|im_start|>role, a line break, the text, <|im_end|> and a line break. A mask lists the code points of a
completion ("start:end,...", end exclusive) that count for the loss: the text and end mark of assistant turns.

Edge cases: rows without conv_id belong to no conversation and are left out; a null text is empty, a null role `unknown`,
a null turn comes first; rows of one turn go by role and text, and repeated rows count once. A start or end mark inside a
text is broken by a space, so that no text can open or close a turn. Equal conversations have empty completions. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which conversations with one first turn are paired, before what is left over is paired across parts.
PARTS = 64


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns, in order, as an array of role and text."""
    safe = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|im_"), F.lit("<| im_"))
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), safe("role", "unknown").alias("role"), safe("text", "").alias("text"))
    ordered = F.sort_array(F.collect_set(turn))  # nulls first
    keyed = rows.filter("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(ordered.alias("turns"))
    return keyed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of assistant turns in the rendered turns: the text and its end mark, without the line break after it."""
    head, end, line = len("<|im_start|>") + 1, len("<|im_end|>"), 1
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        first = state["at"] + head + F.char_length(t["role"])
        last = first + F.char_length(t["text"]) + end
        span = F.concat(first.cast("string"), F.lit(":"), last.cast("string"))
        return F.struct((last + line).cast("bigint").alias("at"), F.when(t["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: F.array_join(state["spans"], ","))


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs (chosen_id, rejected_id, chosen, rejected: arrays of turns) to prompt and masked completions.

    Without a rejected conversation, the prompt is what comes before the last assistant turn, or all if there is none.
    """
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, least), F.slice("rejected", 1, least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differ = F.array_position(same, F.lit(False))
    alone = F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == "assistant", i)))
    common = F.when(F.col("rejected").isNull(), F.coalesce(alone, F.size("chosen"))).when(differ > 0, differ - 1).otherwise(least).cast("int")
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.size(side))
    return pairs.withColumn("n_common", common).select(
        "chosen_id", "rejected_id", F.col("n_common").cast("bigint").alias("n_common"), _rendered(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"), _rendered(rest("rejected")).alias("rejected"), _mask(rest("chosen")).alias("chosen_mask"), _mask(rest("rejected")).alias("rejected_mask"),
    )


def paired(ids: DataFrame) -> DataFrame:
    """ids (conv_id, first) to (chosen_id, rejected_id): conversations with equal `first` are paired in order of conv_id.

    First within PARTS parts by conv_id, then what each part leaves over; so no task gets all of a common first turn.
    Each conversation comes once; the last of an odd number has no rejected_id.
    """

    def step(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy(*keys).orderBy("conv_id")
        both = df.select("*", F.row_number().over(w).alias("r"), F.lead("conv_id").over(w).alias("next")).filter("r % 2 = 1")
        return both.filter("next is not null").select(F.col("conv_id").alias("chosen_id"), F.col("next").alias("rejected_id")), both.filter("next is null").select("conv_id", "first")

    pairs, left = step(ids.withColumn("part", F.pmod("conv_id", F.lit(PARTS))), "first", "part")
    more, single = step(left, "first")
    return pairs.unionByName(more).unionByName(single.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("bigint").alias("rejected_id")))


def preferences(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text): pairs conversations that open with the same turn and formats them."""
    convs = conversations(rows)
    first = F.sha2(F.concat_ws("\n", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)
    pairs = paired(convs.select("conv_id", first.alias("first")))
    side = lambda s: convs.select(F.col("conv_id").alias(f"{s}_id"), F.col("turns").alias(s))
    whole = pairs.filter("rejected_id is not null").join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")
    # conversations without another side stay out of that join, where their null would bring all of them to one task
    alone = pairs.filter("rejected_id is null").join(side("chosen"), "chosen_id").withColumn("rejected", F.lit(None).cast(convs.schema["turns"].dataType))
    return formatted(whole.unionByName(alone))


def op5_preferences(spark, sf_dir: str) -> DataFrame:
    return preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') AS role,
               replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS size, max(CASE WHEN role = 'assistant' THEN pos END) AS last_assistant,
         max(CASE WHEN pos = 0 THEN role || chr(10) || text END) AS first FROM t GROUP BY conv_id
), one AS (
  SELECT conv_id, first, row_number() OVER w AS r, lead(conv_id) OVER w AS nxt FROM c
  WINDOW w AS (PARTITION BY first, conv_id % 64 ORDER BY conv_id)
), two AS (
  SELECT conv_id, row_number() OVER w AS r, lead(conv_id) OVER w AS nxt FROM one WHERE r % 2 = 1 AND nxt IS NULL
  WINDOW w AS (PARTITION BY first ORDER BY conv_id)
), p AS (
  SELECT conv_id AS chosen_id, nxt AS rejected_id FROM one WHERE r % 2 = 1 AND nxt IS NOT NULL
  UNION ALL SELECT conv_id, nxt FROM two WHERE r % 2 = 1
), d AS (
  SELECT p.chosen_id, min(a.pos) AS differ FROM p JOIN t a ON a.conv_id = p.chosen_id
  JOIN t b ON b.conv_id = p.rejected_id AND b.pos = a.pos WHERE a.role <> b.role OR a.text <> b.text GROUP BY p.chosen_id
), n AS (
  SELECT p.chosen_id, p.rejected_id,
         CASE WHEN p.rejected_id IS NULL THEN coalesce(x.last_assistant, x.size) ELSE coalesce(d.differ, least(x.size, y.size)) END AS n_common
  FROM p JOIN c x ON x.conv_id = p.chosen_id LEFT JOIN c y ON y.conv_id = p.rejected_id LEFT JOIN d ON d.chosen_id = p.chosen_id
), s AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t
), chosen AS (
  SELECT n.chosen_id, string_agg(CASE WHEN s.pos < n.n_common THEN line END, '' ORDER BY s.pos) AS prompt,
         string_agg(CASE WHEN s.pos >= n.n_common THEN line END, '' ORDER BY s.pos) AS body
  FROM n JOIN s ON s.conv_id = n.chosen_id GROUP BY n.chosen_id
), rejected AS (
  SELECT n.chosen_id, string_agg(CASE WHEN s.pos >= n.n_common THEN line END, '' ORDER BY s.pos) AS body
  FROM n JOIN s ON s.conv_id = n.rejected_id GROUP BY n.chosen_id
), placed AS (
  SELECT side, chosen_id, role, text, pos, sum(length(line)) OVER (PARTITION BY side, chosen_id ORDER BY pos) - length(line) AS start
  FROM (SELECT 'c' AS side, n.chosen_id, s.* FROM n JOIN s ON s.conv_id = n.chosen_id WHERE s.pos >= n.n_common
        UNION ALL SELECT 'r', n.chosen_id, s.* FROM n JOIN s ON s.conv_id = n.rejected_id WHERE s.pos >= n.n_common)
), masks AS (
  SELECT side, chosen_id, string_agg(CAST(CAST(start + 13 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + 23 + length(role) + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS mask
  FROM placed WHERE role = 'assistant' GROUP BY side, chosen_id
)
SELECT n.chosen_id, n.rejected_id, CAST(n.n_common AS BIGINT) AS n_common, coalesce(chosen.prompt, '') AS prompt, coalesce(chosen.body, '') AS chosen,
       CASE WHEN n.rejected_id IS NOT NULL THEN coalesce(rejected.body, '') END AS rejected, coalesce(mc.mask, '') AS chosen_mask,
       CASE WHEN n.rejected_id IS NOT NULL THEN coalesce(mr.mask, '') END AS rejected_mask
FROM n LEFT JOIN chosen USING (chosen_id) LEFT JOIN rejected USING (chosen_id)
LEFT JOIN masks mc ON mc.chosen_id = n.chosen_id AND mc.side = 'c' LEFT JOIN masks mr ON mr.chosen_id = n.chosen_id AND mr.side = 'r'
"""
