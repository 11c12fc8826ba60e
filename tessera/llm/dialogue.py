"""Chat formatting: multi-party perspective rotation, with built-in expressions only.

Each conversation is rendered once for every participant, who speaks as the assistant while the others are named users;
the mask covers what the assistant says. A dialogue's message offsets are prefix sums of rendered lengths. They are made
without gathering a conversation in one task: rows are range-sorted by (conversation, perspective, turn), summed within
each range, and the ranges' totals are summed in turn. A dialogue is then put out in parts of bounded length; all but
very long ones have a single part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

#: A part takes messages that start within so many characters.
PART_CHARS = 1 << 16
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def name_of(role: Column, instruction_role: str) -> Column:
    """The name of a role, one to one; the instruction role's is itself."""
    plain = (role == instruction_role) | (role.rlike(r"^[\p{L}\p{N}_-]+$") & ~role.rlike("_[0-9a-f]{16}$") & (role != "unknown"))
    odd = F.concat(F.regexp_replace(role, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"), F.substring(F.md5(role), 1, 16))
    return F.when(role.isNull(), F.lit("unknown")).when(plain, role).otherwise(odd)


def rotate_perspectives(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    instruction_role: str = "system",
    part_chars: int = PART_CHARS,
    ranges: int | None = None,
) -> DataFrame:
    """Rows (conversation, perspective, part): the rendered text, its offset in the dialogue and the mask's spans.

    A participant is any role of the conversation but instruction_role, whose messages stay instructions and are never
    masked in. A conversation without participants gives no rows. Messages stand in order of turn, null first; ties go
    by role, then text, so repeated rows are repeated messages. A null role is the participant 'unknown', a null text is
    empty, null conversation ids form one conversation. Roles of letters, digits, '_' and '-' are names as they stand; in
    others every other character becomes '_' and 16 digits of the role's MD5 follow, so different roles never share a name
    (roles that look like such a name, and a role 'unknown', are taken so too). A mark within a text is broken by a
    backslash after its '<', of which those that stand there already get one more: texts can forge no turn, and come back
    when one is taken away. mask_spans lists start-end (code points within the part) of each message of the perspective with its closing
    mark, comma-joined; masked_chars is their length. An empty table gives an empty result; other columns do not matter.
    """
    spark = df.sparkSession
    said = df.select(
        F.col(conv_col).alias("d_conv"),
        F.col(turn_col).alias("d_turn"),
        name_of(F.col(role_col), instruction_role).alias("d_role"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<(\\*)\|im_", r"<\\$1|im_").alias("d_text"),
    )
    speakers = said.where(F.col("d_role") != instruction_role).select(F.col("d_conv").alias("p_conv"), F.col("d_role").alias("p_role")).distinct()
    rotated = said.join(speakers, F.col("d_conv").eqNullSafe(F.col("p_conv")))
    own = F.col("d_role") == F.col("p_role")
    head = F.when(own, F.lit("assistant")).when(F.col("d_role") == instruction_role, F.lit(instruction_role)).otherwise(F.concat(F.lit("user name="), F.col("d_role")))
    rotated = rotated.select(
        "d_conv", "p_role", "d_turn", "d_role",
        own.alias("d_own"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("d_head"),
        F.concat(F.col("d_text"), F.lit(CLOSE)).alias("d_body"),
    ).withColumn("d_chars", (F.length("d_head") + F.length("d_body")).cast("long"))
    order = ["d_conv", "p_role", "d_turn", "d_role", "d_body"]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rotated.repartitionByRange(n, *order).withColumn("d_range", F.spark_partition_id()))
    past = Window.partitionBy("t_conv", "t_role").orderBy("t_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(F.col("d_conv").alias("t_conv"), F.col("p_role").alias("t_role"), F.col("d_range").alias("t_range"))
        .agg(F.sum("d_chars").alias("t_chars"), F.count(F.lit(1)).alias("t_rows"))
        .select("t_conv", "t_role", "t_range", F.coalesce(F.sum("t_chars").over(past), F.lit(0)).alias("t_before"), F.coalesce(F.sum("t_rows").over(past), F.lit(0)).alias("t_seen"))
    )
    within = Window.partitionBy("d_conv", "p_role", "d_range").orderBy("d_turn", "d_role", "d_body")
    same = F.col("d_conv").eqNullSafe(F.col("t_conv")) & (F.col("p_role") == F.col("t_role")) & (F.col("d_range") == F.col("t_range"))
    placed = (
        ranged.withColumn("d_sum", F.coalesce(F.sum("d_chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("d_nth", F.row_number().over(within))
        .join(totals, same)
        .withColumn("d_start", F.col("t_before") + F.col("d_sum"))
        .withColumn("d_at", F.col("t_seen") + F.col("d_nth"))
        .withColumn("d_part", F.floor(F.col("d_start") / part_chars))
    )
    message = F.struct("d_at", "d_start", "d_head", "d_body", "d_own")
    parts = placed.groupBy("d_conv", "p_role", "d_part").agg(F.array_sort(F.collect_list(message)).alias("m"))  # PART_CHARS and one message at most
    first = F.col("m")[0]["d_start"]
    spans = F.transform(
        F.filter("m", lambda x: x["d_own"]),
        lambda x: F.concat_ws("-", (x["d_start"] - first + F.length(x["d_head"])).cast("string"), (x["d_start"] - first + F.length(x["d_head"]) + F.length(x["d_body"])).cast("string")),
    )
    return parts.select(
        F.col("d_conv").alias(conv_col),
        F.col("p_role").alias("perspective"),
        F.col("d_part").cast("long").alias("part"),
        F.size("m").cast("long").alias("n_messages"),
        first.cast("long").alias("start"),
        F.array_join(F.transform("m", lambda x: F.concat(x["d_head"], x["d_body"])), "").alias("dialogue"),
        F.array_join(spans, ",").alias("mask_spans"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(x["d_own"], F.length(x["d_body"])).otherwise(0)).alias("masked_chars"),
    )


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'unknown'
           WHEN role = 'system' OR (regexp_full_match(role, '[\\p{L}\\p{N}_-]+') AND NOT regexp_matches(role, '_[0-9a-f]{16}$') AND role <> 'unknown') THEN role
           ELSE regexp_replace(role, '[^\\p{L}\\p{N}_-]', '_', 'g') || '_' || substr(md5(role), 1, 16) END AS role,
         regexp_replace(coalesce(text, ''), '<(\\\\*)\\|im_', '<\\\\\\1|im_', 'g') AS text
  FROM {conversations}),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
rotated AS (
  SELECT s.conv_id, p.perspective, s.turn, s.role, s.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system'
                                ELSE 'user name=' || s.role END || chr(10) AS head,
         s.text || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, body) AS nth FROM rotated),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY nth
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM ranked),
parted AS (SELECT *, start // 65536 AS part, min(start) OVER (PARTITION BY conv_id, perspective, start // 65536) AS base FROM placed)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::BIGINT AS n_messages, min(base)::BIGINT AS start,
       string_agg(head || body, '' ORDER BY nth) AS dialogue,
       coalesce(string_agg((start - base + length(head))::VARCHAR || '-' || (start - base + length(head) + length(body))::VARCHAR, ','
                           ORDER BY nth) FILTER (own), '') AS mask_spans,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS masked_chars
FROM parted GROUP BY conv_id, perspective, part
"""
