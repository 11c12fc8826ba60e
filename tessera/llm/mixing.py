"""Mixing sources to target weights, with built-in expressions only.

Every row gets a hash-random key. Within a source the rows are ranged by that key into about sqrt(rows) buckets, whose
token sums are prefix-summed; within a bucket a window sums the rest. So a source that holds a third of all rows is cut
at its exact budget by many tasks, none of which sees more than about sqrt(rows of the source) rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Up to this many sources, their totals (some 60 bytes each) are broadcast; beyond it Spark chooses the join.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(ident: Column, text: Column, seed: int) -> Column:
    """60 hash bits of the id, or of the text where there is none, the same on every run and engine."""
    name = F.coalesce(ident.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(
    totals: DataFrame,
    weights: Sequence[float] | Mapping[str | None, float] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2.0,
) -> DataFrame:
    """Targets of (mix_source, source_size) rows: share x all sizes by weight, none above most_epochs x its source.

    The excess of a capped source goes to the others by weight until none is above its cap: with sources ranked by
    cap / weight that is the first water level that does not reach the next cap, one pass instead of rounds. A sequence
    of weights repeats over the sources in code-point order, null last; a mapping names them (absent: weight 0).
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    if isinstance(weights, Mapping):
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weighed = totals.withColumn("mix_weight", weight)
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        weighed = totals.withColumn("mix_weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")))
    cap = F.lit(float(most_epochs)) * F.col("source_size")
    level_order = Window.orderBy(F.col("mix_ratio"), F.col("mix_source").asc_nulls_last())
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = level_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    return (
        weighed.withColumn("mix_ratio", F.when(F.col("mix_weight") > 0, cap / F.col("mix_weight")).otherwise(F.lit(float("inf"))))
        .withColumn("mix_capped", F.coalesce(F.sum(F.when(F.col("mix_weight") > 0, cap)).over(before), F.lit(0.0)))
        .withColumn("mix_open", F.sum("mix_weight").over(rest))
        .withColumn("mix_all", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("mix_level", F.when(F.col("mix_open") > 0, (F.lit(float(share)) * F.col("mix_all") - F.col("mix_capped")) / F.col("mix_open")))
        .withColumn("mix_at", F.row_number().over(level_order))
        .withColumn("mix_first", F.min(F.when(F.col("mix_level") <= F.col("mix_ratio"), F.col("mix_at"))).over(everywhere))
        .withColumn("mix_water", F.max(F.when(F.col("mix_at") == F.col("mix_first"), F.col("mix_level"))).over(everywhere))
        .withColumn(
            "target",
            F.when(F.col("mix_weight") <= 0, F.lit(0.0))
            .when(F.col("mix_first").isNull() | (F.col("mix_at") < F.col("mix_first")), cap)
            .otherwise(F.col("mix_weight") * F.col("mix_water")),
        )
        .drop("mix_ratio", "mix_capped", "mix_open", "mix_all", "mix_level", "mix_at", "mix_first", "mix_water")
    )


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] | Mapping[str | None, float] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How many words of each row a mix takes: id, source, size, source_size, target, mix_weight, taken and copies.

    A source's budget is its target rounded to words. Whole epochs of the source come first; the rest is cut in the
    order of the rows' random keys at the exact word, so that one row at most is taken in part.

    Null text or text without words: size 0, taken 0. A null source is a source of its own. Rows without an id take
    their key from the text. Ties of key are ordered by id, then size; repeated rows count as often as they stand. An empty table gives an empty
    result. Other columns of df do not matter, whatever their names.
    """
    sized = durable(
        df.select(
            F.col(id_col).alias("mix_id"),
            F.col(source_col).alias("mix_source"),
            word_count(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), F.col(text_col), seed).alias("mix_key"),
        )
    )
    totals = sized.groupBy("mix_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("mix_rows"))
    targets = durable(source_targets(totals, weights, share, most_epochs))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    budget = F.floor(F.col("target") + F.lit(0.5))
    buckets = F.ceil(F.sqrt(F.col("mix_rows").cast("double")))
    t = targets.select(
        F.col("mix_source").alias("t_source"),
        "source_size",
        "target",
        "mix_weight",
        buckets.alias("mix_buckets"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("mix_whole"),
        budget.cast("long").alias("mix_budget"),
    )
    rows = sized.join(t, F.col("mix_source").eqNullSafe(F.col("t_source"))).withColumn(
        "mix_bucket", F.floor(F.col("mix_key") / F.lit(float(1 << KEY_BITS)) * F.col("mix_buckets")).cast("long")
    )
    along = Window.partitionBy("o_source").orderBy("o_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(F.col("mix_source").alias("o_source"), F.col("mix_bucket").alias("o_bucket"))
        .agg(F.sum("size").alias("o_size"))
        .withColumn("mix_offset", F.coalesce(F.sum("o_size").over(along), F.lit(0)))
        .drop("o_size")
    )
    within = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "mix_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, F.col("mix_source").eqNullSafe(F.col("o_source")) & (F.col("mix_bucket") == F.col("o_bucket")))
    start = F.col("mix_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    left = F.col("mix_budget") - F.col("mix_whole") * F.col("source_size")
    return placed.withColumn("mix_start", start).select(
        F.col("mix_id").alias(id_col),
        F.col("mix_source").alias(source_col),
        "size",
        "source_size",
        "target",
        "mix_weight",
        (F.col("mix_whole") * F.col("size") + F.least(F.greatest(left - F.col("mix_start"), F.lit(0)), F.col("size"))).cast("long").alias("taken"),
        (F.col("mix_whole") + ((F.col("size") > 0) & (F.col("mix_start") < left)).cast("long")).alias("copies"),
    )


def mixed_rows(df: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = (3, 1, 2), share: float = 1.5, most_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of df as often as the mix takes it, with df's columns.

    The row at a source's cut is taken whole, so a source exceeds its budget by less than one row. Rows of one id share
    the most copies of any of them. Rows without words are kept as often as their source's whole epochs.
    """
    plan = mix_sources(df, weights, share, most_epochs, seed, id_col, source_col, text_col)
    copies = plan.groupBy(F.col(id_col).alias("c_id")).agg(F.max("copies").alias("c_copies")).where("c_copies > 0")
    rows = df.select(F.col(id_col).alias("m_id"), F.struct(*[F.col(c) for c in df.columns]).alias("m_row"))
    taken = rows.join(copies, F.col("m_id").eqNullSafe(F.col("c_id")))
    return taken.select("m_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c_copies"))).alias("m_copy")).select("m_row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS k
  FROM {documents}),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER o AS i, 2.0::DOUBLE * source_size / w AS r,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)),
water AS (SELECT min(i) AS i0, arg_min(level, i) AS water_level FROM ranked WHERE level <= r),
targets AS (
  SELECT source, source_size, CASE WHEN i < i0 THEN 2.0::DOUBLE * source_size ELSE w * water_level END AS target
  FROM ranked, water),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target + 0.5::DOUBLE)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT ELSE
       ((budget // source_size) * size
        + least(greatest(budget - (budget // source_size) * source_size - start, 0), size))::BIGINT END AS taken
FROM placed
"""
