"""Tab-separated sources and sinks: record tables, truth lists, id lists, and the checks of an id-list file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in a tab-separated table's first line."""
    head = spark.read.text(path).limit(1).collect()
    return head[0][0].split("\t") if head else []


def read_records(spark: SparkSession, path: str, columns: Sequence[str] = RECORD_COLUMNS, quoting: bool = True, wanted: Sequence[str] | None = None) -> DataFrame:
    """A tab-separated table with a header, all strings; an empty field is the empty string, not null.

    A header that differs from columns raises. Without quoting a quote is an ordinary character. wanted: the columns to
    read; the parser skips the others.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    if header(spark, path) != list(columns):
        raise ValueError(f"{path}: the header is not {', '.join(columns)}")
    reader = spark.read.option("sep", "\t").option("header", "true").option("nullValue", "\u0000").option("emptyValue", "").option("quote", '"' if quoting else "")
    return reader.schema(schema).csv(path).select(*(wanted or columns)).na.fill("")


def split_ids(column: str) -> Column:
    """A comma-joined list as an array; the empty string is the empty array."""
    return F.filter(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)), lambda x: x != "")


def truth_pairs(lists: DataFrame, key: str, ids: str) -> DataFrame:
    """(s1, cand) of a table of id lists."""
    return lists.select(F.col(key).alias("s1"), F.explode(F.array_distinct(split_ids(ids))).alias("cand"))


def write_id_lists(lists: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write rows (s1, ids) as a tab-separated dataset with the header columns."""
    lists.select(F.col("s1").alias(columns[0]), F.coalesce("ids", F.lit("")).alias(columns[1])).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def file_findings(spark: SparkSession, path: str, columns: Sequence[str], entities: DataFrame, candidates: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """findings() of an id-list file, with its bad_header (0 or 1) and malformed_row (lines that have not two fields), and
    with known (cand), every id of the pools, unknown_id. Malformed lines take no part in the other rules."""
    lines = spark.read.text(path).where(F.col("value") != "\t".join(header(spark, path)))
    cells = F.split("value", "\t", -1)
    good = lines.where(F.size(cells) == 2).select(F.get(cells, F.lit(0)).alias("s1"), F.get(cells, F.lit(1)).alias("ids"))
    bad = lines.where(F.size(cells) != 2).agg(F.lit("malformed_row").alias("rule"), F.count(F.lit(1)).alias("n"))
    wrong = int(header(spark, path) != list(columns))
    out = spark.range(1).select(F.lit("bad_header").alias("rule"), F.lit(wrong).cast("long").alias("n")).unionByName(bad).unionByName(findings(good, entities, candidates))
    if known is not None:
        each = good.select(F.explode(split_ids("ids")).alias("cand"))
        out = out.unionByName(each.join(known.select("cand").distinct(), "cand", "left_anti").agg(F.lit("unknown_id").alias("rule"), F.count(F.lit(1)).alias("n")))
    return out


def write_scores(scored: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write scores as Parquet with zstd, sorted by score within a file, so that a floor skips most of it when read."""
    scored.sortWithinPartitions(F.desc("p")).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_scores(spark: SparkSession, path: str, floor: float = 0.0) -> DataFrame:
    """Scores of at least floor; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("p") >= floor)


def findings(lists: DataFrame, entities: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, n) of what is wrong with lists (s1, ids): counts of every rule, 0 included.

    Rules: duplicate_row, missing_row, extra_row, duplicate_id, self_match (an S1 id), wrong_prefix, and with candidates
    (s1, cand) outside_candidates, which is only a warning.
    """
    ids = lists.select("s1", split_ids("ids").alias("ids"))
    rows = lists.groupBy("s1").agg(F.count(F.lit(1)).alias("c"))
    each = ids.select("s1", F.explode("ids").alias("cand"))
    per_row = ids.agg(F.coalesce(F.sum(F.size("ids") - F.size(F.array_distinct("ids"))), F.lit(0)).cast("long").alias("n"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    found = {
        "duplicate_row": rows.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n")),
        "missing_row": count(entities.join(rows, "s1", "left_anti")),
        "extra_row": count(rows.join(entities, "s1", "left_anti")),
        "duplicate_id": per_row,
        "self_match": count(each.where(F.col("cand").startswith("S1-"))),
        "wrong_prefix": count(each.where(~F.col("cand").rlike("^S[123]-"))),
    }
    if candidates is not None:
        found["outside_candidates"] = count(each.join(candidates.select("s1", "cand").distinct(), ["s1", "cand"], "left_anti"))
    out = None
    for rule, df in found.items():
        df = df.select(F.lit(rule).alias("rule"), "n")
        out = df if out is None else out.unionByName(df)
    return out
