"""Records: the three source tables as one, with name and address tokens and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def records_of_documents(docs: DataFrame) -> DataFrame:
    """A linkage view of documents: doc_id mod 3 names the source, words 1-8 the name, all others the
    address, lang the country."""
    words, first = tokens(F.col("text")), tokens(F.col("text"), 8)  # who reads names alone need not split whole texts
    base = docs.where("doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("country"), (F.col("doc_id") % 3).cast("int").alias("role"), words.alias("t"), first.alias("name_tokens"))
    return base.select(
        F.concat(F.get(F.array(F.lit("S1-"), F.lit("S2-"), F.lit("S3-")), F.col("role")), F.col("doc_id").cast("string")).alias("entity_id"),
        "doc_id",
        "country",
        F.concat(F.lit("S"), (F.col("role") + 1).cast("string")).alias("source"),
        "name_tokens",
        F.slice("t", F.lit(9), F.greatest(F.size("t"), F.lit(1))).alias("addr_tokens"),
    ).withColumns({"name_key": F.array_join("name_tokens", " "), "addr_key": F.array_join("addr_tokens", " ")})


RECS = """recs AS (
  SELECT ['S1-', 'S2-', 'S3-'][doc_id % 3 + 1] || doc_id::VARCHAR AS entity_id, doc_id, country, 'S' || (doc_id % 3 + 1)::VARCHAR AS source,
         t[1:8] AS name_tokens, t[9:] AS addr_tokens, array_to_string(t[1:8], ' ') AS name_key, array_to_string(t[9:], ' ') AS addr_key
  FROM (SELECT doc_id, coalesce(lang, '') AS country,
               list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t
        FROM documents WHERE doc_id IS NOT NULL))"""
