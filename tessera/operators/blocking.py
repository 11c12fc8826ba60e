"""Candidate generation: similarity joins over weighted token postings, exact keys, pruning.

A posting is (country, source, token, entity); tokens above max_df are left out. Records are scored in blocks (topk.py),
which give the best lists of both sides without a row for each shared token or pair.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import topk
from tessera.operators.records import RECS
from tessera.operators.topk import Block, Weigh, block_numbers
from tessera.session import durable


def bag() -> Column:
    """Distinct tokens of a record: n: name words of 2 letters and more, a: address words of 2 and more or with digits."""
    name = F.transform(F.filter("name_tokens", lambda t: F.length(t) >= 2), lambda t: F.concat(F.lit("n:"), t))
    addr = F.transform(F.filter("addr_tokens", lambda t: (F.length(t) >= 2) | t.rlike("[0-9]")), lambda t: F.concat(F.lit("a:"), t))
    return F.array_distinct(F.concat(name, addr))


def postings(recs: DataFrame) -> DataFrame:
    """The tokens of each record's bag()."""
    return recs.select("entity_id", "country", "source", F.explode(bag()).alias("token"))


BAG = """bag AS (
  SELECT DISTINCT entity_id, country, source, unnest(list_concat(
      list_transform(list_filter(name_tokens, lambda x: length(x) >= 2), lambda x: 'n:' || x),
      list_transform(list_filter(addr_tokens, lambda x: length(x) >= 2 OR regexp_matches(x, '[0-9]')), lambda x: 'a:' || x))) AS token
  FROM recs)"""


def token_idf(recs: DataFrame, max_df: int = 50_000, posted: DataFrame | None = None) -> DataFrame:
    """(country, source, token, df, idf) of pool tokens: ln((1 + N) / (1 + df)) + 1, N and df in one country's pool.

    posted: the postings where they are not those of postings().
    """
    pool = recs.where("source <> 'S1'")
    size = pool.groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))
    df = (postings(pool) if posted is None else posted.where("source <> 'S1'")).groupBy("country", "source", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") <= max_df).join(size, ["country", "source"]).select("country", "source", "token", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


IDF = """idf AS (
  SELECT country, source, token, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf
  FROM (SELECT country, source, token, count(*) AS df FROM bag WHERE source <> 'S1' GROUP BY ALL)
  JOIN (SELECT country, source, count(*) AS n FROM recs WHERE source <> 'S1' GROUP BY ALL) USING (country, source)
  WHERE df <= 50000)"""


#: Field weights: of name, of address and, if given, the share of the address weight that the name of a pool record without
#: address tokens takes over. A mapping has them by country; elsewhere fields are not told apart.
FieldWeights = tuple[float, ...]


def _weigh(field_weights: FieldWeights | Mapping[str, FieldWeights] | None) -> Weigh:
    """Weights of unit norm by record, or of unit norm by field and scaled; bit 0 of a token's hash tells an address word."""
    by_country = {c: tuple(w) for c, w in field_weights.items()} if isinstance(field_weights, Mapping) else None

    def weigh(block: Block, asked: bool, group: tuple) -> np.ndarray:
        fields = field_weights if by_country is None else by_country.get(group[0])
        idf, is_addr, row = block.idf[block.code], (block.tok & 1 > 0)[block.code], block.row
        name, addr = (np.bincount(row, np.where(of, idf * idf, 0.0), minlength=block.n) for of in (~is_addr, is_addr))
        with np.errstate(divide="ignore"):
            if fields is None:
                by_name = by_addr = 1 / np.sqrt(name + addr)
            else:
                by_name, by_addr = 1 / np.sqrt(name), 1 / np.sqrt(addr)
                if asked:
                    by_name, by_addr = fields[0] * by_name, fields[1] * by_addr
                elif len(fields) > 2:
                    by_name = np.where(addr == 0, (fields[0] + fields[2] * fields[1]) / fields[0], 1.0) * by_name
        scale = np.where(is_addr, by_addr[row], by_name[row])
        return np.where(idf > 0, idf * np.where(idf > 0, scale, 0.0), 0.0)

    return weigh


def scored_pairs(
    recs: DataFrame,
    max_df: int = 50_000,
    field_weights: FieldWeights | Mapping[str, FieldWeights] | None = None,
    posted: DataFrame | None = None,
    k: int = 10,
    reverse_k: int = 1,
    bare_k: int = 2,
) -> DataFrame:
    """(s1, cand, country, source, score) of pairs that share a token of their country: cosine, or the weighted sum of the
    cosines of name and address. Query tokens beyond the pool's vocabulary do not count.

    Only pairs that the lists of top_k(), reverse_top() and empty_address_top() of these sizes can hold are kept, and all
    of them. posted: the postings where they are not those of postings().
    """
    counts = {(r["country"], r["source"]): r["n"] for r in recs.groupBy("country", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks, of = F.col("source") == "S1", [F.col("country"), F.col("source")]
    cores = recs.sparkSession.sparkContext.defaultParallelism
    sides = [{key: n for key, n in counts.items() if key[0] is not None and (key[1] == "S1") == s1} for s1 in (True, False)]
    blocks = F.when(asks, block_numbers(sides[0], of, topk.ASKED_BLOCK, cores)).otherwise(block_numbers(sides[1], of, topk.POOL_BLOCK))
    hashed = lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(t.startswith("a:").cast("long"))
    bare = (~asks & (F.size("addr_tokens" if "addr_tokens" in recs.columns else "addr_words") == 0)).alias("bare")
    if posted is None:
        bags = recs.select("country", "source", F.col("entity_id").alias("id"), bare, F.transform(bag(), hashed).alias("h"))
    else:
        lists = posted.groupBy("country", "source", "entity_id").agg(F.collect_list(hashed(F.col("token"))).alias("h"))
        bags = lists.join(recs.select("entity_id", bare).groupBy("entity_id").agg(F.max("bare").alias("bare")), "entity_id").withColumnRenamed("entity_id", "id")
    table = topk.packed(bags.where("country is not null"), ["country", "source"], blocks)
    size = recs.where("source <> 'S1'").groupBy("country", F.col("source").alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    df = topk.block_tokens(table, ["country", "source"]).where("source <> 'S1'").groupBy("country", F.col("source").alias("pool"), "h").agg(F.sum("df").alias("df")).where(F.col("df") <= max_df)
    idf = df.join(size, ["country", "pool"]).select("country", "pool", "h", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    return topk.bag_pairs(table, idf, _weigh(field_weights), k, reverse_k, bare_k)


def _pairs_sql(fields: str = "", block: str = "") -> str:
    return f"""q AS (
  SELECT b.entity_id AS s1, i.country, i.source, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY b.entity_id, i.source{block})){fields} AS wq
  FROM bag b JOIN idf i USING (country, token) WHERE b.source = 'S1'),
p AS (
  SELECT entity_id AS cand, country, source, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY entity_id{block})) AS wp
  FROM bag JOIN idf USING (country, source, token)),
pairs AS (SELECT s1, cand, source, round(sum(wq * wp), 6) AS score FROM q JOIN p USING (country, source, token) GROUP BY ALL)"""


PAIRS = _pairs_sql()
FIELD_PAIRS = _pairs_sql(" * CASE substr(token, 1, 1) WHEN 'n' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END", ", substr(token, 1, 1)")


def top_k(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each (s1, source): block_score, block_rank from 0, block_top_score; ties by candidate id."""
    order = Window.partitionBy("s1", "source").orderBy(F.desc("score"), "cand")
    ranked = pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    top = F.max("score").over(Window.partitionBy("s1", "source"))
    return ranked.select("s1", "cand", "source", F.col("score").alias("block_score"), (F.col("rn") - 1).cast("int").alias("block_rank"), top.alias("block_top_score"))


TOPK = """topk AS (
  SELECT s1, cand, source, score AS block_score, (rn - 1)::INTEGER AS block_rank, max(score) OVER (PARTITION BY s1, source) AS block_top_score
  FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, cand) AS rn FROM pairs) WHERE rn <= 10)"""


def reverse_top(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The k best S1 records of each pool record over the whole S1 table."""
    order = Window.partitionBy("cand").orderBy(F.desc("score"), "s1")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("cand", "s1", "source", F.col("score").alias("rev_score"), (F.col("rn") - 1).cast("int").alias("rev_rank"))


REVERSE = """rev AS (
  SELECT cand, s1, source, score AS rev_score, (rn - 1)::INTEGER AS rev_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS rn FROM pairs) WHERE rn <= 1)"""


def exact_key_pairs(recs: DataFrame, cap: int = 5) -> DataFrame:
    """Pairs of equal country and name, over names that at most cap rows of a pool bear."""
    named = recs.where("length(name_key) >= 4").select("entity_id", "country", "source", "name_key")
    pool = named.where("source <> 'S1'").select(F.col("entity_id").alias("cand"), "country", "source", "name_key")
    rare = pool.groupBy("country", "source", "name_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= cap).drop("c")
    s1 = named.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "country", "name_key")
    return pool.join(rare, ["country", "source", "name_key"]).join(s1, ["country", "name_key"]).select("s1", "cand", "source").distinct()


KEYS = """named AS (SELECT entity_id, country, source, name_key FROM recs WHERE length(name_key) >= 4),
keypairs AS (
  SELECT DISTINCT s.entity_id AS s1, p.entity_id AS cand, p.source
  FROM named p JOIN (SELECT country, source, name_key FROM named WHERE source <> 'S1' GROUP BY ALL HAVING count(*) <= 5) USING (country, source, name_key)
  JOIN named s ON s.source = 'S1' AND s.country = p.country AND s.name_key = p.name_key)"""


def empty_address_top(recs: DataFrame, pairs: DataFrame, known: DataFrame, k: int = 2) -> DataFrame:
    """The k best pool records without an address of each (s1, source) that known lacks, with a positive score."""
    bare = recs.where("size(addr_tokens) = 0 and source <> 'S1'").select(F.col("entity_id").alias("cand"))
    found = top_k(pairs.join(bare, "cand", "left_semi").where("score > 0"), k)
    return found.join(known.select("s1", "cand"), ["s1", "cand"], "left_anti").select("s1", "cand", "source", "block_score")


def candidates(recs: DataFrame, pairs: DataFrame, k: int = 10, reverse_k: int = 1, key_cap: int = 5) -> DataFrame:
    """Union of the channels with flags: forward top-k, exact keys (score 0), reverse winners (reverse score).

    The scored pairs feed two channels and their lists more, so they are materialised once.
    """
    pairs = durable(pairs)
    forward = durable(top_k(pairs, k))
    tops = forward.groupBy("s1", "source").agg(F.max("block_top_score").alias("block_top_score"))
    late = exact_key_pairs(recs, key_cap).withColumn("key_channel", F.lit(1)).join(forward, ["s1", "cand"], "left_anti").withColumn("block_score", F.lit(0.0))
    back = reverse_top(pairs, reverse_k).select("s1", "cand", "source", F.lit(1).alias("rev_top1"), F.col("rev_score").alias("block_score"))
    known = forward.select("s1", "cand").unionByName(late.select("s1", "cand"))
    back = back.join(known, ["s1", "cand"], "left_anti")
    added = late.unionByName(back, allowMissingColumns=True).join(tops, ["s1", "source"], "left").withColumn("block_rank", F.lit(k))
    out = forward.unionByName(added, allowMissingColumns=True)
    return out.fillna(0, ["key_channel", "rev_top1", "block_top_score"]).select("s1", "cand", "source", "block_score", "block_rank", "block_top_score", "key_channel", "rev_top1")


CANDS = """late AS (SELECT s1, cand, source, 0.0::DOUBLE AS block_score, 1 AS key_channel, 0 AS rev_top1 FROM keypairs ANTI JOIN topk USING (s1, cand)),
back AS (SELECT s1, cand, source, rev_score AS block_score, 0 AS key_channel, 1 AS rev_top1 FROM rev
         WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM topk) AND (s1, cand) NOT IN (SELECT (s1, cand) FROM late)),
tops AS (SELECT s1, source, max(block_top_score) AS block_top_score FROM topk GROUP BY ALL),
cands AS (
  SELECT s1, cand, source, block_score, block_rank, block_top_score, 0 AS key_channel, 0 AS rev_top1 FROM topk
  UNION ALL
  SELECT s1, cand, source, block_score, 10 AS block_rank, coalesce(block_top_score, 0) AS block_top_score, key_channel, rev_top1
  FROM (SELECT * FROM late UNION ALL SELECT * FROM back) LEFT JOIN tops USING (s1, source))"""


def prune(cands: DataFrame, countries: DataFrame, floors: Mapping[str, float], default: float = 0.5, min_rank: int = 3) -> DataFrame:
    """Candidates of rank below min_rank, with a score of at least floor(country) x top, or of a late channel.

    countries: (s1, country) of every S1 record; floors names countries that differ from default.
    """
    floor = F.lit(default)
    for country, value in floors.items():
        floor = F.when(F.col("country") == country, F.lit(value)).otherwise(floor)
    keep = (F.col("block_rank") < min_rank) | (F.col("block_score") >= floor * F.col("block_top_score")) | (F.col("key_channel") == 1) | (F.col("rev_top1") == 1)
    return cands.join(countries, "s1").where(keep)


PRUNED = """pruned AS (
  SELECT c.*, r.country FROM cands c JOIN recs r ON r.entity_id = c.s1
  WHERE block_rank < 3 OR block_score >= CASE country WHEN 'fr' THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END * block_top_score OR key_channel = 1 OR rev_top1 = 1)"""

ALL_SQL = ",\n".join([RECS, BAG, IDF, PAIRS, TOPK, REVERSE, KEYS, CANDS, PRUNED])
