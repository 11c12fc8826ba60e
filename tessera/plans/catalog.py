"""The registered queries of the record-linkage operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.normalize import normalize_column
from tessera.functions.registry import register
from tessera.functions.text import LEGAL_FORMS, strip_legal_forms
from tessera.operators import blocking as B
from tessera.operators import decide as D
from tessera.operators import features as X
from tessera.operators import linkage as L
from tessera.operators import ngrams as G
from tessera.operators import pairfeatures as P
from tessera.operators import records as R
from tessera.operators import represent as E
from tessera.operators import scoring as M
from tessera.session import durable, written
from tessera.sources.tabular import findings

FLAGSHIP = "link_records"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query over the record view under its function's name, with its SQL."""

    def register(build: Callable[[DataFrame], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(R.records_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FORWARD = (R.RECS, B.BAG, B.IDF, B.PAIRS, B.TOPK)
TRUTH = """truth AS (
  SELECT DISTINCT a.entity_id AS s1, b.entity_id AS cand FROM recs a JOIN recs b ON a.source = 'S1' AND b.source <> 'S1'
     AND a.country = b.country AND a.name_key = b.name_key WHERE a.name_key <> ''),
owned AS (SELECT min_by(s1, length(s1) || s1) AS s1, cand FROM truth GROUP BY cand)"""
SCORED = "scored AS (SELECT s1, cand, block_score AS p FROM topk)"
RULED = """ruled AS (
  SELECT s1, cand, p FROM (SELECT *, max(p) OVER (PARTITION BY s1) AS best, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rn FROM scored)
  WHERE best >= 0.1::DOUBLE AND (p >= 0.8::DOUBLE OR (best < 0.8::DOUBLE AND rn = 1 AND best >= 0.4::DOUBLE)))"""
SINGLE = """single AS (SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn FROM ruled) WHERE rn = 1)"""
ENTITY = """entity AS (
  SELECT s1, n_true, n_pred, tp, round(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE
         ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END, 6) AS f
  FROM (SELECT e.entity_id AS s1, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
        FROM (SELECT entity_id FROM recs WHERE source = 'S1') e LEFT JOIN (
          SELECT s1, count(t) AS n_true, count(p) AS n_pred, count(CASE WHEN t = 1 AND p = 1 THEN 1 END) AS tp
          FROM (SELECT s1, cand, 1 AS t FROM owned) FULL JOIN (SELECT s1, cand, 1 AS p FROM single) USING (s1, cand) GROUP BY s1) c ON c.s1 = e.entity_id))"""
DECIDED = (*FORWARD, SCORED, RULED, SINGLE)
JUDGED = (*DECIDED, TRUTH, ENTITY)


def forward_pairs(recs: DataFrame, **of: object) -> DataFrame:
    """scored_pairs() for those who read the forward lists alone: no others are written."""
    return B.scored_pairs(recs, reverse_k=0, bare_k=0, **of)


def forward(recs: DataFrame) -> DataFrame:
    return B.top_k(forward_pairs(recs))


def scores(found: DataFrame) -> DataFrame:
    return found.select("s1", "cand", F.col("block_score").alias("p"))


def scored(recs: DataFrame) -> DataFrame:
    return scores(forward(recs))


def by_rule(scored: DataFrame) -> DataFrame:
    return D.threshold_rule(scored, 0.1, 0.8, 0.4).select("s1", "cand", "p")


def ruled(recs: DataFrame) -> DataFrame:
    return by_rule(scored(recs))


def single(recs: DataFrame) -> DataFrame:
    return D.one_to_one(ruled(recs))


def s1_of(recs: DataFrame) -> DataFrame:
    return recs.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "country")


def owned_truth(recs: DataFrame) -> DataFrame:
    """Records of equal country and name; each candidate belongs to its first S1 record."""
    named = recs.where("name_key <> ''")
    firsts = named.where("source = 'S1'").groupBy("country", "name_key").agg(F.min_by("entity_id", F.struct(F.length("entity_id"), "entity_id")).alias("s1"))
    return named.where("source <> 'S1'").select(F.col("entity_id").alias("cand"), "country", "name_key").join(firsts, ["country", "name_key"]).select("s1", "cand")


def judged(recs: DataFrame) -> DataFrame:
    return D.entity_scores(s1_of(recs), owned_truth(recs), single(recs))


@query(with_(R.RECS, B.BAG, B.IDF) + "SELECT country, source, token, df FROM idf")
def token_df(recs):
    return B.token_idf(recs).select("country", "source", "token", "df")


@query(with_(R.RECS, B.BAG, B.IDF) + "SELECT country, source, token, round(idf, 6) AS idf FROM idf")
def token_idf(recs):
    return B.token_idf(recs).select("country", "source", "token", F.round("idf", 6).alias("idf"))


@query(with_(R.RECS, B.BAG, B.IDF) + "SELECT entity_id, round(sqrt(sum(idf * idf)), 6) AS norm FROM bag JOIN idf USING (country, source, token) GROUP BY entity_id")
def doc_norms(recs):
    posted = B.postings(recs.where("source <> 'S1'")).join(B.token_idf(recs), ["country", "source", "token"])
    return posted.groupBy("entity_id").agg(F.round(F.sqrt(F.sum(F.col("idf") * F.col("idf"))), 6).alias("norm"))


@query(with_(*FORWARD) + "SELECT * FROM topk")
def idf_topk(recs):
    return forward(recs)


@query(with_(R.RECS, B.BAG, B.IDF, B.FIELD_PAIRS, B.TOPK) + "SELECT * FROM topk")
def idf_topk_field_weighted(recs):
    return B.top_k(forward_pairs(recs, field_weights=(0.7, 1.0)))


@query(with_(R.RECS, B.BAG, B.IDF.replace("df <= 50000", "df <= 20"), B.PAIRS, B.TOPK) + "SELECT * FROM topk")
def idf_topk_masked(recs):
    """Tokens of more than 20 pool records are left out."""
    return B.top_k(forward_pairs(recs, max_df=20))


COUNTRY_PAIRS = """q AS (
  SELECT b.entity_id AS s1, i.country, i.source, token, CASE WHEN i.country = 'fr'
    THEN idf / sqrt(sum(idf * idf) OVER (PARTITION BY b.entity_id, i.source, substr(token, 1, 1))) * CASE substr(token, 1, 1) WHEN 'n' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END
    ELSE idf / sqrt(sum(idf * idf) OVER (PARTITION BY b.entity_id, i.source)) END AS wq
  FROM bag b JOIN idf i USING (country, token) WHERE b.source = 'S1'),
p AS (
  SELECT entity_id AS cand, country, source, token, CASE WHEN country = 'fr'
    THEN idf / sqrt(sum(idf * idf) OVER (PARTITION BY entity_id, substr(token, 1, 1)))
         * CASE WHEN max((substr(token, 1, 1) = 'a')::INTEGER) OVER (PARTITION BY entity_id) = 0 THEN (0.7::DOUBLE + 0.5::DOUBLE) / 0.7::DOUBLE ELSE 1.0::DOUBLE END
    ELSE idf / sqrt(sum(idf * idf) OVER (PARTITION BY entity_id)) END AS wp
  FROM bag JOIN idf USING (country, source, token)),
pairs AS (SELECT s1, cand, source, round(sum(wq * wp), 6) AS score FROM q JOIN p USING (country, source, token) GROUP BY ALL)"""


@query(with_(R.RECS, B.BAG, B.IDF, COUNTRY_PAIRS, B.TOPK) + "SELECT * FROM topk")
def idf_topk_country_weights(recs):
    """One country tells name and address apart, with a share for pool records without an address; the others do not."""
    return B.top_k(forward_pairs(recs, field_weights={"fr": (0.7, 1.0, 0.5)}))


@query(with_(R.RECS, B.BAG, B.IDF, B.PAIRS, B.REVERSE) + "SELECT * FROM rev")
def reverse_top1(recs):
    return B.reverse_top(B.scored_pairs(recs))


@query(with_(R.RECS, B.KEYS) + "SELECT * FROM keypairs")
def exact_key_pairs(recs):
    return B.exact_key_pairs(recs)


@query(
    with_(*FORWARD)
    + """SELECT s1, cand, source, score AS block_score FROM (
  SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, cand) AS rn
  FROM pairs JOIN (SELECT entity_id AS cand FROM recs WHERE len(addr_tokens) = 0 AND source <> 'S1') USING (cand) WHERE score > 0)
WHERE rn <= 2 AND (s1, cand) NOT IN (SELECT (s1, cand) FROM topk)"""
)
def empty_addr_topk(recs):
    pairs = B.scored_pairs(recs)
    return B.empty_address_top(recs, pairs, B.top_k(pairs))


@query("WITH " + B.ALL_SQL + "\nSELECT * FROM cands")
def candidate_union(recs):
    return B.candidates(recs, B.scored_pairs(recs))


@query("WITH " + B.ALL_SQL + "\nSELECT * FROM pruned")
def prune_relative_floor(recs):
    return B.prune(B.candidates(recs, B.scored_pairs(recs)), s1_of(recs), {"fr": 0.55})


@query(with_(R.RECS) + "SELECT country, name_key, count(*) AS freq, round(ln(1 + least(count(*), 8)::DOUBLE), 6) AS log_freq FROM recs WHERE source <> 'S1' AND name_key <> '' GROUP BY ALL")
def key_freqs(recs):
    n = F.count(F.lit(1))
    return recs.where("source <> 'S1' and name_key <> ''").groupBy("country", "name_key").agg(n.alias("freq"), F.round(F.log1p(F.least(n, F.lit(8)).cast("double")), 6).alias("log_freq"))


@query(with_(R.RECS) + X.POPULATION_SQL)
def population_counts(recs):
    return X.population_counts(recs)


@query(with_(*FORWARD) + X.LIST_SQL)
def list_features(recs):
    return X.list_features(forward(recs))


@query("WITH " + ",\n".join(FORWARD) + ",\n" + X.TOKEN_FEATURES_SQL)
def token_features(recs):
    return X.token_features(X.with_records(forward(recs), recs))


@query(with_(*FORWARD) + X.NGRAM_SQL)
def char_ngram_jaccard(recs):
    return X.ngram_jaccard(X.with_records(forward(recs), recs))


@query(with_(*DECIDED) + "SELECT * FROM ruled")
def threshold_rule(recs):
    return ruled(recs)


@query(with_(*DECIDED) + "SELECT * FROM single")
def one_to_one(recs):
    return single(recs)


BLENDED = """c AS (
  SELECT s1, cand, least(greatest(block_score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS a,
         least(greatest(block_score / (1.0::DOUBLE + block_rank), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS b FROM topk)"""


@query(with_(*FORWARD, BLENDED) + "SELECT s1, cand, round(1 / (1 + exp(-(0.8::DOUBLE * ln(a / (1 - a)) + 0.2::DOUBLE * ln(b / (1 - b))))), 6) AS blended FROM c")
def logit_blend(recs):
    other = F.col("block_score") / (F.lit(1.0) + F.col("block_rank"))
    return forward(recs).select("s1", "cand", F.round(D.logit_blend(F.col("block_score"), other, 0.8), 6).alias("blended"))


@query(
    with_(*FORWARD, SCORED, G.GRAM_CTES, f"outside AS ({G.GRAM_LIST})")
    + """SELECT s1, cand, round(1 / (1 + exp(-(0.8::DOUBLE * ln(a / (1 - a)) + 0.2::DOUBLE * ln(b / (1 - b))))), 6) AS blended
FROM (SELECT s1, cand, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS a, least(greatest(coalesce(score, p), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS b
      FROM scored LEFT JOIN outside USING (s1, cand))"""
)
def blend_outside_scores(recs):
    """The scores of another table, here the n-gram channel's, blended in; pairs that it lacks keep their own."""
    outside = char_ngram_topk(recs).select("s1", "cand", F.col("score").alias("nn"))
    return D.with_outside_scores(scored(recs), outside, "nn", 0.8).select("s1", "cand", F.round("blended", 6).alias("blended"))


@query(
    with_(*FORWARD, SCORED)
    + """, kept AS (SELECT tau, s1, cand, p FROM scored JOIN (SELECT entity_id AS s1, country FROM recs WHERE source = 'S1') USING (s1)
  JOIN (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE]) AS tau) ON p >= CASE country WHEN 'fr' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2::DOUBLE ELSE tau END),
mine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tau, cand ORDER BY p DESC, s1) AS rn FROM kept) WHERE rn = 1)
SELECT t.tau, e.entity_id AS s1, coalesce(string_agg(cand, ',' ORDER BY cand), '') AS ids FROM (SELECT entity_id FROM recs WHERE source = 'S1') e
  JOIN (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE]) AS tau) t ON true LEFT JOIN mine m ON m.s1 = e.entity_id AND m.tau = t.tau GROUP BY ALL"""
)
def redecide(recs):
    """Saved scores decided again at three thresholds, two countries with their own."""
    return D.redecide(durable(scored(recs)), s1_of(recs), [0.3, 0.4, 0.6], {"fr": 0.5, "de": 0.2})


@query(with_(*JUDGED) + "SELECT country, count(*) AS n, round(avg(f), 9) AS macro_f FROM entity JOIN (SELECT entity_id AS s1, country FROM recs) USING (s1) GROUP BY country")
def country_macro_f(recs):
    return D.macro_by_country(judged(recs), s1_of(recs))


@query(with_(*JUDGED) + "SELECT * FROM entity")
def fbeta_per_entity(recs):
    return judged(recs)


@query(
    with_(*JUDGED)
    + """SELECT count(*) AS n_entities, round(avg(f), 9) AS macro_f, round(avg(CASE WHEN n_true = 0 THEN f END), 9) AS singleton_f,
  round(avg(CASE WHEN n_true > 0 THEN f END), 9) AS matched_f, sum(n_pred)::BIGINT AS n_predicted, sum(n_true)::BIGINT AS n_truth FROM entity"""
)
def score_report(recs):
    return judged(recs).agg(
        F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("f"), 9).alias("macro_f"), F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f"))), 9).alias("singleton_f"),
        F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 9).alias("matched_f"), F.sum("n_pred").alias("n_predicted"), F.sum("n_true").alias("n_truth"),
    )


@query(with_(*FORWARD, TRUTH) + "SELECT count(*) AS n_truth, count(k.s1) AS n_found, round(count(k.s1)::DOUBLE / count(*), 6) AS recall FROM owned o LEFT JOIN topk k ON k.s1 = o.s1 AND k.cand = o.cand")
def recall_ceiling(recs):
    found = owned_truth(recs).join(forward(recs).select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left")
    return found.agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


@query(
    with_(*DECIDED)
    + """SELECT country, count(*) AS n_s1, round(avg(coalesce(nc, 0)), 9) AS mean_cands, round(avg(coalesce(np, 0)), 9) AS mean_preds,
  round(avg((np IS NULL)::INTEGER), 9) AS empty_rate, round(avg(coalesce(best, 0)), 9) AS mean_top1
FROM (SELECT entity_id AS s1, country FROM recs WHERE source = 'S1')
LEFT JOIN (SELECT s1, count(*) AS nc, max(p) AS best FROM scored GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS np FROM single GROUP BY s1) USING (s1) GROUP BY country"""
)
def country_report(recs):
    found = scored(recs)
    cands = found.groupBy("s1").agg(F.count(F.lit(1)).alias("nc"), F.max("p").alias("best"))
    preds = D.one_to_one(by_rule(found)).groupBy("s1").agg(F.count(F.lit(1)).alias("np"))
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0)).cast("double")), 9)
    return s1_of(recs).join(cands, "s1", "left").join(preds, "s1", "left").groupBy("country").agg(
        F.count(F.lit(1)).alias("n_s1"), mean(F.col("nc")).alias("mean_cands"), mean(F.col("np")).alias("mean_preds"),
        F.round(F.avg(F.col("np").isNull().cast("int")), 9).alias("empty_rate"), mean(F.col("best")).alias("mean_top1"),
    )


@query(with_(*DECIDED) + "SELECT e.entity_id AS s1, coalesce(ids, '') AS ids FROM (SELECT entity_id FROM recs WHERE source = 'S1') e LEFT JOIN (SELECT s1, string_agg(cand, ',' ORDER BY cand) AS ids FROM single GROUP BY s1) m ON m.s1 = e.entity_id")
def link_records(recs):
    """End to end: postings, IDF, top-K join, threshold rule, one-to-one, sorted id lists."""
    return D.id_lists(s1_of(recs), single(recs))


@query(with_(*FORWARD, "taus AS (SELECT (50 + unnest(range(0, 46))) / 100.0::DOUBLE AS tau)", TRUTH) + """SELECT tau, count(*) AS n_pred, count(o.s1) AS n_hit FROM taus
  JOIN (SELECT s1, cand, block_score AS p FROM topk) k ON k.p >= tau LEFT JOIN owned o ON o.s1 = k.s1 AND o.cand = k.cand GROUP BY tau""")
def threshold_sweep(recs):
    hits = scored(recs).join(owned_truth(recs).withColumn("hit", F.lit(1)), ["s1", "cand"], "left")
    taus = F.filter(F.array(*[F.lit((50 + i) / 100) for i in range(46)]), lambda t: F.col("p") >= t)
    return hits.select(F.explode(taus).alias("tau"), "hit").groupBy("tau").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("n_hit"))


@query(with_(*FORWARD, SCORED) + """, r AS (SELECT count(*) FILTER (p >= 0.6::DOUBLE) AS o, count(*) FILTER (p >= 0.4::DOUBLE) AS t FROM scored WHERE cand LIKE 'S2%'),
n AS (SELECT count(*) AS n FROM scored WHERE cand LIKE 'S3%' AND p >= 0.4::DOUBLE)
SELECT coalesce(max(p) FILTER (seen >= greatest(1, round_even(n::DOUBLE * o / greatest(1, t), 0))), min(p)) AS tau
FROM (SELECT p, sum(count(*)) OVER (ORDER BY p DESC) AS seen FROM scored WHERE cand LIKE 'S3%' AND p >= 0.4::DOUBLE GROUP BY p), r, n""")
def drop_matched_tau(recs):
    s = scored(recs)
    return D.drop_matched_tau(s.where("cand like 'S3%'"), s.where("cand like 'S2%'"), 0.4, 0.6)


FORMS = str(list(LEGAL_FORMS))


@query(
    with_(R.RECS)
    + f"""SELECT entity_id, array_to_string(list_filter(name_tokens, lambda x: NOT list_contains({FORMS}, x)), ' ') AS core_name,
  array_to_string(list_filter(name_tokens, lambda x: list_contains({FORMS}, x)), ' ') AS forms FROM recs"""
)
def legal_suffix_split(recs):
    return X.legal_forms(recs)


@query()
def string_sims(recs):
    return X.string_similarities(X.with_records(forward(recs), recs))


@query(
    with_(*DECIDED)
    + """, lists AS (SELECT s1, ids FROM (
    SELECT e.entity_id AS s1, coalesce((SELECT string_agg(cand, ',' ORDER BY cand) FROM ruled r WHERE r.s1 = e.entity_id), '') AS ids FROM recs e WHERE source = 'S1' AND doc_id % 7 <> 0)
  UNION ALL SELECT 'S1-0', 'S2-1,S2-1,S1-3,X-9' UNION ALL SELECT 'S1-x', ''),
each AS (SELECT s1, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS cand FROM lists)
SELECT 'duplicate_row' AS rule, coalesce(sum(c - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM lists GROUP BY s1)
UNION ALL SELECT 'missing_row', count(*) FROM recs WHERE source = 'S1' AND entity_id NOT IN (SELECT s1 FROM lists)
UNION ALL SELECT 'extra_row', count(DISTINCT s1) FROM lists WHERE s1 NOT IN (SELECT entity_id FROM recs WHERE source = 'S1')
UNION ALL SELECT 'duplicate_id', (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM each GROUP BY s1, cand))
UNION ALL SELECT 'self_match', count(*) FROM each WHERE cand LIKE 'S1-%'
UNION ALL SELECT 'wrong_prefix', count(*) FROM each WHERE NOT regexp_matches(cand, '^S[123]-')
UNION ALL SELECT 'outside_candidates', count(*) FROM each WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM topk)"""
)
def validator_findings(recs):
    """What the validator says of lists with planted faults: rows left out, a repeated row, bad ids."""
    planted = recs.sparkSession.createDataFrame([("S1-0", "S2-1,S2-1,S1-3,X-9"), ("S1-x", "")], "s1 string, ids string")
    found = forward(recs)
    lists = D.id_lists(s1_of(recs.where("doc_id % 7 <> 0")), by_rule(scores(found))).unionByName(planted)
    return findings(lists, s1_of(recs), found)


@query(with_(R.RECS) + "SELECT entity_id, replace(replace(replace(strip_accents(name_key), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS name_norm FROM recs")
def normalize_text(recs):
    return recs.select("entity_id", normalize_column(recs.sparkSession, F.col("name_key")).alias("name_norm"))


@query(
    with_(*FORWARD, "k AS (SELECT s1, cand, regexp_replace(a.name_key, '[^a-z0-9 ]', '', 'g') AS x, regexp_replace(b.name_key, '[^a-z0-9 ]', '', 'g') AS y FROM topk JOIN recs a ON a.entity_id = s1 JOIN recs b ON b.entity_id = cand)")
    + "SELECT s1, cand, round(jaro_winkler_similarity(x, y), 6) AS sim FROM k WHERE x <> '' AND y <> ''"
)
def sql_functions(recs):
    """The registered functions from spark.sql(): here the similarity of the ASCII part of names."""
    spark = recs.sparkSession
    register(spark)
    plain = lambda c: F.regexp_replace(c, "[^a-z0-9 ]", "")
    pairs = X.with_records(forward(recs), recs).select("s1", "cand", plain("a_name_key").alias("x"), plain("b_name_key").alias("y"))
    return spark.sql("SELECT s1, cand, round(tessera_jaro_winkler(x, y), 6) AS sim FROM {pairs} WHERE x <> '' AND y <> ''", pairs=pairs)


PLAIN = f"""reps AS (
  SELECT entity_id, source, country, name_tokens AS name_words, name_key, addr_key, addr_tokens AS addr_words,
         list_filter(name_tokens, lambda x: NOT list_contains({FORMS}, x)) AS name_kept,
         array_to_string(list_filter(name_tokens, lambda x: NOT list_contains({FORMS}, x)), '') AS name_core,
         coalesce(list_filter(addr_tokens, lambda x: regexp_matches(x, '^[0-9]{{1,5}}$'))[1], '') AS addr_number,
         coalesce(list_filter(addr_tokens, lambda x: NOT regexp_matches(x, '^[0-9]+$'))[1], '') AS addr_street
  FROM recs)"""


def plain_reps(recs: DataFrame) -> DataFrame:
    """The columns of representations that counting operators read, straight from the tokens, so that SQL can follow."""
    kept, _ = strip_legal_forms(F.col("name_tokens"))
    first = lambda keep: F.coalesce(F.get(F.filter("addr_tokens", keep), F.lit(0)), F.lit(""))
    return recs.select(
        "entity_id", "source", "country", F.col("name_tokens").alias("name_words"), "name_key", "addr_key", F.col("addr_tokens").alias("addr_words"), kept.alias("name_kept"),
        F.array_join(kept, "").alias("name_core"), first(lambda t: t.rlike("^[0-9]{1,5}$")).alias("addr_number"), first(lambda t: ~t.rlike("^[0-9]+$")).alias("addr_street"),
    )


def full_reps(recs: DataFrame) -> DataFrame:
    """plain_reps() with every column that set and flag features read, so that SQL can follow: names and addresses as they
    are, their skeletons themselves."""
    numbers = F.transform(F.regexp_extract_all("addr_key", F.lit("([0-9]+)"), 1), lambda d: d)
    _, forms = strip_legal_forms(F.col("name_words"))
    bare = F.transform("numbers", lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    number_first = F.coalesce(F.get("addr_words", F.lit(0)).rlike("^[0-9]+$"), F.lit(False))
    return plain_reps(recs).withColumn("numbers", numbers).select(
        "*", F.col("name_key").alias("name_norm"), F.col("name_key").alias("name_skeleton"), F.lit("Latin").alias("name_script"), F.lit(0.0).alias("non_latin"), forms.alias("name_forms"),
        F.col("addr_key").alias("addr_norm"), bare.alias("addr_digits"), F.filter("numbers", lambda d: F.length(d).isin(5, 6)).alias("addr_postcodes"),
        F.when(number_first, F.coalesce(F.get(bare, F.lit(0)), F.lit(""))).otherwise(F.lit("")).alias("addr_leading"),
    ).drop("numbers")


UNCHECKED = {"name_char_ngram_jaccard", "name_skeleton_ngram_jaccard", "addr_char_ngram_jaccard"}  # char_ngram_jaccard has these measures


def _set_sql() -> str:
    size = lambda e: f"len({e})"
    inter = lambda x, y: f"len(list_intersect({x}, {y}))"
    jac = X._jac
    holds = lambda x, y: f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE {inter(x, y)}::DOUBLE / len(list_distinct({x})) END"
    ratio = lambda x, y: f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0::DOUBLE ELSE least(length({x}), length({y}))::DOUBLE / greatest(length({x}), length({y})) END"
    flag = lambda c: f"coalesce(({c})::INTEGER, 0)"
    unless = lambda known, c: f"CASE WHEN {known} THEN ({c})::DOUBLE ELSE -1 END"
    first = lambda x: f"array_to_string(list_transform({x}, lambda w: substr(w, 1, 1)), '')"
    family = lambda x: f"list_transform({x}, lambda w: map_extract({FAMILY}, w)[1])"
    codes = lambda x: f"list_filter(list_transform({x}, lambda w: {X._code('w')}), lambda c: length(c) >= 2)"
    numbered = "a.addr_number <> '' AND b.addr_number <> ''"
    features = {
        "name_token_jaccard": jac("a.name_kept", "b.name_kept"),
        "name_token_containment_a_in_b": holds("a.name_kept", "b.name_kept"),
        "name_token_containment_b_in_a": holds("b.name_kept", "a.name_kept"),
        "name_shared_token_count": inter("a.name_kept", "b.name_kept"),
        "name_len_ratio": ratio("a.name_key", "b.name_key"),
        "name_token_count_diff": f"abs({size('a.name_kept')} - {size('b.name_kept')})",
        "name_suffix_match": flag("list_has_any(a.name_forms, b.name_forms)"),
        "name_suffix_family_match": flag(f"list_has_any({family('a.name_forms')}, {family('b.name_forms')})"),
        "name_suffix_present_both": flag("len(a.name_forms) > 0 AND len(b.name_forms) > 0"),
        "script_match": "1",
        "name_missing_either": flag("a.name_key = '' OR b.name_key = ''"),
        "name_key_exact_match": flag("a.name_key <> '' AND a.name_key = b.name_key"),
        "name_initial_match": flag("substr(a.name_kept[1], 1, 1) = substr(b.name_kept[1], 1, 1)"),
        "name_last_token_match": flag("a.name_kept[-1] = b.name_kept[-1]"),
        "name_first_token_match": flag("a.name_kept[1] = b.name_kept[1]"),
        "name_phonetic_jaccard": jac("a.codes", "b.codes"),
        "name_core_match": flag("a.name_core <> '' AND a.name_core = b.name_core"),
        "pct_non_latin_diff": "0",
        "addr_postcode_match": unless("len(a.postcodes) > 0 AND len(b.postcodes) > 0", "list_has_any(a.postcodes, b.postcodes)::INTEGER"),
        "addr_num_match": unless(numbered, "(a.addr_number = b.addr_number)::INTEGER"),
        "addr_num_edit": unless(numbered, "least(levenshtein(a.addr_number, b.addr_number), 4)"),
        "addr_num_log_absdiff": unless(numbered, "ln(1 + abs(try_cast(a.addr_number AS BIGINT) - try_cast(b.addr_number AS BIGINT))::DOUBLE)"),
        "addr_num_len_diff": unless(numbered, "abs(length(a.addr_number) - length(b.addr_number))"),
        "addr_num_street_match": unless(f"{numbered} AND a.addr_street <> '' AND b.addr_street <> ''", "(a.addr_number = b.addr_number AND a.addr_street = b.addr_street)::INTEGER"),
        "addr_token_jaccard": jac("a.addr_words", "b.addr_words"),
        "addr_len_ratio": ratio("a.addr_key", "b.addr_key"),
        "addr_leading_digits_match": flag("a.leading <> '' AND a.leading = b.leading"),
        "addr_digit_token_jaccard": unless("len(a.digits) > 0 AND len(b.digits) > 0", jac("a.digits", "b.digits")),
        "addr_missing_either": flag("a.addr_key = '' OR b.addr_key = ''"),
        "addr_missing_both": flag("a.addr_key = '' AND b.addr_key = ''"),
        "addr_key_exact_match": flag("a.addr_key <> '' AND a.addr_key = b.addr_key"),
        "name_a_in_addr_b": holds("a.name_kept", "b.addr_words"),
        "name_b_in_addr_a": holds("b.name_kept", "a.addr_words"),
        "name_tok_wjac": "coalesce(n.wjac, -1)", "name_max_only_idf": "coalesce(n.most, -1)", "addr_tok_wjac": "coalesce(w.wjac, -1)", "addr_max_only_idf": "coalesce(w.most, -1)",
        "name_acronym_match": flag(f"(len(a.name_kept) >= 2 AND {first('a.name_kept')} = array_to_string(b.name_kept, '')) OR (len(b.name_kept) >= 2 AND {first('b.name_kept')} = array_to_string(a.name_kept, ''))"),
        "name_num_conflict": unless("len(a.name_numbers) > 0 AND len(b.name_numbers) > 0", "(NOT list_has_any(a.name_numbers, b.name_numbers))::INTEGER"),
        "country_match": flag("a.country = b.country"),
        "target_source": "(k.source = 'S3')::INTEGER",
    }
    shown = ", ".join(f"round(({sql})::DOUBLE, 6) AS {name}" for name, sql in features.items())
    return f"""{with_(*FORWARD, PLAIN)},
whole AS (SELECT *, list_filter(name_words, lambda x: list_contains({FORMS}, x)) AS name_forms, regexp_extract_all(name_key, '[0-9]+') AS name_numbers,
  {codes("string_split(name_key, ' ')")} AS codes, list_transform(regexp_extract_all(addr_key, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END) AS digits,
  list_filter(regexp_extract_all(addr_key, '[0-9]+'), lambda d: length(d) IN (5, 6)) AS postcodes FROM reps),
f AS (SELECT *, CASE WHEN regexp_full_match(coalesce(addr_words[1], ''), '[0-9]+') THEN digits[1] ELSE '' END AS leading FROM whole),
tw AS (SELECT DISTINCT entity_id, source, country, unnest(list_concat(list_transform(name_kept, lambda x: 'n:' || x), list_transform(addr_words, lambda x: 'a:' || x))) AS word FROM reps),
pn AS (SELECT country, count(*) AS n FROM reps WHERE source <> 'S1' GROUP BY country), pc AS (SELECT country, word, count(*) AS c FROM tw WHERE source <> 'S1' GROUP BY ALL),
wt AS (SELECT entity_id, word, CASE WHEN c IS NULL THEN ln(greatest(n, 2)::DOUBLE) ELSE ln(n::DOUBLE / c) END AS weight FROM tw JOIN pn USING (country) LEFT JOIN pc USING (country, word)),
xs AS (SELECT s1, cand, word, weight FROM topk JOIN wt ON entity_id = s1), ys AS (SELECT s1, cand, word, weight FROM topk JOIN wt ON entity_id = cand),
ov AS (SELECT s1, cand, substr(word, 1, 1) AS tag, CASE WHEN count(xw) = 0 OR count(yw) = 0 THEN -1 WHEN coalesce(sum(coalesce(xw, yw)), 0) = 0 THEN 0
         ELSE coalesce(sum(xw) FILTER (yw IS NOT NULL), 0) / sum(coalesce(xw, yw)) END AS wjac,
         CASE WHEN count(xw) = 0 OR count(yw) = 0 THEN -1 ELSE coalesce(max(coalesce(xw, yw)) FILTER (xw IS NULL OR yw IS NULL), 0) END AS most
       FROM (SELECT s1, cand, word, xs.weight AS xw, ys.weight AS yw FROM xs FULL JOIN ys USING (s1, cand, word)) GROUP BY ALL)
SELECT k.s1, k.cand, {shown} FROM topk k JOIN f a ON a.entity_id = k.s1 JOIN f b ON b.entity_id = k.cand
LEFT JOIN ov n ON n.tag = 'n' AND n.s1 = k.s1 AND n.cand = k.cand LEFT JOIN ov w ON w.tag = 'a' AND w.s1 = k.s1 AND w.cand = k.cand"""


FAMILY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LEGAL_FORMS.items()) + "}"


@query(_set_sql())
def set_features(recs):
    """The set, flag and number features of pairs of plain records."""
    found = P.set_features(forward(recs), full_reps(recs), UNCHECKED)
    return found.select("s1", "cand", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query(
    with_(R.RECS, "w AS (SELECT country, word FROM (SELECT country, unnest(name_tokens) AS word FROM recs WHERE source = 'S1') WHERE regexp_matches(word, '^[A-Za-z]{2,}$'))")
    + "SELECT country, word, round(ln(sum(count(*)) OVER (PARTITION BY country)::DOUBLE / count(*)), 6) AS cost FROM w GROUP BY country, word"
)
def segmentation_costs(recs):
    return E.word_costs(plain_reps(recs)).select("country", "word", F.round("cost", 6).alias("cost"))


@query(
    with_(R.RECS, PLAIN)
    + """, keyed AS (SELECT entity_id, source, country, unnest(list_filter([
    CASE WHEN length(name_core) >= 4 AND addr_number <> '' THEN 'cn|' || name_core || '|' || addr_number END,
    CASE WHEN length(name_core) >= 4 AND addr_number <> '' THEN 'sn|' || array_to_string(list_sort(name_kept), '') || '|' || addr_number END,
    CASE WHEN length(name_core) >= 6 THEN 'c|' || name_core END], lambda k: k IS NOT NULL)) AS key FROM reps),
rare AS (SELECT source, country, key FROM keyed WHERE source <> 'S1' GROUP BY ALL HAVING count(*) <= CASE WHEN key LIKE 'c|%' THEN 1 ELSE 5 END)
SELECT DISTINCT s.entity_id AS s1, p.entity_id AS cand, p.source FROM keyed p JOIN rare USING (source, country, key)
JOIN keyed s ON s.source = 'S1' AND s.country = p.country AND s.key = p.key"""
)
def name_number_keys(recs):
    return E.exact_keys(plain_reps(recs))


def _counts_sql() -> str:
    keys = {"name_key": "name_key", "addr_key": "addr_key", "core": "name_core", "numkey": "CASE WHEN addr_number <> '' AND addr_street <> '' THEN addr_number || '|' || addr_street ELSE '' END",
            "whole": "CASE WHEN len(list_distinct(addr_words)) >= 3 THEN array_to_string(list_sort(list_distinct(addr_words)), ' ') ELSE '' END"}
    keyed = "keyed AS (SELECT entity_id, source, country, name_words, " + ", ".join(f"{sql} AS {k}" for k, sql in keys.items()) + " FROM reps)"
    counts = [f"c_{k} AS (SELECT country, {k}, " + ", ".join(f"count(*) FILTER (source = '{s}') AS {k}_{s.lower()}" for s in ("S1", "S2", "S3")) + f" FROM keyed WHERE {k} <> '' GROUP BY ALL)" for k in keys]
    shown = ", ".join(f"coalesce({k}_{s}, 0) AS {k}_{s}" for k in keys for s in ("s1", "s2", "s3"))
    joins = " ".join(f"LEFT JOIN c_{k} ON c_{k}.country = keyed.country AND c_{k}.{k} = keyed.{k}" for k in keys)
    rest = f"""na AS (SELECT source, country, core, count(DISTINCT numkey) AS naddr FROM keyed WHERE core <> '' AND numkey <> '' GROUP BY ALL),
nn AS (SELECT source, country, numkey, count(DISTINCT core) AS nnames FROM keyed WHERE core <> '' AND numkey <> '' GROUP BY ALL),
words AS (SELECT entity_id, country, source, unnest(name_words) AS word FROM keyed),
known AS (SELECT DISTINCT country, word FROM words WHERE source = 'S1' AND length(word) >= 3),
frac AS (SELECT entity_id, avg((k.word IS NOT NULL)::INTEGER) AS f FROM words w LEFT JOIN known k ON k.country = w.country AND k.word = w.word
         WHERE length(w.word) >= 3 AND regexp_full_match(w.word, '[\\x00-\\x7f]*') AND NOT list_contains({FORMS}, w.word) GROUP BY entity_id)"""
    return f"""{with_(R.RECS, PLAIN, keyed, *counts, rest)}SELECT keyed.entity_id, {shown}, coalesce(naddr, 0) AS naddr, coalesce(nnames, 0) AS nnames, round(coalesce(f, -1), 6) AS tok_frac
FROM keyed {joins} LEFT JOIN na ON na.source = keyed.source AND na.country = keyed.country AND na.core = keyed.core
LEFT JOIN nn ON nn.source = keyed.source AND nn.country = keyed.country AND nn.numkey = keyed.numkey LEFT JOIN frac ON frac.entity_id = keyed.entity_id"""


@query(_counts_sql())
def record_counts(recs):
    return P.record_counts(plain_reps(recs)).withColumn("tok_frac", F.round("tok_frac", 6))


@query(
    with_(R.RECS, PLAIN)
    + """, w AS (SELECT DISTINCT entity_id, source, country, unnest(list_concat(list_transform(name_kept, lambda x: 'n:' || x), list_transform(addr_words, lambda x: 'a:' || x))) AS word FROM reps),
n AS (SELECT country, count(*) AS n FROM reps WHERE source <> 'S1' GROUP BY country), c AS (SELECT country, word, count(*) AS c FROM w WHERE source <> 'S1' GROUP BY ALL)
SELECT entity_id, word, round(CASE WHEN c IS NULL THEN ln(greatest(n, 2)::DOUBLE) ELSE ln(n::DOUBLE / c) END, 6) AS weight FROM w JOIN n USING (country) LEFT JOIN c USING (country, word)"""
)
def token_weights(recs):
    weights = P.token_weights(plain_reps(recs))
    of = lambda c, tag: weights.select("entity_id", F.explode(c).alias("word", "weight")).select("entity_id", F.concat(F.lit(tag), "word").alias("word"), F.round("weight", 6).alias("weight"))
    return of("name_idf", "n:").unionByName(of("addr_idf", "a:"))


@query("WITH " + R.RECS + ",\n" + G.GRAM_TOPK)
def char_ngram_topk(recs):
    """The n-gram channel from S1 to both pools, weights fitted on S1 and each pool."""
    texts = recs.select("country", "source", F.col("entity_id").alias("id"), F.col("name_key").alias("text"))
    return G.gram_top_k(texts.where("source = 'S1'").drop("source"), texts.where("source <> 'S1'"))


@query(
    with_(*FORWARD)
    + """, z AS (SELECT unnest(b.name_tokens) AS word, unnest(a.name_tokens) AS latin FROM topk k JOIN recs a ON a.entity_id = k.s1 JOIN recs b ON b.entity_id = k.cand
  WHERE block_score >= 0.5::DOUBLE AND len(a.name_tokens) = len(b.name_tokens)),
c AS (SELECT word, latin, count(*) AS n FROM z WHERE NOT regexp_full_match(word, '[\\x00-\\x7f]*') AND regexp_matches(latin, '^[A-Za-z]+$') GROUP BY ALL)
SELECT word, latin, n FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, latin) AS rn FROM c) WHERE rn = 1 AND n >= 2 AND n::DOUBLE / total >= 0.6::DOUBLE"""
)
def learnt_dictionary(recs):
    """Words beyond ASCII with the ASCII word that linked S1 names put in their place."""
    linked = forward(recs).where("block_score >= 0.5").select("s1", "cand")
    return E.transliterations(plain_reps(recs), linked, native="[^\\x00-\\x7f]")


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as business records with raw names (words 1-8) and addresses (all other words)."""
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    role = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    part = lambda at, n: F.array_join(F.slice(words, F.lit(at), n), " ")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    return docs.select(F.concat(role, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), role.alias("source"), F.col("lang").alias("country"), part(1, F.lit(8)).alias("business_name"), part(9, F.size(words)).alias("business_address"))


def represented(build: Callable[[DataFrame], DataFrame]) -> Callable:
    """Register a query over represented business records, which SQL cannot express."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(E.represent(business(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def featured(reps: DataFrame) -> DataFrame:
    """The features of reps, a written table: its parts are read by column many times, and whole rows of texts fill the disk."""
    policy = L.Policy(empty_k=2)
    return durable(P.pair_features(L.prune_candidates(L.link_candidates(reps, policy), reps, policy), reps))


def labelled(features: DataFrame) -> DataFrame:
    """Pairs of equal name keys count as true; the features that say so are left out of TRAINED."""
    return M.with_labels(features, features.where("name_key_exact_match = 1"))


TRAINED = [f for f in P.FEATURES if f not in ("name_key_exact_match", "name_core_match", "name_char_ngram_jaccard", "name_skeleton_ngram_jaccard")]


@represented
def represent_records(reps):
    return reps


@represented
def glued_names(reps):
    """Beside the documents, records of a country of its own with glued names."""
    names = ["S1 acme global foods", "S1 river stone works inc", "S1 global stone", "S2 acmefoods inc", "S3 riverstoneworks", "S2 foods", "S3 stonezzzzzzz"]
    planted = [(f"{n[:2]}-planted{i}", n[:2], "planted", n[3:], "") for i, n in enumerate(names)]
    made = E.represent(reps.sparkSession.createDataFrame(planted, "entity_id string, source string, country string, business_name string, business_address string"))
    reps = durable(reps.unionByName(made))
    return E.segmented_names(reps, E.word_costs(reps))


@represented
def pair_features(reps):
    """All 88 features of the pruned candidates of every channel."""
    return featured(written(reps, "represented"))


@represented
def boosted_scores(reps):
    """Mean probability of two boosted models that differ in their seed."""
    rows = labelled(featured(written(reps, "represented")))
    return M.score(rows, M.train_ensemble(rows, TRAINED, members=2, maxIter=5, maxDepth=4), TRAINED).select("s1", "cand", "label", "p")


@represented
def supervised_filter(reps):
    """Candidates that the stage-one model keeps, by a threshold that keeps 99 % of the true pairs out of fold."""
    reps = written(reps, "represented")
    rows = featured(reps)
    countries = reps.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "country")
    stage = durable(M.with_labels(M.stage_one(rows, countries), rows.where("name_key_exact_match = 1")))
    if not stage.where("label = 1").limit(1).count():
        return stage.select("s1", "cand", "source", F.lit(None).cast("double").alias("p"))
    model, tau, _ = M.fit_filter(stage, 0.99, maxIter=5, maxDepth=4)
    return M.score(stage, model, M.STAGE_ONE).where(F.col("p") >= tau).select("s1", "cand", "source", "p")


@query(
    with_(*FORWARD, SCORED, TRUTH)
    + """, g AS (SELECT a.t AS tau0, b.t AS tau_fallback, c.t AS tau FROM (SELECT (30 + 5 * unnest(range(0, 14))) / 100.0::DOUBLE AS t) a
  JOIN (SELECT (30 + 5 * unnest(range(0, 14))) / 100.0::DOUBLE AS t) b ON a.t <= b.t JOIN (SELECT (30 + 5 * unnest(range(0, 14))) / 100.0::DOUBLE AS t) c ON b.t <= c.t),
ranked AS (SELECT s.s1, p, (o.cand IS NOT NULL)::INTEGER AS t, max(p) OVER (PARTITION BY s.s1) AS best,
           row_number() OVER (PARTITION BY s.s1 ORDER BY p DESC, (o.cand IS NOT NULL)::INTEGER DESC, s.cand DESC) AS rn FROM scored s LEFT JOIN owned o ON o.s1 = s.s1 AND o.cand = s.cand),
picked AS (SELECT s1, tau0, tau_fallback, tau, count(*) AS n_pred, sum(t) AS tp FROM ranked, g
           WHERE best >= tau0 AND CASE WHEN best >= tau THEN p >= tau ELSE best >= tau_fallback AND rn = 1 END GROUP BY ALL),
n AS (SELECT s1, count(*) AS n_true FROM owned GROUP BY s1)
SELECT tau0, tau_fallback, tau, round(avg(round(CASE WHEN n_true IS NULL AND n_pred IS NULL THEN 1.0::DOUBLE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE
  ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * coalesce(n_true, 0) + n_pred) END, 6)), 9) AS macro_f
FROM (SELECT entity_id AS s1 FROM recs WHERE source = 'S1') e CROSS JOIN g LEFT JOIN picked USING (s1, tau0, tau_fallback, tau) LEFT JOIN n USING (s1) GROUP BY ALL"""
)
def rule_sweep(recs):
    """Macro F of every three-threshold rule of the grid 0.30 to 0.95."""
    return D.sweep_rules(scored(recs), owned_truth(recs), s1_of(recs), [(30 + 5 * i) / 100 for i in range(14)])


@query(ORACLES["rule_sweep"].replace("SELECT tau0, tau_fallback, tau, round(avg(", "SELECT * FROM (SELECT tau0, tau_fallback, tau, round(avg(", 1) + ") ORDER BY macro_f DESC, tau0, tau_fallback, tau LIMIT 1")
def best_rule(recs):
    """The best rule of the sweep."""
    return D.best_rule(rule_sweep(recs))


@represented
def link_businesses(reps):
    """End to end over the full representation: channels, pruning, 88 features, boosted scores, policy, id lists."""
    reps = written(reps, "represented")
    rows = labelled(featured(reps))
    if rows.select("label").distinct().count() < 2:
        scores = rows.select("s1", "cand", F.col("block_score").alias("p"))  # nothing to learn from
    else:
        scores = M.score(rows, M.train_ensemble(rows, TRAINED, members=1, maxIter=5, maxDepth=4), TRAINED).select("s1", "cand", "p")
    entities = reps.where("source = 'S1'").select(F.col("entity_id").alias("s1"), "country")
    return D.id_lists(entities, L.decide(durable(scores), entities, L.Policy(tau0=0.1, tau=0.8, tau_fallback=0.5, country_taus={"fr": 0.7})))
