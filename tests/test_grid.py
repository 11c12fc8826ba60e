import numpy as np
import pytest

from tessera.operators import blocking as B
from tessera.operators import ngrams as G
from tessera.operators import topk
from tessera.operators.records import records_of_documents


@pytest.fixture(scope="module")
def recs(spark, sf_dir):
    return records_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).localCheckpoint()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("weights", [None, {"fr": (0.7, 1.0, 0.5)}])
def test_many_blocks_give_the_lists_of_one(spark, recs, monkeypatch, weights):
    def lists():
        pairs = B.scored_pairs(recs, field_weights=weights)
        # tokens and copies of blocks were exchanged for every later read
        assert "Exchange" not in plan(pairs) and "FlatMapGroupsInArrow" not in plan(pairs)
        return sorted(map(tuple, B.top_k(pairs).collect())), sorted(map(tuple, B.reverse_top(pairs).collect()))

    whole = lists()
    assert whole[0] and whole[1]
    for name, value in (("ASKED_BLOCK", 9), ("POOL_BLOCK", 11), ("LEAST_BLOCK", 1)):
        monkeypatch.setattr(topk, name, value)
    assert lists() == whole


def test_grams_in_many_blocks(spark, recs, monkeypatch):
    texts = recs.selectExpr("country", "source", "entity_id AS id", "name_key AS text")
    s1, pool = texts.where("source = 'S1'").drop("source"), texts.where("source <> 'S1'")
    indexed = G.top_matches(s1, G.gram_index(s1, pool))
    for name, value in (("ASKED_BLOCK", 9), ("POOL_BLOCK", 11), ("LEAST_BLOCK", 1)):
        monkeypatch.setattr(topk, name, value)
    found = G.gram_top_k(s1, pool)
    assert "SortMergeJoin" not in plan(found) and "FlatMapGroupsInArrow" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, indexed.collect()))


@pytest.mark.parametrize("limits", [(256, 1 << 17, 0.05, 1024), (7, 40, 0.3, 3), (5, 1, 2.0, 0)])
def test_cell_equals_brute_force(monkeypatch, limits):
    for name, value in zip(("CHUNK", "PRODUCTS", "DENSE", "DENSE_TOKENS"), limits):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)

    def side(n, vocabulary):
        lists = [rng.choice(vocabulary, min(len(vocabulary), int(rng.integers(0, 9))), replace=False) for _ in range(n)]
        tok = rng.permutation(vocabulary)
        code = np.array([np.flatnonzero(tok == t)[0] for x in lists for t in x], dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        block = topk.Block(n, starts, code, np.zeros(0), tok, np.zeros(len(tok)))
        w = rng.integers(0, 3, len(code)) / 2
        full = np.zeros((n, 40))
        full[block.row, tok[code]] = w
        return topk.Side(block, w), full

    (asked, a), (pool, p) = side(30, np.arange(30)), side(90, np.arange(5, 40))
    bare = rng.random(90) < 0.1
    row, col, score = topk.cell_lists(asked, pool.by_token(4), bare, 4, 2, 1, 0.4)
    got = dict(zip(zip(row.tolist(), col.tolist()), score))
    every = np.round(a @ p.T, 6)
    want = set()
    for i in range(30):
        for among, n in ((np.arange(90), 4), (np.flatnonzero(bare), 1)):
            order = among[np.argsort(-every[i, among], kind="stable")]
            want |= {(i, int(j)) for j in order[:n] if every[i, j] > 0.4}
    for j in range(90):
        want |= {(int(i), j) for i in np.argsort(-every[:, j], kind="stable")[:2] if every[i, j] > 0.4}
    assert set(got) == want and all(every[k] == s for k, s in got.items())


def test_block_of_many_tokens_is_cut(spark):
    rows = [("x", "S2", f"r{i:02d}", False, [1, 2, 2, i]) for i in range(20)] + [("x", "S2", "r00", False, [2, 99])]
    table = topk.packed(spark.createDataFrame(rows, "country string, source string, id string, bare boolean, h array<long>"), ["country", "source"], topk.F.lit(3))
    df = {r.h: r.n for r in topk.block_tokens(table, ["country", "source"]).groupBy("h").agg(topk.F.sum("df").alias("n")).collect()}
    assert df[1] == 20 and df[2] == 20 and df[99] == 1 and table.count() == 3
