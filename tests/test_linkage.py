import os

import duckdb
import pytest

from tessera.functions import similarity as S
from tessera.operators import decide as D
from tessera.plans import catalog


def frame(rows):
    cols = sorted(rows.columns)
    return rows[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = frame(catalog.QUERIES[name](spark, sf_dir).toPandas())
    want = frame(con.sql(catalog.ORACLES[name]).df())
    assert got.equals(want)


def test_entry_names():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert catalog.FLAGSHIP in queries and set(entry.oracle_sql()) <= set(queries)


def test_similarities_by_hand():
    assert S.lcs("kitten", "sitting") == 4
    assert S.indel("kitten", "sitting") == pytest.approx(8 / 13)
    assert S.token_sort("b a", "a b") == 1.0
    assert S.partial("abc", "xxabcxx") == 1.0
    assert S.token_set("acme inc", "acme inc global") == 1.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.lcs_ratio("", "") == 1.0 and S.indel("", "a") == 0.0


def test_threshold_rule_and_ownership(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.85), ("b", "x", 0.9), ("b", "z", 0.3), ("c", "z", 0.5), ("d", "w", 0.05)], "s1 string, cand string, p double")
    kept = D.threshold_rule(rows, 0.1, 0.8, 0.4)
    assert sorted(map(tuple, kept.collect())) == [("a", "x", 0.9), ("a", "y", 0.85), ("b", "x", 0.9), ("c", "z", 0.5)]
    assert sorted((r.s1, r.cand) for r in D.one_to_one(kept).collect()) == [("a", "x"), ("a", "y"), ("c", "z")]


def test_fbeta_cases(spark):
    entities = spark.createDataFrame([(e,) for e in "abcde"], "s1 string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z"), ("d", "q")], "s1 string, cand string")
    predicted = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "w"), ("b", "v"), ("d", "q")], "s1 string, cand string")
    f = {r.s1: r.f for r in D.entity_scores(entities, truth, predicted).collect()}
    assert f == {"a": 0.714286, "b": 0.0, "c": 0.0, "d": 1.0, "e": 1.0}


def test_id_lists(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "s1 string")
    pairs = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "s1 string, cand string")
    assert sorted(map(tuple, D.id_lists(entities, pairs).collect())) == [("a", "x,y"), ("b", "")]
