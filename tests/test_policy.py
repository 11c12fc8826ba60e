"""Settings, decisions from saved scores, outside scores, comparisons, score tables, registered functions, block joins."""

import json
import math

import numpy as np
import pytest

from tessera.functions import registry
from tessera.operators import decide as D
from tessera.operators import linkage as L
from tessera.operators import represent as E
from tessera.operators import scoring as M
from tessera.operators import topk
from tessera.sources import tabular as T

PAIRS = "s1 string, cand string, p double"


def test_settings_round_trip():
    policy = L.Policy(field_weights={"India": (0.7, 1.0, 0.5)}, country_taus={"France": 0.9}, tau=0.85)
    assert L.Policy.from_json(policy.to_json()) == policy
    with pytest.raises(ValueError, match="representation"):
        L.Policy.from_json(json.dumps({"representation": "older"}))
    with pytest.raises(ValueError, match="unknown"):
        L.Policy.from_json(json.dumps({"taw": 1}))


def test_policy_decides_by_country(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.7), ("b", "y", 0.75), ("c", "z", 0.6)], PAIRS)
    entities = spark.createDataFrame([("a", "US"), ("b", "FR"), ("c", "FR")], "s1 string, country string")
    kept = L.decide(scored, entities, L.Policy(tau0=0.0, tau=0.8, tau_fallback=0.8, country_taus={"FR": 0.7}))
    assert sorted((r.s1, r.cand) for r in kept.collect()) == [("a", "x"), ("b", "y")]
    lists = {(r.tau, r.s1): r.ids for r in D.redecide(scored, entities, [0.65, 0.8], {"FR": 0.55}).collect()}
    assert lists == {(0.65, "a"): "x", (0.65, "b"): "y", (0.65, "c"): "z", (0.8, "a"): "x", (0.8, "b"): "y", (0.8, "c"): "z"}


def test_outside_scores(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5)], PAIRS)
    other = spark.createDataFrame([("a", "x", 0.1), ("q", "q", 0.3)], "s1 string, cand string, nn double")
    rows = {r.cand: r for r in D.with_outside_scores(scored, other, "nn", 0.5).collect()}
    assert rows["y"].blended == pytest.approx(0.5) and rows["x"].blended == pytest.approx(0.5) and len(rows) == 2


@pytest.mark.parametrize("n, want", [(1, 0.9), (2, 0.9), (3, 0.5), (5, 0.1), (99, 0.1)])
def test_nth_largest(spark, n, want):
    rows = spark.createDataFrame([(0.9,), (0.9,), (0.5,), (0.4999,), (0.1,), (None,)], "p double")
    assert D.nth_largest(rows, "p", n).first().tau == want
    assert D.nth_largest(rows.limit(0), "p", n).count() == 0


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(0)
    x = rng.random(400)
    rows = spark.createDataFrame([(f"e{i}", float(v)) for i, v in enumerate(x)] + [("none", None)], "s1 string, f double")
    got = D.bootstrap_interval(rows, "s1", "f", resamples=500).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert got["mean"] == pytest.approx(x.mean()) and got.low == pytest.approx(x.mean() - half, abs=half / 3) and got.high == pytest.approx(x.mean() + half, abs=half / 3)
    assert got == D.bootstrap_interval(rows.repartition(3), "s1", "f", resamples=500).first() or got.low == pytest.approx(D.bootstrap_interval(rows, "s1", "f", resamples=500).first().low)


def test_compare_and_dump(spark):
    truth = spark.createDataFrame([(f"e{i}", f"c{i}") for i in range(20)], "s1 string, cand string")
    rows = [(f"e{i}", f"{k}{i}", 0.9 if k == "c" else 0.2, 0.4 if k == "c" else 0.6) for i in range(20) for k in "cd"]
    scored = spark.createDataFrame(rows, "s1 string, cand string, good double, bad double")
    roles = spark.createDataFrame([(f"e{i}", "tune" if i % 2 else "report") for i in range(20)], "s1 string, role string")
    got = {r.model: (r.tau, r.macro_f) for r in M.compare_scores(scored, truth, roles, ["good", "bad"], [0.1, 0.5, 0.7]).collect()}
    assert got["good"] == (0.5, 1.0) and got["bad"][1] < 1
    stage = spark.createDataFrame([("e1", "c1", "S2", 1.0, 0.7), ("zz", "c1", "S2", 0.0, 0.1)], "s1 string, cand string, source string, label double, p double")
    assert [tuple(r) for r in M.pair_dump(stage, roles).collect()] == [("e1", "c1", "S2", 1.0, 0.7, "tune")]


def test_score_tables(spark, tmp_path):
    scored = spark.createDataFrame([(f"a{i}", f"c{i}", i / 100) for i in range(100)], PAIRS)
    T.write_scores(scored, str(tmp_path / "s"))
    back = T.read_scores(spark, str(tmp_path / "s"), 0.9)
    assert back.count() == 10 and "PushedFilters: [IsNotNull(p), GreaterThanOrEqual(p,0.9)]" in back._jdf.queryExecution().toString()


def test_files_of_lists(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("wrong\theader\nS1-1\tS2-1,S2-9\nS1-2\nS1-3\ta\tb\n")
    entities = spark.createDataFrame([("S1-1",)], "s1 string")
    known = spark.createDataFrame([("S2-1",)], "cand string")
    got = {r.rule: r.n for r in T.file_findings(spark, str(tmp_path / "x.tsv"), ("s1", "ids"), entities, known=known).collect()}
    assert (got["bad_header"], got["malformed_row"], got["unknown_id"], got["missing_row"]) == (1, 2, 1, 0)
    (tmp_path / "r.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA\tB\tUS\n")
    assert [tuple(r) for r in T.read_records(spark, str(tmp_path / "r.tsv"), wanted=("country", "entity_id")).collect()] == [("US", "S1-1")]


def test_dictionaries_and_addresses(spark, tmp_path):
    learnt = spark.createDataFrame([("\u0932", "la", 3)], "word string, latin string, n long")
    E.save_transliterations(learnt, str(tmp_path / "d"))
    assert [tuple(r) for r in E.load_transliterations(spark, str(tmp_path / "d")).collect()] == [("\u0932", "la", 3)]
    reps = E.represent(spark.createDataFrame([("S1-1", "S1", "IN", "x", "\u0932\u0915 12")], "entity_id string, source string, country string, business_name string, business_address string"))
    row = reps.first()
    assert row.addr_script == "Devanagari" and row.addr_skeleton.endswith("12") and row.addr_skeleton.isascii()


def test_registered_functions(spark):
    names = registry.register(spark)
    assert "tessera_name_core" in names and len(names) == 12
    row = spark.sql("SELECT tessera_name_norm('Acme Svcs, Ltd') AS a, tessera_normalize_text(NULL) AS b, tessera_indel_ratio('kitten', 'sitting') AS c").first()
    assert (row.a, row.b) == ("acme services ltd", "") and row.c == pytest.approx(8 / 13)


@pytest.mark.parametrize("blocks", [(4096, 8192, 128), (7, 5, 1)])
def test_block_lists_equal_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ASKED_BLOCK", "POOL_BLOCK", "LEAST_BLOCK"), blocks):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)

    def side(prefix, n):
        return [(g, f"{prefix}{i:03d}", [(int(h), float(rng.integers(1, 4))) for h in rng.choice(12, int(rng.integers(0, 6)), replace=False)], i % 5 == 0) for g in "xy" for i in range(n)]

    asked, pool = side("a", 30), side("p", 40)
    schema = "g string, id string, v array<struct<h: long, w: double>>, bare boolean, asks boolean"
    found = topk.best_pairs(spark.createDataFrame([(*r, True) for r in asked] + [(*r, False) for r in pool], schema), ["g"], 3, 2, 1).collect()
    got = {(r.g, r.s1, r.cand): r.score for r in found}
    every = {(g, a, c): sum(w * dict(v2).get(h, 0) for h, w in v) for g, a, v, _ in asked for g2, c, v2, _ in pool if g == g2}
    every = {k: s for k, s in every.items() if s > 0}
    assert all(every[k] == s for k, s in got.items()) and len(found) == len(got)
    bare = {(g, c) for g, c, _, b in pool if b}

    def best(rows, n):
        return set(sorted(rows, key=lambda k: (-every[k], k[1], k[2]))[:n])

    for g, a in {(g, a) for g, a, _, _ in asked}:
        mine = [k for k in every if k[:2] == (g, a)]
        assert best(mine, 3) | best([k for k in mine if (g, k[2]) in bare], 1) <= got.keys()
    for g, c in {(g, c) for g, c, _, _ in pool}:
        assert best([k for k in every if (k[0], k[2]) == (g, c)], 2) <= got.keys()
