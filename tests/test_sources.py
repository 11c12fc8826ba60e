import pytest

from tessera.functions import normalize as N
from tessera.sources import tabular as T


def test_records_round_trip(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "b" c\t\tUS\nS1-2\t\tx y\tIN\n')
    rows = [tuple(r) for r in T.read_records(spark, str(path), quoting=False).collect()]
    assert rows == [("S1-1", 'A "b" c', "", "US"), ("S1-2", "", "x y", "IN")]
    with pytest.raises(ValueError):
        T.read_records(spark, str(path), columns=("a", "b"))


def test_id_lists(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-2,S3-1"), ("S1-2", "")], "s1 string, ids string")
    T.write_id_lists(lists, str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"))
    back = T.read_records(spark, str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"), quoting=False)
    assert sorted(map(tuple, T.truth_pairs(back, "source1_entity_id", "matched_entity_ids").collect())) == [("S1-1", "S2-2"), ("S1-1", "S3-1")]


def test_findings(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-9", "S1-2,Q-1")], "s1 string, ids string")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    got = {r.rule: r.n for r in T.findings(lists, entities).collect()}
    assert got == {"duplicate_row": 1, "missing_row": 1, "extra_row": 1, "duplicate_id": 1, "self_match": 1, "wrong_prefix": 1}


def test_normalize():
    assert N.normalize("  Çafé & Straße​-Œuvre™ №5 ") == "cafe and strasse oeuvretm no5"
    assert N.normalize(None) == "" and N.normalize("क्रि!") == "क्रि"


def test_segment():
    costs = {"acme": 3.0, "global": 4.0, "foods": 5.0, "glob": 9.0}
    assert N.segment("acmeglobalfoods", costs) == ["acme", "global", "foods"]
    assert N.segment("acmexglobal", costs) == ["acme", "x", "global"]
    assert N.segment("acme", costs) == ["acme"] and N.segment("zzzzzzzzz", costs) == ["zzzzzzzzz"]
