"""Whole texts are cut off as tables, not as checkpointed rows, which hold every text several times uncompressed."""

from tessera.operators import linkage
from tessera.plans import catalog


def test_features_checkpoint_no_texts(spark, sf_dir, monkeypatch):
    cut, durable = [], catalog.durable

    def noted(df):
        cut.append(set(df.columns))
        return durable(df)

    monkeypatch.setattr(catalog, "durable", noted)
    monkeypatch.setattr(linkage, "durable", noted)
    monkeypatch.setattr(catalog.P, "pair_features", lambda cands, reps: cands)  # how features are made does not matter here
    assert catalog.QUERIES["pair_features"](spark, sf_dir).count() > 0
    assert cut and not any(c & {"addr_words", "addr_norm", "token"} for c in cut)


def test_set_features_take_records_in_turns(spark, sf_dir, monkeypatch):
    P, pieces = catalog.P, []
    whole = sorted(catalog.QUERIES["set_features"](spark, sf_dir).collect())
    written = getattr(P, "written", None)

    def noted(df, name, **options):
        out = written(df, name, **options)
        if name == "features":
            pieces.append(out.count())
        return out

    monkeypatch.setattr(P, "written", noted, raising=False)
    monkeypatch.setattr(P, "SHARE", 1 << 20, raising=False)
    monkeypatch.setattr(P, "ROOM", 1 << 20, raising=False)
    assert sorted(catalog.QUERIES["set_features"](spark, sf_dir).collect()) == whole
    assert sum(pieces) == len(whole) > 2 * max(pieces, default=len(whole)), pieces
