"""The engine's text functions under names that spark.sql() knows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from tessera.functions import similarity as S
from tessera.functions.business import address_words, name_core, name_words
from tessera.functions.normalize import normalize
from tessera.functions.scripts import dominant, skeleton
from tessera.session import ship

ONE: dict[str, Callable[[str], str]] = {
    "normalize_text": normalize,
    "name_norm": lambda t: " ".join(name_words(t)),
    "name_core": lambda t: name_core(name_words(t)),
    "addr_norm": lambda t: " ".join(address_words(normalize(t))),
    "skeleton": skeleton,
    "dominant_script": dominant,
}
TWO: dict[str, Callable[[str, str], float]] = {
    "indel_ratio": S.indel, "token_sort_ratio": S.token_sort, "partial_ratio": S.partial, "token_set_ratio": S.token_set, "jaro_winkler": S.jaro_winkler, "lcs_ratio": S.lcs_ratio,
}


def _of_one(f: Callable[[str], str]) -> Callable:
    @pandas_udf("string")
    def kernel(a: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else "") for x in a], dtype=object)

    return kernel


def _of_two(f: Callable[[str, str], float]) -> Callable:
    @pandas_udf("double")
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        clean = lambda x: x if isinstance(x, str) else ""
        return pd.Series([f(clean(x), clean(y)) for x, y in zip(a, b)], dtype="float64")

    return kernel


def register(spark: SparkSession, prefix: str = "tessera_") -> list[str]:
    """Register every function with spark.sql() as prefix + name; null counts as the empty string. The names, sorted."""
    ship(spark)
    for name, f in ONE.items():
        spark.udf.register(prefix + name, _of_one(f))
    for name, f in TWO.items():
        spark.udf.register(prefix + name, _of_two(f))
    return sorted(prefix + name for name in (*ONE, *TWO))
