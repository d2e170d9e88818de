"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of Tables under its own name."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if oracle:
            ORACLES[make.__name__] = oracle
        return make

    return register


def six(df: DataFrame, *skip: str) -> DataFrame:
    """Doubles to six places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def rounded(*names: str) -> str:
    """The same in SQL."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
