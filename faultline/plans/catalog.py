"""Registry of queries and of the SQL that checks them."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import views
from faultline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}  # derived tables the checking SQL may name


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register


class Tables:
    """The derived CI tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in views.VIEWS:
            return views.spark_view(self.spark, self.sf_dir, f"fx_{name}")
        raise AttributeError(name)

    def raw(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return tables.spread(df, views.ROW_KEYS[table]) if table in views.ROW_KEYS else df


def needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\b(?:fx|sh|sd)_\w+", sql):
        if name in seen:
            continue
        if name in views.VIEWS:
            seen.append(name)
        elif name in SHARED:
            needed(SHARED[name], seen)
            seen.append(name)
    return seen


def with_tables(sql: str) -> str:
    """Prefix the SQL with the definitions of the derived tables it names."""
    parts = [
        f"{n} AS MATERIALIZED ({views.duck_view(n) if n in views.VIEWS else SHARED[n]})"
        for n in needed(sql, [])
    ]
    if not parts:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(parts) + " " + body
