"""Every registered query and, where SQL can say it, the same in DuckDB's dialect.

A module lists its queries by decorating functions of (spark, sf_dir) with ``query``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("vectors", "registers", "ranking", "lexical", "language", "texts", "maintenance", "recordings", "media", "privacy", "evaluation", "more", "details", "engine_queries", "upkeep")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries and _queries[name] is not f:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def relational(name: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL that Catalyst plans; raw tables and those of the catalog as {name}. The oracle is the same text unless its dialect differs."""
    text, oracle = catalog.expand(text), catalog.expand(text if oracle is None else oracle)
    used = [t for t in TABLES if "{" + t + "}" in text]
    text_of = text.replace("{", "{{").replace("}", "}}")  # braces of patterns are not placeholders
    for t in used:
        text_of = text_of.replace("{{" + t + "}}", "{" + t + "}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text_of, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    query(name, raw(oracle))(run)


def raw(sql: str) -> str:
    """Oracle text with the catalog's and the raw tables in place of their names in braces."""
    sql = catalog.expand(sql).replace("element_at(", "list_extract(")
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the catalog."""
    return sql(spark, sf_dir, catalog.VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the catalog's and the raw tables, their names in braces."""
    text = catalog.expand(text)
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"orrery.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
