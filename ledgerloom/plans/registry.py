"""Registered queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["compare_queries", "text_queries", "evidence_queries", "record_queries", "nested_queries", "source_queries", "routing_queries", "question_queries", "ingest_queries", "display_queries"]
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def load() -> None:
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")


def queries() -> dict:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
