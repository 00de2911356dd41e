"""All registered queries of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import blocks, ops, retrieve, review, sources, tree

MODULES = (blocks, tree, retrieve, review, ops, sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for m in MODULES for name, (_, sql) in m.Q.items() if sql}
