"""The queries of the ten operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, chat, decontaminate, idfiles, langid, lm, passages, quality, simhash, urls

MODULES = (lm, chat, quality, langid, bpe, passages, urls, idfiles, decontaminate, simhash)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
