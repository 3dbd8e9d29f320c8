"""The subpackage's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import backoff, codes, decontaminate, divergence, language, mixture, neardup, planes, quality, secrets, shards, tokens, urls

_MODULES = (decontaminate, tokens, quality, secrets, mixture, neardup, urls, planes, shards, language, backoff, divergence, codes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
