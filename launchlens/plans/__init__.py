"""Catalog of runnable queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable together with its oracle SQL."""

    def add(fn):
        assert name not in CATALOG, name
        CATALOG[name] = (fn, sql)
        return fn

    return add


def load() -> dict:
    from launchlens.plans import (  # noqa: F401
        closes, features, joins, labels, learning, ledger, market, policy, streams, trades, wallets,
    )

    return CATALOG
