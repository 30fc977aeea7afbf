"""Registered queries: name -> function of (spark, sf_dir), and the same question as SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: str = "er"):
    """Registers an operator applied to the projected test tables. over: the prepared relation that both sides start from."""

    def register(f: Callable[[DataFrame], DataFrame]):
        from timeloom.sources import fixture

        QUERIES[name] = lambda spark, sf_dir: f(fixture.RELATIONS[over](spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixture.WITH[over] + sql
        return f

    return register
