"""Registered queries: a Spark function and, where SQL can say it, the same question for an oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    from queries import cleaning, comparing, costs, encoding, forecasting, masking, names, repairing, runs, scoring  # noqa: F401
