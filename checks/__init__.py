"""Registered queries and their SQL twins, all over the given tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` query and, where SQL can say it, its twin."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def ctes(*names: str, then: str) -> str:
    """``WITH`` clause of the named views (in order, with what they need) plus a final select."""
    from checks.views import SQL_VIEWS, NEEDS
    order: list[str] = []

    def visit(n):
        for d in NEEDS.get(n, ()):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + "\n" + then
