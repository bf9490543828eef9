"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicker.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """A named piece of oracle SQL; `needs` lists the pieces it reads."""
    _CTES[name] = (body.strip(), needs)


def compose(body: str, *needs: str) -> str:
    """The query with all pieces it needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _CTES[name][1]:
            visit(other)
        done.append(name)

    for name in needs:
        visit(name)
    body = body.strip()
    if not done:
        return body
    pieces = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in done)
    return f"WITH RECURSIVE {pieces}\n{body}"


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query, with its oracle SQL where there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql, *needs)
        return fn

    return wrap
