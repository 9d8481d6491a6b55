"""Registry of user-level queries: name -> (Spark callable, DuckDB oracle).

Every callable takes ``(spark, sf_dir)``, reads the driver tables through the
fixture mapping and returns a DataFrame whose column names equal the oracle's.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.fixtures import fixture_logs

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None
    doc: str
    # For serving queries: the same query over an already materialized summary.
    serve: Callable[[SparkSession, DataFrame], DataFrame] | None = None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None, serve=None):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        REGISTRY[name] = Entry(wrapped, sql, doc, serve)
        return wrapped
    return deco


def serving(name: str, sql: str, serve: Callable[[SparkSession, DataFrame], DataFrame], summary_fn):
    """Register a query that runs over the agent summary: the registered
    callable derives the summary from the tables; ``serve`` takes a
    materialized summary (how the serving layer runs in production)."""
    def fn(spark, sf):
        return serve(spark, summary_fn(spark, sf))
    fn.__doc__ = serve.__doc__
    fn.__name__ = name
    return register(name, sql, serve)(fn)


def serving_query(name: str, sql: str, summary_fn):
    def deco(serve):
        serving(name, sql, serve, summary_fn)
        return serve
    return deco


_LOGS: "weakref.WeakKeyDictionary[SparkSession, dict[tuple, DataFrame]]" = weakref.WeakKeyDictionary()


def logs(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The fixture log plan (memoized per live session: the plan, not data)."""
    plans = _LOGS.setdefault(spark, {})
    key = (sf_dir.rstrip("/"), tuple(sorted(kw.items())))
    if key not in plans:
        plans[key] = fixture_logs(spark, sf_dir, **kw)
    return plans[key]


# Import the modules that register queries (order = listing order).
from . import queries_core  # noqa: E402,F401
from . import queries_serve  # noqa: E402,F401
from . import queries_meta  # noqa: E402,F401
from . import queries_names  # noqa: E402,F401
from . import queries_stream  # noqa: E402,F401
from . import queries_run  # noqa: E402,F401
from . import queries_index  # noqa: E402,F401
