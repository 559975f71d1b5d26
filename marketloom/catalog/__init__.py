"""Registered queries: name -> callable over (spark, folder), and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import rounded
from ..sources import Tables

QUERIES: dict = {}
SQL: dict = {}


LONGS = {"rank", "portfolio", "utc_from", "hour", "trades_today", "n_events", "level", "lag", "pos", "k", "rev", "step"}


def _output(df):
    """Round doubles and widen counters to long, the type the SQL form gives them."""
    wide = {f.name: F.col(f.name).cast("long") for f in df.schema.fields if f.name in LONGS and isinstance(f.dataType, T.IntegerType)}
    df = df.drop("_i", "_n")  # positions of an indexed view
    return rounded(df.withColumns(wide) if wide else df)


def query(name: str, sql: str | None = None):
    """Register f(Tables) -> DataFrame under a name; doubles are rounded at output."""

    def deco(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: _output(f(Tables(spark, folder)))
        if sql:
            SQL[name] = sql
        return f

    return deco


def load() -> None:
    from . import (decisions, equity, features, flow, models, portfolio, quality, risk, sources, streams, structure, ticks, trades, universe)  # noqa: F401
