"""Name → (function of Tables, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from textlab.plans.tables import Tables


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


class Registry(dict):
    def add(self, key: str, sql: str | None = None):
        """Decorator that files a query under its key."""

        def file(run):
            if key in self:
                raise ValueError(f"duplicate query {key}")
            self[key] = Query(run, sql)
            return run

        return file


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded for comparison; dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
