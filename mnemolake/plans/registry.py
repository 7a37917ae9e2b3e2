"""Register a query under its operator name, with the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from mnemolake.sources.views import Tables, with_views

# What ranks compare, in SQL: a score at twelve significant digits. `SIGNIFICANT(column)` in a query's SQL stands for it.
SIGNIFICANT = (
    "CASE WHEN score = 0 THEN 0 ELSE sign(score) * round(abs(score) * pow(10, 11 - floor(log10(abs(score)))))"
    " * pow(10, floor(log10(abs(score))) - 11) END"
)
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, query_ids: bool = True):
    """`views`: names of the views the SQL starts from; without SQL the query is checked in tests only.
    `query_ids`: whether its result has query ids, if it starts from the view of queries."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = re.sub(
                r"SIGNIFICANT\((\w+)\)", lambda m: SIGNIFICANT.replace("score", m[1]), with_views(views, sql, query_ids)
            )
        return build

    return add
