"""All queries over the reference's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.plans import queries_code, queries_facts, queries_more, queries_work
from factgraph.plans.bridge import Facts, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _bind(f: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Facts(spark, sf_dir))


for _module in (queries_facts, queries_code, queries_work, queries_more):
    for _name, (_f, _sql) in _module.ALL.items():
        QUERIES[_name] = _bind(_f)
        if _sql:
            ORACLE_SQL[_name] = oracle(_sql)
