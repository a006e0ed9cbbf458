"""The queries of the core engine and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import register
from . import audit, batch, branches, branches_sql, evaluate, frames, oracles, text
from .fixtures import with_fixtures

#: Where DuckDB writes something otherwise.
_DUCK = (("LEFT ANTI JOIN", "ANTI JOIN"), ("LEFT SEMI JOIN", "SEMI JOIN"))
_DUCK_NAMES = {"filter": "list_filter", "transform": "list_transform", "size": "len", "sequence": "generate_series", "rlike": "regexp_matches", "explode": "unnest", "try_element_at": "list_extract", "array_sort": "list_sort", "array_join": "array_to_string", "get_json_object": "json_extract_string", "percentile": "quantile_cont", "collect_list": "list"}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, sql)
        return spark.sql(sql)

    return run


def _duck(sql: str) -> str:
    for ours, theirs in _DUCK:
        sql = sql.replace(ours, theirs)
    sql = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
    return re.sub(r"\b([a-z_]+)\(", lambda m: f"{_DUCK_NAMES.get(m[1], m[1])}(", sql)


SQL = {name: with_fixtures(q) for part in (evaluate, batch, audit, text) for name, q in part.SQL.items()}
assert branches
#: Queries are built from operators (frames); the SQL is what checks them. Only a name without a frame runs its SQL.
QUERIES = {name: _query(q) for name, q in SQL.items()} | frames.QUERIES
ORACLES = {name: _duck(q) for name, q in SQL.items()} | {name: with_fixtures(q) for name, q in (oracles.ORACLES | branches_sql.ORACLES).items()}
