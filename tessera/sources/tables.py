"""The star-schema and corpus tables as temporary views."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Register the tables (those that the SQL names, if given) under their names."""
    for t in TABLES:
        if sql is None or re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
