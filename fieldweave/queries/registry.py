"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their time in seconds and the number in their properties."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t, F.get_json_object("props", "$.k").cast("int").alias("k"))


#: The same in SQL.
EVENTS = "ev as (select event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 as t, cast(json_extract_string(props, '$.k') as int) as k from events)"
