"""Registry of named queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions.parsers import STORED_TIME
from vigilog.plans.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``sql`` may name the views."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return times_as_text(fn(Tables(spark, sf_dir)))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def times_as_text(df: DataFrame) -> DataFrame:
    """Timestamps as text of whole seconds, which both engines print alike."""
    return df.select(
        *[
            F.date_format(f.name, STORED_TIME).alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sql_time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
