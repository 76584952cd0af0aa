"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigilog.session import shared_dir, ship_package


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows reads the files, so a lost executor costs a reread and never the
    work before; values drawn while writing (row numbers) are the same for every use.
    """
    return keep_at(df, name)[0]


def keep_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``keep`` and the folder written, for tables that ``forget`` removes again."""
    spark = ship_package(df.sparkSession)
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names.

    ``columns`` maps the operator's names to those of ``df``; whatever else ``df``
    holds, even under a clashing name, is left behind.
    """
    return df.select(*[df[theirs].alias(ours) for ours, theirs in columns.items()])
