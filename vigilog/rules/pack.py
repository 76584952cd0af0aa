"""Rules as rows: the packaged pack, rule files, and their table form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("require_fields", T.BooleanType()),
        T.StructField("falsepositives", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("author", T.StringType()),
        T.StructField("detection", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    level: str
    status: str
    log_source: str
    detection: dict[str, Any]
    enabled: bool = True
    require_fields: bool = False
    falsepositives: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    author: str = "Unknown"


def _with_defaults(df: DataFrame) -> DataFrame:
    """Rule rows with missing values filled; rows without a detection are dropped."""
    no_strings = F.array().cast("array<string>")
    return df.where(F.col("detection").isNotNull()).select(
        F.coalesce("id", "stem").alias("id"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("level", F.lit("medium")).alias("level"),
        F.coalesce("status", F.lit("experimental")).alias("status"),
        F.coalesce("log_source", "folder").alias("log_source"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("require_fields", F.lit(False)).alias("require_fields"),
        F.coalesce("falsepositives", no_strings).alias("falsepositives"),
        F.coalesce("references", no_strings).alias("references"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        "detection",
    )


def _placed(df: DataFrame) -> DataFrame:
    """File name without its ending and the name of the pack folder of each row."""
    path = F.input_file_name()
    return df.withColumn("stem", F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)).withColumn(
        "folder", F.lower(F.regexp_extract(path, r"(?i)/(linux|windows|nginx|zeek_conn)/", 1))
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from JSON-lines files, one rule per line.

    ``log_source`` falls back to the pack folder (linux, windows, nginx) in the path.
    """
    reader = spark.read.schema(RULE_SCHEMA).option("recursiveFileLookup", "true")
    return _with_defaults(_placed(reader.json(path)))


def read_yaml_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from a folder tree of YAML files, one rule per file.

    Files whose name ends in ``.disabled`` are left out. Needs a YAML package.
    """
    @F.pandas_udf("string")
    def to_json(texts: pd.Series) -> pd.Series:
        import yaml

        def convert(text: str) -> str | None:
            try:
                row = yaml.safe_load(text)
            except yaml.YAMLError:
                return None
            if not isinstance(row, dict) or "detection" not in row:
                return None
            # The pack folder names the source of a rule, its own logsource does not.
            row = {k: v for k, v in row.items() if k != "logsource"}
            return json.dumps(row, default=str)

        return texts.map(convert)

    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.yml")
        .text(path, wholetext=True)
    )
    rows = _placed(files).withColumn("row", F.from_json(to_json("value"), RULE_SCHEMA))
    return _with_defaults(rows.select("stem", "folder", "row.*"))


def packaged_rows() -> list[dict[str, Any]]:
    text = resources.files("vigilog.rules").joinpath("pack.json").read_text("utf-8")
    return [json.loads(line) for line in text.splitlines() if line.strip()]


def rule_from_row(row: dict[str, Any]) -> Rule:
    detection = row["detection"]
    return Rule(
        id=row["id"],
        title=row.get("title") or "Unknown",
        description=row.get("description") or "",
        level=row.get("level") or "medium",
        status=row.get("status") or "experimental",
        log_source=row["log_source"],
        detection=json.loads(detection) if isinstance(detection, str) else detection,
        enabled=row.get("enabled") is not False,
        require_fields=bool(row.get("require_fields")),
        falsepositives=list(row.get("falsepositives") or []),
        references=list(row.get("references") or []),
        author=row.get("author") or "Unknown",
    )


def packaged_rules() -> list[Rule]:
    return [rule_from_row(row) for row in packaged_rows()]


def collect_rules(table: DataFrame) -> list[Rule]:
    """Rules of a rule table, for compilation on the driver, in the table's order.

    Rows come a partition at a time; what is kept is the rules alone. A rule that counts in
    a way without meaning is refused (``compiler.check_counts``).
    """
    from vigilog.rules.compiler import check_counts

    return [check_counts(rule_from_row(row.asDict(recursive=True))) for row in table.toLocalIterator()]


def rules_frame(spark: SparkSession, rows: list[dict[str, Any]] | None = None) -> DataFrame:
    """Rule table of the packaged pack, or of the given rule rows."""
    data = [
        {**row, "detection": json.dumps(row["detection"]) if "detection" in row else None}
        for row in (packaged_rows() if rows is None else rows)
    ]
    names = RULE_SCHEMA.fieldNames()
    df = spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], RULE_SCHEMA)
    return _with_defaults(
        df.withColumn("stem", F.lit("rule")).withColumn("folder", F.lit(None).cast("string"))
    )


def active_rules_for_source(table: DataFrame, source: str) -> DataFrame:
    """Enabled rules of a source, and those of no source in particular."""
    return table.where(
        F.col("enabled") & ((F.col("log_source") == source) | F.col("log_source").isNull())
    )


def rule_inventory(table: DataFrame) -> DataFrame:
    """Rules per source, level and state."""
    return table.groupBy("log_source", "level", "enabled").agg(F.count("*").alias("rules"))
