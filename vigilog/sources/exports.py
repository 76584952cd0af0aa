"""Event export in a nested schema, and encrypted alert export and import."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.parsers import event_attrs, event_objects
from vigilog.functions.text import strip

# The constants of every exported event.
ACTIVITY_ID = 1
CLASS_UID = 1001
SEVERITY_ID = 1
DEVICE_TYPE_ID = 1

ALERT_SCHEMA = (
    "alert_id string, title string, description string, severity string, resolved boolean, "
    "triggered_at string, hostname string, metadata string"
)


def ocsf_events(
    logs: DataFrame,
    servers: DataFrame,
    linux: DataFrame,
    source: str | None = None,
    product: str = "vigilog",
    vendor: str = "vigilog",
) -> DataFrame:
    """Logs as nested events; Linux events name their process, Windows ones their message."""
    found = logs if source is None else logs.where(F.col("log_source") == source)
    named = found.join(
        servers.select(F.col("id").alias("server_id"), "hostname", "ip_address"), "server_id"
    )
    process = linux.select(
        F.col("log_entry_id").alias("id"),
        F.struct(F.col("app_name").alias("name"), "pid").alias("process"),
    )
    joined = named.join(process, "id", "left")
    is_windows = F.col("log_source") == "windows"
    read = joined.withColumn(
        "_objects", F.when(is_windows, event_objects(strip(F.col("content"))))
    )
    message = F.coalesce(event_attrs(F.col("_objects"))["message"], F.col("content"))
    return read.select(
        "id",
        F.lit(ACTIVITY_ID).alias("activity_id"),
        F.lit(CLASS_UID).alias("class_uid"),
        F.unix_millis("recv_time").alias("time"),
        message.alias("message"),
        F.struct(
            "hostname", F.col("ip_address").alias("ip"), F.lit(DEVICE_TYPE_ID).alias("type_id")
        ).alias("device"),
        F.struct(
            F.struct(F.lit(product).alias("name"), F.lit(vendor).alias("vendor_name")).alias(
                "product"
            ),
            F.col("log_source").alias("original_source"),
        ).alias("metadata"),
        F.lit(SEVERITY_ID).alias("severity_id"),
        "process",
    )


def event_json(events: DataFrame) -> DataFrame:
    """Exported events as JSON text."""
    return events.select("id", F.to_json(F.struct(*events.columns)).alias("event"))


def _key(rows: DataFrame, key_hex: str) -> Column:
    """The key as a column whose value stands in no plan: tasks read it from a broadcast."""
    told = rows.sparkSession.sparkContext.broadcast(bytes.fromhex(key_hex))

    @F.pandas_udf("binary")
    def sealing_key(row: pd.Series) -> pd.Series:
        return pd.Series([told.value] * len(row))

    return sealing_key(F.lit(0))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Export rows of alerts joined to their server; metadata is JSON text."""
    metadata = F.to_json(F.struct("rule_id", "log_source", "log_entry_id"))
    return alerts.select(
        "alert_id", "title", "description", "severity", "resolved",
        F.date_format("triggered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("triggered_at"),
        F.coalesce("hostname", F.lit("Unknown")).alias("hostname"),
        metadata.alias("metadata"),
    )


def encrypt_alerts(rows: DataFrame, key_hex: str) -> DataFrame:
    """Each alert as base64 of AES-256-GCM nonce, ciphertext and tag."""
    if len(key_hex) != 64:
        raise ValueError("the key must be 32 bytes in hex")
    text = F.to_json(F.struct(*rows.columns))
    sealed = F.aes_encrypt(text, _key(rows, key_hex), F.lit("GCM"))
    return rows.select(F.regexp_replace(F.base64(sealed), r"\s", "").alias("encrypted_data"))


def decrypt_alerts(sealed: DataFrame, key_hex: str) -> DataFrame:
    """Alerts of an encrypted export; rows that do not decrypt are null."""
    text = F.try_aes_decrypt(F.unbase64("encrypted_data"), _key(sealed, key_hex), F.lit("GCM"))
    row = F.from_json(text.cast("string"), ALERT_SCHEMA)
    return sealed.select(row.alias("r")).select("r.*")
