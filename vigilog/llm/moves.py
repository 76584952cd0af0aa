"""Deciding rows by a table of keys without moving the rows that it does not decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.session import ship_package

BLOOM_BITS = 26  # of a filter: 8 MB, whatever the number of keys
SALTS = 16  # places in which rows of one key meet the row that belongs to them


def filled(keys: DataFrame, key: str = "key") -> np.ndarray:
    """A filter, of a fixed number of bits, of 64-bit hashes; repeated and null ones are harmless."""
    place = F.shiftrightunsigned(key, 64 - BLOOM_BITS)
    words = (
        keys.where(F.col(key).isNotNull())
        .select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"))
    )
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    for batch in words.toArrow().to_batches():  # 2**(BLOOM_BITS - 6) rows at most
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in a filter; all that are in it are among them."""
    keys = keys.view(np.uint64)
    place = keys >> np.uint64(64 - BLOOM_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def may_be_in(keys: DataFrame, column: Column, key: str = "key") -> Column:
    """Whether a column of 64-bit hashes may hold one of ``keys``; only that column goes to Python."""
    spark = ship_package(keys.sparkSession)
    told = spark.sparkContext.broadcast(filled(keys, key))

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(maybe(told.value, values.to_numpy(np.int64)))

    return found(column)


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join to a table with one row a key, where a few keys may have very many rows."""
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
