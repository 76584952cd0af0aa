"""Uniform shuffle into shards of exact size, in DataFrame functions only.

Documents fall into about sqrt(N) local partitions. How many of each partition go to each
shard is drawn first: a matrix with the partitions' sizes as row sums and the shards' sizes
as column sums, from the multivariate hypergeometric law that a uniform shuffle of all
documents would follow. Each partition is then permuted and dealt out by its row of the
matrix, and each shard is permuted again. All draws come from the seed and the documents,
so reruns agree.

Only the partitions' sizes and the matrix pass through the driver, about sqrt(N) rows.
Both permutations order by random keys inside groups of about sqrt(N) documents. Null ids
and texts are values like others; rows that repeat in full are interchangeable. An empty
table gives no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain

SHARDS = 8
SEED = 20240601


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good, by inversion around the mode.

    The chances are taken in a window of twelve standard deviations and more; what lies
    outside is below the rounding of a double.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(total - 1, 1))
    reach = int(12 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    chance = np.concatenate(([0.0], np.cumsum(ratio)))
    chance = np.exp(chance - chance.max())
    sums = np.cumsum(chance)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(sizes: list[int], room: list[int], seed: int) -> list[list[int]]:
    """Documents from each partition to each shard; ``room`` sums to the sum of ``sizes``."""
    rng = np.random.default_rng(seed)
    room, matrix = list(room), []
    for size in sizes:
        row, left, others = [], size, sum(room)
        for place in room:
            others -= place
            row.append(hypergeometric(rng, place, others, left))
            left -= row[-1]
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def uniform_shards(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): size in UTF-8 bytes plus 1, slot from 0 in each shard.

    Shards differ by one document at most.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    drawn = keep(
        plain(docs, doc_id=id_col, text=text_col).select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("first"),
            F.xxhash64(F.lit(seed + 1), "doc_id", text).alias("second"),
        ),
        "shard-documents",
    )
    n = drawn.count()
    groups = max(1, math.isqrt(n))
    placed = drawn.withColumn("part", F.pmod(F.shiftrightunsigned("first", 20), F.lit(groups)))
    sizes = dict(placed.groupBy("part").count().collect())  # about sqrt(N) rows
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shard_sizes(n, shards), seed)
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(parts, matrix)],
        "part long, bounds array<long>",
    )
    local = F.row_number().over(Window.partitionBy("part").orderBy("first", "second")) - 1
    dealt = (
        placed.withColumn("place", local)
        .join(bounds, "part")
        .select(
            "doc_id", "size", "text_crc32", "first", "second",
            F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard"),
            F.pmod(F.shiftrightunsigned("second", 20), F.lit(groups)).alias("bucket"),
        )
    )
    dealt = keep(dealt, "shard-exchange")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("second", "first")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).alias("slot"))
    )
