"""Message templates: mask the variable parts, group, then merge near-equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.session import cut_lineage

WILDCARD = "<*>"
# Tokens that must agree for two messages to share a template.
SIMILARITY = 0.4
MASKS = [
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b\d+\b", "<NUM>"),
]


def mask_variables(message: Column) -> Column:
    for pattern, name in MASKS:
        message = F.regexp_replace(message, pattern, name)
    return message


def template_key(template: Column) -> Column:
    return F.xxhash64(template)


def masked_templates(messages: DataFrame, message: str) -> DataFrame:
    """Masked text, its token count and the number of messages that have it."""
    masked = mask_variables(F.col(message)).alias("template")
    counts = messages.groupBy(masked).agg(F.count("*").alias("size"))
    return counts.select(F.size(F.split("template", " ")).alias("tokens"), "template", "size")


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))


def _position_hash(seed: int):
    return lambda token, i: F.xxhash64(F.lit(seed), token, i)


def merge_templates(templates: DataFrame) -> DataFrame:
    """Merge templates that differ in one token, over and over until none does.

    Each template offers itself once per token position with that token replaced by
    a wildcard, and takes the replacement shared with most other templates. The
    first token is kept, and so is the required share of fixed tokens. Offers are
    128-bit hashes updated per position, so a template of n tokens costs n small
    rows, and templates meet by hash only: no pairs are formed and no group of
    templates is brought together.
    """
    spark = templates.sparkSession
    merged = cut_lineage(spark, templates.select("template", "size"), "templates")
    now = _state(merged)
    while True:
        # Each round is written, so that the next does not repeat the ones before.
        merged = cut_lineage(spark, _merge_once(merged), "templates")
        before, now = now, _state(merged)
        if now == before:
            break
    return merged.select(F.size(F.split("template", " ")).alias("tokens"), "template", "size")


def _state(templates: DataFrame) -> tuple:
    return tuple(templates.agg(F.count("*"), F.bit_xor(template_key(F.col("template")))).first())


def _merge_once(templates: DataFrame) -> DataFrame:
    tokens = F.split("template", " ")
    hashed = templates.select(
        "template",
        "size",
        tokens.alias("tokens"),
        F.transform(tokens, _position_hash(1)).alias("h1"),
        F.transform(tokens, _position_hash(2)).alias("h2"),
    ).select("*", _xor(F.col("h1")).alias("t1"), _xor(F.col("h2")).alias("t2"))
    wild = F.size(F.filter("tokens", lambda x: x == WILDCARD))
    room = wild + 1 <= F.floor(F.size("tokens") * (1 - SIMILARITY))

    def offer(token: Column, i: Column) -> Column:
        star = F.lit(WILDCARD)
        k1 = F.col("t1").bitwiseXOR(F.get(F.col("h1"), i)).bitwiseXOR(F.xxhash64(F.lit(1), star, i))
        k2 = F.col("t2").bitwiseXOR(F.get(F.col("h2"), i)).bitwiseXOR(F.xxhash64(F.lit(2), star, i))
        usable = (i > 0) & ~token.startswith("<")
        return F.when(usable, F.struct(i.alias("position"), k1.alias("k1"), k2.alias("k2")))

    offers = hashed.where(room).select(
        "t1", "t2",
        F.explode(F.array_compact(F.transform("tokens", offer))).alias("o"),
    ).select("t1", "t2", "o.*")
    shared = offers.groupBy("k1", "k2").agg(F.count("*").alias("sharing")).where(
        F.col("sharing") > 1
    )
    best = F.max_by("position", F.struct("sharing", -F.col("position")))
    chosen = offers.join(shared, ["k1", "k2"]).groupBy("t1", "t2").agg(
        best.alias("position")
    )
    joined = hashed.select("template", "size", "tokens", "t1", "t2").join(
        chosen, ["t1", "t2"], "left"
    )
    replaced = F.transform(
        "tokens",
        lambda token, i: F.when(i == F.col("position"), F.lit(WILDCARD)).otherwise(token),
    )
    text = F.when(F.col("position").isNull(), F.col("template")).otherwise(
        F.array_join(replaced, " ")
    )
    return joined.groupBy(text.alias("template")).agg(F.sum("size").alias("size"))
