"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share the total size by weight. A source whose share is above ``max_epochs`` times
its size is clamped there; the excess is shared by weight among the others, and so on until
none is above. Each document of a source then appears a whole number of times, and some
documents once more: in a seeded order, those whose cumulated sizes best fill the fraction
left. Documents keep their decision however the data are partitioned.

Nulls: a null source is a source of its own, sorted last; a null text has size 0. Rows with
the same id and text share their place in the seeded order, so they are taken together. An
empty table gives no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20240601
BUCKET_DIGITS = 3  # hex digits of the seeded key: 4,096 buckets of a source's documents

WORD = r"[^\x20\x09-\x0D]+"


def document_size() -> Column:
    """Words of the text, 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(seed: int = SEED) -> Column:
    """32 hex digits that put a source's documents in a seeded order."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.md5(F.coalesce("text", F.lit(""))))
    return F.md5(told)


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, their place from 0 by code point, null last.

    Range partitions are ranked inside and shifted by the counts before them, so no task
    holds all sources.
    """
    order = F.col("source").asc_nulls_last()
    pieces = keep(
        sources.repartitionByRange(order).withColumn("piece", F.spark_partition_id()), "mix-sources"
    )
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("piece").agg(F.count("*").alias("n")).select(
        "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("piece").orderBy(order)) - 1
    return pieces.withColumn("inside", inside).join(starts, "piece").select(
        *sources.columns, (F.col("start") + F.col("inside")).alias("rank")
    )


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words for each unit of weight at which the capped shares use up the total."""
    level = None
    cap = F.col("size") * max_epochs
    while True:
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("size").alias("total"),
            F.sum(F.when(clamped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:  # no source, or all at their cap
            return level or 0.0
        found = (row["total"] - row["used"]) / row["open"]
        if found == level:
            return level
        level = found


def plan_sources(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """For each source of (source, size, key): source_size, target, whole, cut.

    A document appears ``whole`` times, and once more if its key is at most ``cut``.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = keep(ranked(sizes).select("source", "size", weight.alias("weight")), "mix-weights")
    level = water_level(sources, max_epochs)
    cap = F.col("size") * max_epochs
    share = F.col("weight") * F.lit(level)
    full = cap <= share
    target = F.when(full, cap.cast("double")).otherwise(share)
    whole = F.when(full, F.lit(max_epochs)).otherwise(F.floor(target / F.col("size"))).cast("int")
    targets = sources.select(
        "source", F.col("size").alias("source_size"), target.alias("target"), whole.alias("whole"),
        (target - whole * F.col("size")).alias("extra"),
    )

    bucket = F.substring("key", 1, BUCKET_DIGITS)
    buckets = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    edge = (
        buckets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where("before <= extra")
        .groupBy("source", "source_size", "target", "whole", "extra")
        .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("edge"))
        .select("source", "source_size", "target", "whole", "extra", "edge.*")
    )
    edge = keep(edge, "mix-edges")
    inside = edge.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "extra")
    keys = sized.join(inside, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b")))
    keys = keys.groupBy("source", "key", "before", "extra").agg(F.sum("size").alias("size"))
    run = F.coalesce(
        F.sum("size").over(
            Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    cuts = (
        keys.withColumn("run", F.col("before") + run)
        .where(2 * F.col("run") + F.col("size") <= 2 * F.col("extra"))
        .groupBy("source").agg(F.max("key").alias("last"))
        .withColumnRenamed("source", "s")
    )
    # A bucket's own digits sort before all its keys and after all keys of earlier buckets.
    return edge.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("last", "bucket").alias("cut")
    )


SALT_DIGITS = 2  # hex digits of the key: rows of one source meet their plan in 256 places


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of (source, key, ...) with their source's plan, a large source in many tasks.

    The plan is written first, so that the planner knows its size: below its limit it is
    broadcast and no row moves.
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(16**SALT_DIGITS - 1)),
                         lambda i: F.lpad(F.lower(F.hex(i.cast("long"))), SALT_DIGITS, "0"))
    copies = keep(plan.withColumnRenamed("source", "s").withColumn("place", F.explode(places)), "mix-plan")
    here = F.substring("key", 1, SALT_DIGITS) == F.col("place")
    return rows.join(copies, F.col("source").eqNullSafe(F.col("s")) & here)


def times(max_epochs: int) -> Column:
    """How often a row appears; an empty text, which costs no words, no more often than others may."""
    return F.least(F.col("whole") + (F.col("key") <= F.col("cut")).cast("int"), F.lit(max_epochs))


def mixture(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
    max_epochs=MAX_EPOCHS, seed=SEED,
) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, times (how often it appears)."""
    narrow = plain(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = keep(
        narrow.select("doc_id", "source", document_size().alias("size"), seeded_key(seed).alias("key")),
        "mix-documents",
    )
    return with_plan(sized, plan_sources(sized, weights, max_epochs)).select(
        "doc_id", "source", "size", "source_size", "target", times(max_epochs).alias("times")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mix: rows of ``docs``, all columns, each as often as it appears.

    Rows without a source are a source of their own; a null text has no words; equal rows
    have equal places in the seeded order and appear equally often.
    """
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        docs["source"].alias("source"),
        docs["text"].alias("text"),
        docs["doc_id"].alias("doc_id"),
    )
    sized = keep(
        keyed.select("source", document_size().alias("size"), seeded_key(seed).alias("key")), "mix-documents"
    )
    rows = keyed.select("doc", "source", seeded_key(seed).alias("key"))
    return (
        with_plan(rows, plan_sources(sized, weights, max_epochs))
        .select("doc", F.explode(F.array_repeat(F.lit(1), times(max_epochs))).alias("copy"))
        .select("doc.*")
    )
