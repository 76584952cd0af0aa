"""Message templates with ids, from a parse tree of fixed depth (He et al., 2017).

A masked message belongs to the leaf of its number of tokens and its first tokens (a token
with a digit stands for any). Inside a leaf it joins the template it agrees with in the
largest share of tokens, if that share is large enough, and turns the tokens that differ
into wildcards; otherwise it is a new template.

Messages are first folded to different masked texts. A leaf is worked through by falling
size, then text, which makes the result one of a sequential miner in that order. A leaf with
more than ``LEAF_TEXTS`` texts is dealt into parts by hash, mined apart, and their templates
are mined again as texts with sizes, in rounds, until a leaf is one part or no template is
saved any more; so no task ever holds a whole large leaf.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.operators.templates import SIMILARITY, WILDCARD, mask_variables
from vigilog.session import cut_lineage

PREFIX = 2  # leading tokens on the way to a leaf
LEAF_TEXTS = 20_000


def leaf_of(text: Column, prefix: int = PREFIX) -> Column:
    """Number of tokens and first tokens of a masked text."""
    tokens = F.split(text, " ", -1)
    first = F.transform(F.slice(tokens, 1, prefix), lambda x: F.when(x.rlike("[0-9]"), WILDCARD).otherwise(x))
    return F.concat_ws(" ", F.size(tokens).cast("string"), first)


def template_id(template: Column) -> Column:
    """Whole number of the first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(template), 1, 15), 16, 10).cast("bigint")


def mine_leaf(texts: list[str], sizes: list[int], similarity: float = SIMILARITY) -> list[str]:
    """The template of each text of a leaf; texts are taken by falling size, then text."""
    order = sorted(range(len(texts)), key=lambda i: (-sizes[i], texts[i]))
    number: dict[str, int] = {WILDCARD: 0}
    words = [WILDCARD]
    rows = np.empty((len(texts), len(texts[0].split(" "))), dtype=np.int64)
    for i in order:
        for k, token in enumerate(texts[i].split(" ")):
            if token not in number:
                number[token] = len(words)
                words.append(token)
            rows[i, k] = number[token]
    width = rows.shape[1]
    known = np.empty((16, width), dtype=np.int64)
    count, joined = 0, np.empty(len(texts), dtype=np.int64)
    for i in order:
        row = rows[i]
        found = -1
        if count:
            same = ((known[:count] == row) & (known[:count] != 0)).sum(axis=1)
            wild = (known[:count] == 0).sum(axis=1)
            # Most tokens in common; of equals the one with more wildcards, then the first.
            best = int(np.argmax(same * (width + 1) + wild))
            if same[best] >= similarity * width:
                found = best
        if found < 0:
            if count == len(known):
                known = np.concatenate([known, np.empty_like(known)])
            known[count] = row
            found, count = count, count + 1
        else:
            known[found] = np.where(known[found] == row, row, 0)
        joined[i] = found
    told = [" ".join(words[w] for w in known[c]) for c in range(count)]
    return [told[c] for c in joined]


def _mined(texts: DataFrame, similarity: float) -> DataFrame:
    """(text, leaf, size, template) of (text, leaf, size, part), each leaf and part by itself."""

    def mine(group: pd.DataFrame) -> pd.DataFrame:
        return group[["text", "leaf", "size"]].assign(
            template=mine_leaf(group["text"].tolist(), group["size"].tolist(), similarity)
        )

    schema = "text string, leaf string, size bigint, template string"
    alone = texts.where("texts = 1").select("text", "leaf", "size", F.col("text").alias("template"))
    shared = texts.where("texts > 1").groupBy("leaf", "part").applyInPandas(mine, schema)
    return alone.unionByName(shared)


def _in_parts(texts: DataFrame, leaf_texts: int) -> tuple[DataFrame, bool]:
    """``texts`` with the number of texts of their leaf and ``part``, and whether some leaf has several parts."""
    counts = cut_lineage(texts.sparkSession, texts.groupBy("leaf").agg(F.count("*").alias("texts")), "template-leaves")
    most = counts.agg(F.max("texts")).first()[0] or 0
    part = F.pmod(F.xxhash64("text"), F.ceil(F.col("texts") / F.lit(leaf_texts)))
    return texts.join(counts, "leaf").withColumn("part", part), most > leaf_texts


def mined_templates(
    messages: DataFrame,
    message: str,
    *,
    similarity: float = SIMILARITY,
    prefix: int = PREFIX,
    leaf_texts: int = LEAF_TEXTS,
) -> tuple[DataFrame, DataFrame]:
    """Templates (template_id, template, tokens, size), and the template of each masked text.

    The second table, (text, template_id, template), is joined to messages by
    ``with_templates``. A null message has no template.
    """
    spark = messages.sparkSession
    text = mask_variables(F.col(message))
    texts = messages.where(F.col(message).isNotNull()).groupBy(text.alias("text")).agg(F.count("*").alias("size"))
    texts = cut_lineage(spark, texts.withColumn("leaf", leaf_of(F.col("text"), prefix)), "template-texts")
    now, split = _in_parts(texts, leaf_texts)
    mapped = cut_lineage(spark, _mined(now, similarity), "template-round")
    before = None
    while split:
        # Templates of the parts of a leaf are texts of the next round.
        own = mapped.groupBy(F.col("template").alias("text"), "leaf").agg(F.sum("size").alias("size"))
        own = cut_lineage(spark, own, "template-texts")
        size = own.count()
        if size == before:
            break
        before = size
        now, split = _in_parts(own, leaf_texts)
        merged = _mined(now, similarity).select("leaf", F.col("text").alias("template"), F.col("template").alias("wider"))
        joined = mapped.join(merged, ["leaf", "template"])
        mapped = cut_lineage(spark, joined.select("text", "leaf", "size", F.col("wider").alias("template")), "template-round")
    templates = mapped.groupBy("template").agg(F.sum("size").alias("size")).select(
        template_id(F.col("template")).alias("template_id"),
        "template",
        F.size(F.split("template", " ", -1)).alias("tokens"),
        "size",
    )
    return templates, mapped.select("text", template_id(F.col("template")).alias("template_id"), "template")


def with_templates(messages: DataFrame, message: str, assigned: DataFrame) -> DataFrame:
    """``messages`` with ``template_id`` and ``template``; null where there is no message."""
    text = mask_variables(F.col(message))
    return messages.withColumn("_text", text).join(
        assigned.withColumnRenamed("text", "_text"), "_text", "left"
    ).drop("_text")


def assign_stream(messages: DataFrame, message: str, templates: DataFrame) -> DataFrame:
    """``messages``, a stream or not, with the known template each agrees with most.

    Templates are read once when the query is built, one list a leaf; they are those of
    ``mined_templates``, whose number follows the kinds of messages and not their count. A
    message that agrees with none, or has no leaf among them, gets null.
    """
    by_leaf: dict[str, list[str]] = {}
    for row in templates.select(leaf_of(F.col("template")).alias("leaf"), "template").orderBy("template").toLocalIterator():
        by_leaf.setdefault(row["leaf"], []).append(row["template"])
    split = {leaf: np.array([t.split(" ") for t in own], dtype=object) for leaf, own in by_leaf.items()}

    @F.pandas_udf("string")
    def nearest(leaves: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_nearest(split.get(leaf), text) for leaf, text in zip(leaves, texts)], dtype=object)

    text = mask_variables(F.col(message))
    found = nearest(leaf_of(text), text)
    return messages.withColumn("template", found).withColumn("template_id", template_id(F.col("template")))


def _nearest(own: np.ndarray | None, text: str | None) -> str | None:
    if own is None or text is None:
        return None
    row = np.array(text.split(" "), dtype=object)
    wild = own == WILDCARD
    fits = ((own == row) | wild).all(axis=1)
    if not fits.any():
        return None
    best = np.flatnonzero(fits)[np.argmin(wild[fits].sum(axis=1))]
    return " ".join(own[best])
