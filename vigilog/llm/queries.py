"""Registered queries of the subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import (
    decontaminate,
    hmm,
    language,
    licenses,
    mixing,
    passages,
    quality,
    runs,
    sharding,
    simhash,
    tokenfile,
    warc,
    whitening,
)
from vigilog.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower-cases A-Z only, in SQL.
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_SQL = "regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op1_decontaminate",
    sql=f"""
WITH d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_SQL} AS w FROM benchmark),
spans AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, spans)),
met AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.x = v.x),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM met) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_quality",
    sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4))),
again AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM runs WHERE times > 1) GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) AS n_stutter
  FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d WHERE len(w) > 1)
  WHERE w[i] = w[i - 1] GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN stutter USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
    OR 10 * word_chars < 25 * n_words OR 10 * word_chars > 150 * n_words
    OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * n_capitals > 30 * word_chars OR 100 * n_stutter > 20 * n_words) AS kept
FROM f""",
)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *quality.BASE, failed.alias("base_failed"), "kept")


@query(
    "op4_mixing",
    sql=r"""
WITH RECURSIVE d AS (SELECT doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('20240601|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size,
  [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
total AS (SELECT sum(size)::DOUBLE AS total FROM s),
levels AS (
  SELECT 1 AS round, (SELECT total FROM total) / (SELECT sum(weight) FROM s) AS level
  UNION ALL
  SELECT round + 1, (SELECT (t.total - coalesce(sum(3 * size) FILTER (3 * size <= weight * level), 0))
      / nullif(sum(weight) FILTER (3 * size > weight * level), 0) FROM s, total t GROUP BY t.total)
  FROM levels WHERE round < 60 AND level IS NOT NULL),
level AS (SELECT coalesce(max(level), 0.0) AS level FROM levels),
t AS (SELECT source, size AS source_size,
  CASE WHEN 3 * size <= weight * level THEN (3 * size)::DOUBLE ELSE weight * level END AS target,
  CASE WHEN 3 * size <= weight * level THEN 3 ELSE floor(weight * level / size) END::BIGINT AS whole
  FROM s, level),
k AS (SELECT source, key, sum(size) AS size,
  sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before FROM d GROUP BY source, key)
SELECT d.doc_id, d.size, t.source_size, t.target,
  (d.size * (whole + (2 * k.before + k.size <= 2 * (target - whole * source_size))::INT))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key""",
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.uniform_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_tokens")
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.written_documents(table(spark, sf_dir, "documents"), vocabulary)


@query("op9_hmm")
def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(table(spark, sf_dir, "documents"))


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written derivatives hold of each page."""
    responses = warc.page_responses(table(spark, sf_dir, "pages"))
    folder = shared_dir(spark, "llm-warc")
    files = warc.write_files(warc.derive(responses), folder)
    found = warc.read_files(spark, files, folder)
    meta, text = F.col("warc_type") == "metadata", F.col("warc_type") == "conversion"
    told = F.col("block").cast("string")
    at = "$.Envelope.Payload-Metadata.HTTP-Response-Metadata"
    of_response = (
        found.select(
            "refers_to",
            "target_uri",
            F.col("headers")["WARC-Source-Payload-Digest"].alias("payload_digest"),
            F.when(meta, F.col("record_id")).alias("metadata_id"),
            F.when(text, F.col("record_id")).alias("conversion_id"),
            F.when(meta, F.get_json_object(told, f"{at}.HTML-Metadata.Head.Title")).alias("title"),
            F.when(meta, F.json_array_length(F.get_json_object(told, f"{at}.HTML-Metadata.Links"))).alias("n_links"),
            F.when(text, F.sha1("block")).alias("text_sha1"),
            F.when(text, F.length(told)).alias("n_text_chars"),
            "digest_ok",
        )
        .groupBy("refers_to")
        .agg(
            *[F.max(c).alias(c) for c in ("target_uri", "payload_digest", "metadata_id", "conversion_id", "title",
                                          "n_links", "text_sha1", "n_text_chars")],
            F.bool_and("digest_ok").alias("digests_ok"),
        )
    )
    # The planner takes the size of the list of files for that of the records, so it is told
    # not to broadcast them.
    pages = responses.select("page_id", F.col("record_id").alias("refers_to"))
    return pages.join(of_response.hint("merge"), "refers_to", "left")


@query("op3_passages")
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_language")
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), 4)
    return white.select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.col("explained")[F.col("at")].alias("explained"),
        "identity_error",
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by a hash of its id, goes over to repeating some words."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    told = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    told = told.withColumn("a", F.when(n > 0, F.col("g") % n))
    told = told.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    from_a = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1 - F.col("a")),
        lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")),
    )
    again = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a").cast("int")), from_a)
    return told.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / (-F.col("best.p"))).alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
