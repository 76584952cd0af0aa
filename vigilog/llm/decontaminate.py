"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window
is ``span`` consecutive words of a benchmark item; an item of fewer words, but not none,
is one window. Every occurrence of a window in a document is found:

* Both sides keep the smallest hash of ``k``-word runs in each window of ``w`` of them,
  with ``k + w - 1`` words to a window. Two texts that share a whole window share the
  kept run, so joining the kept runs loses nothing. Items of ``n < span`` words use the
  same rule with ``n`` in place of ``span``.
* A Bloom filter of the benchmark's kept runs, of a fixed number of bits, goes to all
  tasks; document runs that cannot meet a benchmark run are left out before the join.
  A larger benchmark lets more runs through; it changes no result.
* Each meeting is extended word by word on both sides, which removes chance meetings.

Null texts have no words. Documents and items that repeat, also under one id, are each
judged by their own text; items without id or text are left out. Columns beyond the
named ones are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.moves import may_be_in
from vigilog.llm.scratch import keep, plain
from vigilog.llm.simhash import row_key
from vigilog.llm.words import ALNUM, Words, shingles, sliding_min, slices

SPAN = 10
BLOOM_BITS = 26  # log2 of the filter's bits: 8 MB for every task, whatever the data
_NONE = np.uint64(2**64 - 1)

_MARK = "hash long, pos int, span int, off int, ctx array<string>"
_MARK_ARROW = pa.struct(
    [("hash", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("off", pa.int32()),
     ("ctx", pa.list_(pa.string()))]
)


def kept_runs(words: Words, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words at which a kept run of this span begins, the runs' hashes, and their length."""
    k = (span + 1) // 2
    w = span - k + 1
    runs = shingles(hashes, k) ^ np.uint64(span)
    lows = sliding_min(runs, w)
    whole = np.arange(len(lows)) + span <= words.doc_end()[: len(lows)]
    kept = np.zeros(len(runs), dtype=bool)
    for o in range(w):
        kept[o : o + len(lows)] |= (runs[o : o + len(lows)] == lows) & whole
    at = np.flatnonzero(kept)
    return at, runs[at], k


def _marks(words: Words, spans, wanted) -> list[list[dict]]:
    """For each text its kept runs that pass ``wanted``, with the words around them."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    hashes = words.hashes()
    for span in spans:
        at, runs, k = kept_runs(words, hashes, span)
        passed = wanted(runs)
        at, runs = at[passed], runs[passed]
        docs = np.searchsorted(words.first, at, side="right") - 1
        for a, h, d in zip(at.tolist(), runs.astype(np.int64).tolist(), docs.tolist()):
            low, high = int(words.first[d]), int(words.first[d + 1])
            left, right = max(low, a - (span - k)), min(high, a + span)
            out[d].append(
                {"hash": h, "pos": a - low, "span": span, "off": a - left, "ctx": words.span(left, right)}
            )
    return out


def benchmark_marks(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, hash, pos, span, off, ctx) for every kept run of every item."""

    def mark(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                ids, hashes = part.column("item_id"), words.hashes()
                rows, marks = [], []
                counts = np.minimum(words.counts, span)
                for size in np.unique(counts[counts > 0]).tolist():
                    def of_size(at, size=size):
                        return counts[np.searchsorted(words.first, at, side="right") - 1] == size
                    at, runs, k = kept_runs(words, hashes, size)
                    own = of_size(at)
                    for a, h in zip(at[own].tolist(), runs[own].astype(np.int64).tolist()):
                        d = int(np.searchsorted(words.first, a, side="right") - 1)
                        low, high = int(words.first[d]), int(words.first[d + 1])
                        left, right = max(low, a - (size - k)), min(high, a + size)
                        rows.append(d)
                        marks.append({"hash": h, "pos": a - low, "span": size, "off": a - left,
                                      "ctx": words.span(left, right)})
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(marks, _MARK_ARROW)], ["item_id", "mark"]
                )

    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    schema = f"item_id {dict(items.dtypes)['item_id']}, mark struct<{_as_fields(_MARK)}>"
    return usable.mapInArrow(mark, schema).select("item_id", "mark.*")


def _as_fields(ddl: str) -> str:
    return ", ".join(":".join(x.split(" ", 1)) for x in ddl.split(", "))


def bloom(marks: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit array of 2**bits bits with a bit set for each benchmark hash.

    The driver gets the words that are not zero, 2**(bits - 6) at most.
    """
    place = F.shiftrightunsigned("hash", 64 - bits)
    filled = (
        marks.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for row in filled:
        out[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def find_spans(docs: DataFrame, items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Shared spans of documents and items.

    ``docs`` has (doc_id, text), ``items`` (item_id, text). Returns the documents as
    (row, doc_id, n_words), a row for each input row, and the spans as
    (row, item_id, begin, end): words begin to end - 1 of the document stand in the item.
    """
    spark = docs.sparkSession
    marks = keep(benchmark_marks(items, span), "benchmark-marks")
    spans = sorted(r["span"] for r in marks.select("span").distinct().collect())  # at most ``span``
    filter_bits = spark.sparkContext.broadcast(bloom(marks))

    def scan(batches):
        bits = filter_bits.value
        shift, low = np.uint64(64 - BLOOM_BITS), np.uint64(63)

        def wanted(runs):
            place = runs >> shift
            return (bits[place >> np.uint64(6)] >> (place & low)) & np.uint64(1) == 1

        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                found = _marks(words, spans, wanted)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(words.counts, pa.int64()),
                     pa.array(found, pa.list_(_MARK_ARROW))],
                    ["row", "doc_id", "n_words", "marks"],
                )

    schema = (
        f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, "
        f"marks array<struct<{_as_fields(_MARK)}>>"
    )
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scanned = keep(numbered.mapInArrow(scan, schema), "document-marks")

    ours = scanned.select("row", F.explode("marks").alias("m")).select(
        "row", F.col("m.hash").alias("hash"), F.col("m.pos").alias("pos"), F.col("m.off").alias("off"),
        F.col("m.ctx").alias("ctx"),
    )
    theirs = marks.select(
        "hash", "item_id", "span", F.col("off").alias("item_off"), F.col("ctx").alias("item_ctx")
    ).distinct()
    item_type = dict(items.dtypes)["item_id"]
    spans_found = ours.join(theirs, "hash").mapInArrow(
        _extend, f"row long, item_id {item_type}, begin int, end int"
    )
    return scanned.select("row", "doc_id", "n_words"), spans_found


def _extend(batches):
    """Widen each meeting to the words both sides share; keep those of a whole window."""
    for batch in batches:
        rows, begins, ends = [], [], []
        cols = (batch.column(c).to_pylist() for c in ("pos", "off", "ctx", "span", "item_off", "item_ctx"))
        for i, (pos, off, ctx, span, item_off, item_ctx) in enumerate(zip(*cols)):
            left = 0
            while left < min(off, item_off) and ctx[off - 1 - left] == item_ctx[item_off - 1 - left]:
                left += 1
            right, most = 0, min(len(ctx) - off, len(item_ctx) - item_off)
            while right < most and ctx[off + right] == item_ctx[item_off + right]:
                right += 1
            if left + right >= span:
                rows.append(i)
                begins.append(pos - left)
                ends.append(pos + right)
        picked = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(picked), batch.column("item_id").take(picked),
             pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
            ["row", "item_id", "begin", "end"],
        )


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id",
    item_text_col="text", span: int = SPAN,
) -> DataFrame:
    """For each document row: doc_id, n_words, n_hit, items (ids, sorted as strings), contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are those with
    a window that occurs.
    """
    base, spans = find_spans(
        plain(docs, doc_id=id_col, text=text_col), plain(benchmark, item_id=item_col, text=item_text_col), span
    )
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["begin"], acc["reach"]), F.lit(0))).alias("n"),
            F.greatest(acc["reach"], x["end"]).alias("reach"),
        ),
        lambda acc: acc["n"],
    )
    hits = (
        spans.groupBy("row")
        .agg(F.collect_set(F.struct("begin", "end")).alias("places"),
             F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select("row", covered.alias("n_hit"), F.array_sort("items").alias("items"))
    )
    return base.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window.

    Each row is judged by its own text, whatever rows share its doc_id or have none; a null
    text holds no window. Only rows that a filter of the contaminated ones lets through are
    moved.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"),
        docs["text"].alias("text"),
    ).select("doc", "text", row_key().alias("row_key"))
    bad = contamination(rows, benchmark, id_col="row_key", span=span).where("contaminated")
    bad = keep(bad.select(F.col("doc_id").alias("row_key")), "contaminated")
    told = rows.select("doc", "row_key").withColumn(
        "moved", may_be_in(bad.select(F.xxhash64("row_key").alias("key")), F.xxhash64("row_key"))
    )
    judged = told.where("moved").join(bad, "row_key", "left_anti")
    return told.where("NOT moved").select("doc.*").unionByName(judged.select("doc.*"))
