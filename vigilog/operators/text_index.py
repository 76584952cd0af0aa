"""Text search that reads only the files that can hold the text.

A skip index has a row for each data file: a Bloom filter of the three-byte runs of its
lower-cased texts. A search keeps the files whose filter holds every run of the searched
text, and tests the rows of those alone; a filter never misses a run, so no row is lost.
Runs of the searched text that reach over a wildcard or beyond ASCII are not looked up.

Rows of the index are made in the tasks that read a file's rows and joined by file; they
have a fixed size (``BITS``), so the index is some per mille of the data.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 18  # of a file's filter: 32 KB
INDEX = "path string, bits binary"
_AT_ONCE = 1 << 20  # bytes of text; their runs take some forty times as much


def _places(data: np.ndarray) -> np.ndarray:
    """Bits of the three-byte runs of a text."""
    wide = data.astype(np.uint64)
    runs = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def index_files(rows: DataFrame, text: str = "content") -> DataFrame:
    """``INDEX`` rows of a table read from files."""

    def scan(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            paths = batch.column("path").to_pylist()
            texts = batch.column("text").to_pylist()
            low = 0
            while low < len(paths):
                high, size = low, 0
                while high < len(paths) and paths[high] == paths[low] and (high == low or size < _AT_ONCE):
                    size += len(texts[high] or "")
                    high += 1
                data = np.frombuffer("\n".join(t or "" for t in texts[low:high]).encode("utf-8", "replace"), np.uint8)
                filled = found.setdefault(paths[low], np.zeros(1 << BITS, dtype=bool))
                if len(data) > 2:
                    filled[_places(data)] = True
                low = high
        yield _rows({p: np.packbits(f) for p, f in found.items()})

    def join(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for path, bits in zip(batch.column("path").to_pylist(), batch.column("bits").to_pylist()):
                own = np.frombuffer(bits, np.uint8)
                found[path] = found[path] | own if path in found else own
        yield _rows(found)

    told = rows.select(F.col("_metadata.file_path").alias("path"), F.lower(text).alias("text"))
    return told.mapInArrow(scan, INDEX).repartition("path").mapInArrow(join, INDEX)


def _rows(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    bits = [f.tobytes() for f in found.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(bits, pa.binary())], ["path", "bits"])


def searched_runs(text: str) -> np.ndarray:
    """Bits that a file must have to hold ``text``, in which ``%`` and ``_`` are wildcards."""
    parts = [np.zeros(0, np.int64)]
    for part in re.findall(r"[^%_\\\x80-\U0010FFFF]{3,}", text):
        parts.append(_places(np.frombuffer(part.lower().encode(), np.uint8)))
    return np.unique(np.concatenate(parts))


def matching_files(index: DataFrame, text: str) -> list[str]:
    """Files that may hold ``text``, by path. The filters are read by tasks, the paths here."""
    wanted = searched_runs(text)

    def test(batches):
        for batch in batches:
            good = [
                bool(np.unpackbits(np.frombuffer(bits, np.uint8))[wanted].all()) for bits in batch.column("bits").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("path").filter(pa.array(good, pa.bool_()))], ["path"])

    return sorted(r["path"] for r in index.mapInArrow(test, "path string").distinct().collect())


def read_matching(
    spark: SparkSession, index: DataFrame, text: str, schema: str, base: str, more: list[str] = (), column: str = "content"
) -> DataFrame:
    """Rows whose ``column`` holds ``text``, upper and lower case alike, of the files that may.

    ``more`` are folders without an index, which are read whole.
    """
    paths = [*matching_files(index, text), *more]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", base).parquet(*paths)
    return rows.where(F.col(column).ilike(f"%{text}%"))
