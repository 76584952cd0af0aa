import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
#: Columns of users that clash with names the operators use inside.
CLASHING = "row string, fp string, key string, size string, node string, id string, mark string, chunk string, piece string"


@pytest.fixture(scope="session")
def documents():
    """The documents of the smallest tables as dicts, in order of id."""
    import pyarrow.parquet as pq

    return sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, source]) rows, with clashing columns besides."""

    def build(rows):
        extra = len(CLASHING.split(","))
        full = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        schema = f"doc_id long, text string, source string, {CLASHING}"
        return spark.createDataFrame([(*r, *["x"] * extra) for r in full], schema)

    return build


def odd_rows():
    """Nulls, empty, blank, very long, repeated and tied rows."""
    prose = " ".join(f"word{i % 97}x{i % 31}" for i in range(120))
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n ", None),
        (None, prose, "b"),
        (4, prose, "b"),
        (4, prose, "b"),
        (5, prose + " and more", None),
        (6, " ".join(f"long{i * 7919 % 5003}" for i in range(60_000)), "a"),
        (7, "one two three", "c"),
        (8, "Größe ÄÖÜ naïve 日本語   x y", "c"),
    ]


def as_dicts(rows):
    return [{"doc_id": r[0], "text": r[1], "source": r[2]} for r in rows]
