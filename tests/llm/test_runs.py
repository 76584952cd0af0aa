"""Periodic runs beside a search of every stretch."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from conftest import SF, as_dicts, odd_rows

from vigilog.llm import runs
from vigilog.llm.queries import QUERIES, with_periods
from vigilog.llm.words import mix


def runs_in(w):
    """(start, length, period) of every run, by trying all starts and periods."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and w[e] == w[e - q]:
                e += 1
            if e - s >= max(6, 4 * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rewritten(doc_id, text):
    """The words of a text after the contract's change of one document in ten."""
    w = re.findall(brute.BLANK, text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row(doc_id, w):
    found = runs_in(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, milli, sha(told), sha(collapsed(w, found)))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randrange(0, 5)):
            k = rng.choice([1, 2, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(rng.randrange(0, 70))]
            at, unit = rng.randrange(len(w) + 1), [rng.randrange(k) for _ in range(rng.randrange(1, 7))]
            docs.append(w[:at] + unit * rng.randrange(0, 9) + unit[: rng.randrange(7)] + w[at:])
        first = np.cumsum([0, *map(len, docs)])
        flat = np.array([x for d in docs for x in d], dtype=np.uint64)
        got = runs.runs_of(mix(flat + np.uint64(1)), first)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(docs) for r in runs_in(w)]


@pytest.mark.parametrize("period", [1, 7, 900])
def test_one_long_run(period):
    w = np.tile(mix(np.arange(period, dtype=np.uint64)), 60_000 // period)
    assert runs.runs_of(w, np.array([0, len(w)])).tolist() == [[0, 0, len(w), period]]


def test_pairs_need_another_left_word():
    # abababab: of the places 0, 2, 4 of "abab" only the first follows nothing.
    assert runs.maximal_pairs([4, 2, 0], [0, 4, 6], {4: 2, 2: 2, 0: None}) == [(0, 2, 6)]


def test_odd_rows(spark, make):
    long = " ".join(["x y\tz"] * 3000)
    rows = [*odd_rows(), (9, long, None), (9, long, None), (10, "a a a a a", "c"), (11, "Ä Ä Ä Ä Ä Ä end", "c"), (12, "a\nb " * 4, "c")]
    got = runs.periodic_runs(make(rows)).collect()
    want = []
    for d in as_dicts(rows):
        w = re.findall(brute.BLANK, d["text"] or "")
        # The very long text repeats 5,003 different words, so it is one run and no other.
        found = runs_in(w) if len(w) < 50_000 else [(0, len(w), 5003)]
        want.append((d["doc_id"], len(w), found, collapsed(w, found)))
    assert sorted([(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got], key=repr) == sorted(want, key=repr)
    assert any(r[2] for r in want)


def test_no_rows(spark, make):
    assert runs.periodic_runs(make([])).collect() == []


def test_with_periods(spark, make):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40)), None) for i in range(200)] + [(None, "a b c", None), (3, None, None)]
    got = {(r["doc_id"], len(rows)): (r["text"] or "").split() for r in with_periods(make(rows)).collect() if r["doc_id"]}
    for doc_id, text, _ in rows:
        if doc_id and text:
            assert got[doc_id, len(rows)] == rewritten(doc_id, text) or doc_id == 3
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_op13(spark, documents):
    got = [tuple(r) for r in QUERIES["op13_runs"](spark, SF).collect()]
    want = [row(d["doc_id"], rewritten(d["doc_id"], d["text"])) for d in documents]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in got) > 5
