"""Edge cases of the operators: nulls, empty, long, repeated and tied rows, clashing columns."""

import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import as_dicts, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilog.llm import (
    decontaminate, hmm, licenses, mixing, passages, quality, sharding, simhash, tokenfile, warc,
)
from vigilog.llm.words import ALNUM, NON_BLANK, Words, shingles, sliding_min, slices


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def same(got, want):
    """Equal as multisets, nulls included."""
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


TEXT = st.text(alphabet=st.sampled_from(list("aB9zZ .,\n\t\x0b\x1cé日 K'!|")), max_size=60)


@given(st.lists(st.none() | TEXT, max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    batch = pa.array(texts, pa.string())
    for kind, pattern in ((ALNUM, brute.ALNUM), (NON_BLANK, brute.BLANK)):
        words = Words(batch, kind)
        got = [words.span(int(a), int(b)) for a, b in zip(words.first[:-1], words.first[1:])]
        assert got == [brute.words(t, pattern) for t in texts]
        flat = [w for t in got for w in t]
        hashes = words.hashes().tolist()
        assert len({(w, h) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes))


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_sliding_min(values, w):
    got = sliding_min(np.array(values, np.uint64), w).tolist()
    assert got == ([min(values[i : i + w]) for i in range(len(values) - w + 1)] if len(values) >= w else [])


def test_slices_hold_every_row_once():
    texts = ["x" * n for n in (0, 10, 5_000, 3, 9, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [t for s in slices(batch, size=12) for t in s.column("text").to_pylist()] == texts


# --- decontamination ---------------------------------------------------------------


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, hash string, pos string")


def found(spark, docs, items):
    got = decontaminate.contamination(docs, bench(spark, [(*i, "x", "y") for i in items]))
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()]


def test_contamination_of_odd_rows(spark, make):
    rows = odd_rows()
    part = rows[4][1].split()
    items = [
        (1, " ".join(part[20:45]).upper()), (2, "one two three"), (2, " ".join(part[3:13])), (10, "ÄÖÜ"),
        (11, "größe ÄÖÜ naïve"), (3, None), (None, "one two three"), (4, ""), (5, "two"), (5, "two"),
        (6, " ".join(part[60:70]) + " other"), (7, " ".join(part[60:69])),
    ]
    want = brute.contamination(as_dicts(rows), [{"item_id": i, "text": t} for i, t in items])
    same([(*r[:3], tuple(r[3])) for r in found(spark, make(rows), items)], [(*r[:3], tuple(r[3])) for r in want])
    assert any(r[2] for r in want)


def test_contamination_without_rows(spark, make):
    assert found(spark, make([]), [(1, "a b")]) == []
    same([r[:3] for r in found(spark, make([(1, "a b")]), [])], [(1, 2, 0)])


@pytest.mark.parametrize("seed", range(3))
def test_contamination_like_brute_force(spark, make, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 80)), None) for i in range(60)]
    items = [(i, text(rng.randrange(0, 14))) for i in range(12)]
    items += [(20 + i, " ".join(docs[i][1].split()[5:25])) for i in range(8)]
    want = brute.contamination(as_dicts(docs), [{"item_id": i, "text": t} for i, t in items])
    same([(*r[:3], tuple(r[3])) for r in found(spark, make(docs), items)], [(*r[:3], tuple(r[3])) for r in want])


def test_clean_documents_keeps_columns(spark, make):
    docs = make([(1, "a b c d e f g h i j k"), (2, "z " * 20), (None, None), (2, "z " * 20)])
    left = decontaminate.clean_documents(docs, bench(spark, [(1, "a b c d e f g h i j", "x", "y")]))
    assert left.columns == docs.columns
    same(left.select("doc_id").collect(), [(2,), (2,), (None,)])


def test_clean_documents_judges_each_row(spark, make):
    held = "a b c d e f g h i j"
    docs = make([(None, held), (None, "z " * 20), (None, None), (None, ""), (1, held), (1, "y " * 20), (1, held), (2, held)])
    left = decontaminate.clean_documents(docs, bench(spark, [(1, held, "x", "y")]))
    same(left.select("doc_id", "text").collect(), [(None, "z " * 20), (None, None), (None, ""), (1, "y " * 20)])


# --- WARC --------------------------------------------------------------------------


def response(**changes):
    body = b"<title>A &amp; B</title><p>x<b>y</b> z<!-- no --><script>no()</script><a href='/q?a=1&amp;b'>l</a>"
    row = {
        "warc_type": "response", "record_id": "<urn:uuid:1>", "refers_to": None, "target_uri": "http://e.org/",
        "date": "2024-01-01T00:00:00Z", "headers": {"WARC-IP-Address": "192.0.2.1"},
        "block": b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=utf-8\r\nX-Y: z\r\n\r\n" + body,
    }
    return row | changes


def test_derived_records_are_linked_and_keep_headers():
    import json

    meta, text = warc.derived(response())
    assert (meta["refers_to"], text["refers_to"]) == ("<urn:uuid:1>",) * 2
    assert len({meta["record_id"], text["record_id"], "<urn:uuid:1>"}) == 3
    told = json.loads(meta["block"])["Envelope"]
    assert told["WARC-Header-Metadata"]["WARC-IP-Address"] == "192.0.2.1"
    message = told["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert message["Headers"]["x-y"] == "z" and message["Response-Message"]["Status"] == "404"
    assert message["HTML-Metadata"] == {
        "Head": {"Title": "A & B", "Metas": []}, "Links": [{"path": "A@/href", "url": "/q?a=1&b"}],
    }
    payload = response()["block"].partition(b"\r\n\r\n")[2]
    assert message["Entity-Digest"] == warc.digest(payload) == dict(text["headers"])["WARC-Source-Payload-Digest"]
    assert text["block"].decode() == "A & B\nxy zl"


@pytest.mark.parametrize(
    "block, kinds",
    [
        (None, ["metadata"]),
        (b"", ["metadata"]),
        (b"no http at all", ["metadata"]),
        (b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", ["metadata"]),
        (b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=nonsense\r\n\r\nabc", ["metadata", "conversion"]),
        (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<!-- open <p>never", ["metadata", "conversion"]),
        (b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\nnot gzip", ["metadata", "conversion"]),
    ],
)
def test_odd_responses(block, kinds):
    got = warc.derived(response(block=block, record_id=None, target_uri=None, date=None, headers=None))
    assert [r["warc_type"] for r in got] == kinds
    assert len({r["refers_to"] for r in got}) == 1


def test_transfer_codings():
    import gzip

    squeezed = gzip.compress(b"hello world")
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(squeezed), squeezed)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    assert warc.derived(response(block=head + chunked))[1]["block"] == b"hello world"


def test_page_text_takes_linear_time_on_broken_pages():
    for broken in ("<a" * 200_000, "<!--" * 100_000, "<script>" * 50_000, "<p " * 100_000):
        warc.page_text(broken)
        warc.page_metadata(broken)


def test_warc_files_round_trip(spark, tmp_path):
    rows = [response(record_id=f"<urn:uuid:{i}>", block=response()["block"] + b"\r\n\r\n" * i) for i in range(40)]
    rows += [response(record_id="<urn:uuid:x>", target_uri="http://e.org/\r\nWARC-Type: bad", block=bytes(range(256)))]
    made = spark.createDataFrame(
        [tuple(r[c] for c in warc._RECORD_ARROW.names) for r in rows], warc.RECORD
    ).repartition(3)
    derived = warc.derive(made)
    want = derived.collect()
    assert len(want) == 81
    folder = str(tmp_path / "warc")
    files = warc.write_files(derived, folder)
    back = warc.read_files(spark, files, folder)
    got = [r for r in back.collect() if r["warc_type"] != "warcinfo"]
    key = lambda r: (r["record_id"], bytes(r["block"]), r["refers_to"], sorted(r["headers"].items()))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r["digest_ok"] for r in got)
    assert {r["target_uri"] for r in got} == {"http://e.org/", "http://e.org/%0D%0AWARC-Type: bad"}
    assert files.agg({"n_records": "sum"}).first()[0] == 81


def test_every_record_has_a_date(spark, tmp_path):
    dated, undated = warc.derived(response(), "2030-01-01T00:00:00Z"), warc.derived(response(date=None), "2030-01-01T00:00:00Z")
    assert {r["date"] for r in dated} == {"2024-01-01T00:00:00Z"} and {r["date"] for r in undated} == {"2030-01-01T00:00:00Z"}
    referred = {k: v for k, v in dated[1]["headers"] if k.startswith("WARC-Refers")}
    assert referred == {"WARC-Refers-To-Target-URI": "http://e.org/", "WARC-Refers-To-Date": "2024-01-01T00:00:00Z"}
    assert "WARC-Refers-To-Date" not in dict(undated[0]["headers"])
    made = spark.createDataFrame([tuple(response(date=None)[c] for c in warc._RECORD_ARROW.names)], warc.RECORD)
    folder = str(tmp_path / "warc")
    back = warc.read_files(spark, warc.write_files(warc.derive(made), folder), folder).collect()
    assert len(back) == 3 and all(r["date"] and r["date"].endswith("Z") for r in back)


def test_digests_and_names_are_the_usual_ones():
    import base64
    import hashlib
    import uuid

    for i in range(300):
        data = bytes(range(i % 256)) * (i % 3)
        assert warc.digest(data) == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert warc._urn(f"n{i}é") == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'n{i}é')}>"


def test_a_file_that_ends_inside_a_record_is_refused(tmp_path):
    import pyarrow.fs

    whole = warc._member([("WARC-Type", "metadata")], b"some block" * 50)
    (tmp_path / "a.warc.gz").write_bytes(whole + whole[: len(whole) // 2])
    fs = pyarrow.fs.LocalFileSystem()
    with pytest.raises(EOFError):
        list(warc._records(fs, str(tmp_path / "a.warc.gz")))


def test_warc_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x")],
        "page_id long, url string, html string, block string",
    )
    got = warc.derive(warc.page_responses(pages)).collect()
    assert len(got) == 8 and len({r["refers_to"] for r in got}) == 3
    assert warc.derive(warc.page_responses(pages.limit(0))).collect() == []


# --- passages ----------------------------------------------------------------------


@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_compact_windows_partition_the_spans(values, least):
    place, left, right = passages.compact_windows(np.array(values, np.uint64), np.array([0, len(values)]), least)
    told = {}
    for p, a, b in zip(place.tolist(), left.tolist(), right.tolist()):
        for i in range(a, p + 1):
            for j in range(p, b + 1):
                assert (i, j) not in told
                told[i, j] = p
    for i in range(len(values)):
        for j in range(i + least - 1, len(values)):
            assert told[i, j] == i + values[i : j + 1].index(min(values[i : j + 1]))


def repeated(docs):
    return {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}


def test_passages_planted(spark, make):
    rng = random.Random(5)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    shared, line = text(60), text(30)
    edited = shared[:30] + ["edited"] + shared[31:]
    rows = [(i, " ".join(text(40) + line + text(40))) for i in range(20)]  # a line of 30 words: no passage
    rows += [(100 + i, " ".join(text(rng.randrange(90)) + shared + text(rng.randrange(90)))) for i in range(10)]
    rows += [(200, " ".join(text(20) + edited + text(20))), (201, " ".join(text(300)))]
    whole = text(200)
    rows += [(300 + i, " ".join(whole[: 20 * i] + ["changed"] + whole[20 * i + 1 :])) for i in range(8)]
    got = repeated(make(rows))
    assert len(got) == len(rows)
    assert all(got[i]["class_id"] == i and got[i]["n_repeated"] == 0 for i in [*range(20), 201])
    assert {got[i]["class_id"] for i in [*range(100, 110), 200]} == {100}
    assert all(got[i]["n_repeated"] >= 58 and got[i]["n_passages"] == 1 for i in range(100, 110))
    assert {got[300 + i]["class_id"] for i in range(8)} == {300}
    assert all(got[300 + i]["n_repeated"] >= 190 for i in range(8))


@pytest.mark.parametrize("seed", range(8))
def test_every_context_of_a_slice_goes_on(seed):
    """A text of a slice goes on where a smaller one holds the same words in another context."""
    rng = random.Random(seed)
    stock = [[f"w{rng.randrange(10**6)}" for _ in range(15)] for _ in range(6)]
    tail = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    ahead = [w for line in stock for w in [*line, *(f"x{rng.randrange(10**6)}" for _ in range(20))]]
    behind = [w for line in stock for w in [*line, *(f"y{rng.randrange(10**6)}" for _ in range(20))]]
    first, second, third = " ".join(ahead), " ".join(behind + tail), " ".join(tail[:5] + behind)

    def sent(texts, nodes):
        return passages._meetings(Words(pa.array(texts), ALNUM), np.array(nodes, np.uint64)).to_pylist()

    def groups(rows, node):
        return {r["grp"] for r in rows if r["node"] == node}

    by_itself, both = sent([second], [2]), sent([first, second], [1, 2])
    assert groups(by_itself, 2) & groups(sent([third], [3]), 3)
    assert groups(by_itself, 2) <= groups(both, 2)
    assert {r["grp"] for r in both} == {r["grp"] for r in both if not r["met"]}


def test_shared_rows_are_whole_and_single():
    rows = [(g, n, False) for g, n in [(1, 5)] * 3 + [(2, 5), (2, 6), (2, 6), (3, 1), (4, 1), (4, 2), (4, 3)]]
    rows += [(5, 1, True), (6, 2, True)]
    for size in (1, 2, 3, 20):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(("grp", "node", "met"), r)) for r in p]) for p in parts]
        got = [r for b in passages._shared(batches) for r in zip(*b.to_pydict().values())]
        assert sorted(got) == [(2, 5), (2, 6), (4, 1), (4, 2), (4, 3), (5, 1), (6, 2)]


def test_crowded_meetings_are_finished(spark, make, monkeypatch):
    """Two near-duplicates that meet only where many texts hold one of two stock lines, and no lead is one of them."""
    import xxhash

    monkeypatch.setattr(passages, "LEADS", 0)  # as if every draw had missed
    rng = random.Random(7)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    lines = text(40), text(40)
    rows = [(i, " ".join(text(60) + lines[i % 2] + text(60))) for i in range(120)]
    node = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    pair = []
    while len(pair) < 2:  # the largest nodes, so that neither is the first lead
        new = " ".join(text(60) + lines[0] + text(1) + lines[1] + text(60))
        if 0.98 * 2**63 < node(new) < 2**63:
            pair.append(new)
    got = repeated(make(rows + [(1000 + i, t) for i, t in enumerate(pair)]))
    assert all(got[i]["class_id"] == i and got[i]["n_repeated"] == 0 for i in range(120))
    assert got[1000]["class_id"] == got[1001]["class_id"] == 1000
    assert got[1000]["n_repeated"] >= 70


def test_passages_of_odd_rows(spark, make):
    got = passages.repeated_passages(make(odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["class_id"] for i in (None, 4, 5) for r in by[i]} == {4}
    assert all(r["n_repeated"] >= 116 for i in (None, 4, 5) for r in by[i])
    assert all(by[i][0]["class_id"] == i and not by[i][0]["n_repeated"] for i in (1, 2, 3, 6, 7, 8))
    assert passages.repeated_passages(make([])).collect() == []


# --- mixing ------------------------------------------------------------------------


def test_mixture_of_odd_rows(spark, make):
    rows = odd_rows()
    got = mixing.mixture(make(rows)).select("doc_id", "size", "source_size", "target", "times").collect()
    same([(*r[:3], round(r[3], 6), r[4]) for r in got],
         [(*r[:3], round(r[3], 6), r[4]) for r in brute.mixture(as_dicts(rows))])
    assert mixing.mixture(make([])).collect() == []
    same(mixing.mixture(make([(1, None, None)])).select("target", "size").collect(), [(0.0, 0)])


def test_mixture_reaches_targets(spark, make):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(1, 40), f"s{min(int(rng.expovariate(0.5)), 5)}") for i in range(3000)]
    taken, targets = {}, {}
    for r in mixing.mixture(make(docs)).collect():
        assert 0 <= r["times"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["times"]
        targets[r["source"]] = r["target"]
    assert all(abs(taken[s] - targets[s]) <= 20 for s in taken)
    assert sum(targets.values()) == pytest.approx(sum(len(d[1].split()) for d in docs))


def test_mixed_documents_repeat_rows(spark, make):
    rows = [(i, f"{i} " * (i + 1), "ab"[i % 2]) for i in range(40)]
    docs = make(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = [r[0] for r in brute.mixture(as_dicts(rows)) for _ in range(r[4])]
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(want)


# --- SimHash -----------------------------------------------------------------------


def test_simhash_of_odd_rows(spark, make):
    rows = [r for r in odd_rows() if r[0] != 6] + [(6, "a b c " * 3000, "a")]
    same(simhash.near_duplicates(make(rows)).collect(), brute.simhash_classes(as_dicts(rows)))
    assert simhash.near_duplicates(make([])).collect() == []
    same(simhash.near_duplicates(make([(None, "x"), (None, "x")])).select("component_id").collect(), [(None,), (None,)])


def test_one_of_each(spark, make):
    docs = make([(3, "a b c"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (9, "x y z w v"), (None, "only one here")])
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    same(left.select("doc_id").collect(), [(2,), (9,), (None,)])


def clustered(rng, n):
    """Fingerprints of which many are a few bits apart."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 60)):
            out.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("block", [8, 4096])
@pytest.mark.parametrize("thresholds", [None, (1, 1, 0), (2, 1), (1, 0, 0, -1, 0)])
def test_links_connect_all_within_the_limit(spark, monkeypatch, block, thresholds):
    rng = random.Random(11)
    prints = clustered(rng, 700)
    monkeypatch.setattr(simhash, "BLOCK", block)
    if thresholds:
        m = len(thresholds)
        groups = [list(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)]
        if -1 in thresholds:  # the unused part goes to its neighbour
            groups = [[b for g in groups[:2] for b in g], groups[2], groups[3], [], groups[4]]
            thresholds = (2, 0, 0, -1, 0)
        monkeypatch.setattr(simhash, "allocate", lambda *_: (groups, list(thresholds)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got, want = brute.Union(), brute.Union()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    for a, b in edges:
        got.join(a & (2**64 - 1), b & (2**64 - 1))
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                want.join(a, b)
    assert [got.find(p) for p in prints] == [want.find(p) for p in prints]


def test_allocation_covers_the_limit():
    rng = np.random.default_rng(1)
    bits = rng.random((4000, 64)) < rng.uniform(0.1, 0.9, 64)
    both = bits.T.astype(float) @ bits
    seen = set()
    for n in (1, 4000, 10**6, 10**9, 10**12):
        groups, thresholds = simhash.allocate(n, both * (n / 4000))
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in thresholds) == simhash.LIMIT + 1
        seen.add(tuple(thresholds))
    assert len(seen) > 1  # more documents, other thresholds


# --- licenses ----------------------------------------------------------------------


def test_license_scan_of_odd_rows(spark, make):
    texts = [
        None, "", "...", "MIT License", "Licensed under the Apache License, Version 2.0; see CC-BY-SA 4.0.",
        "SPDX-License-Identifier: GPL-2.0-or-later " * 3, "cc by cc by cc by", "the mit licenses",
        "GNU Lesser General Public License v2.1 or GNU General Public License version 3",
        "x " * 30_000 + "all rights reserved " * 400, "http://www.gnu.org/licenses/gpl-3.0.html", "MİT License K",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(make([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base, (labels, covered) = brute.license_base(t, licenses.PHRASES), brute.license_rules(t, licenses.rules())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == base[:4], t
        assert r["labels"] == ",".join(sorted(labels | set(base[4]))), t
        assert r["score"] == pytest.approx(covered / base[0] if base[0] else 0.0)
    assert got[4]["labels"] == "apache,cc-by-sa" or "apache" in got[4]["labels"]
    assert licenses.scan(make([])).collect() == []


def matches_of(pattern, rng):
    """Some texts that the pattern matches, drawn from its parse tree."""
    from re import _parser

    def draw(tree):
        out = ""
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, value = rng.choice(arg)
                if str(kind) == "CATEGORY":
                    out += rng.choice("0123456789")
                else:
                    out += chr(rng.randint(*value) if str(kind) == "RANGE" else value)
            elif op == "BRANCH":
                out += draw(rng.choice(arg[1]))
            elif op == "SUBPATTERN":
                out += draw(arg[3])
            elif op == "MAX_REPEAT":
                out += "".join(draw(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
            else:
                assert op == "ASSERT"
        return out

    tree = _parser.parse(pattern)
    return {draw(tree) for _ in range(60)}


def test_keywords_leave_out_no_match():
    rng = random.Random(3)
    for rule in licenses.rules():
        assert all(rule["keyword"] in text.split() for text in matches_of(rule["pattern"], rng)), rule


def test_license_names_without_abbreviations(spark, make):
    texts = {
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa",
        "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
        "Creative Commons Attribution-NoDerivatives 4.0": "cc-by-nd",
        "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa",
        "Creative Commons Attribution 4.0": "cc-by",
        "under the Zero-Clause BSD": "0bsd",
        "GPL3 or later": "gpl",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(make(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_license_suppression(spark, make):
    got = licenses.scan(make([(1, "licensed under the GNU Affero General Public License v3.0"), (1, None)])).collect()
    assert sorted(r["labels"] for r in got) == ["", "agpl"]


# --- quality -----------------------------------------------------------------------


def test_quality_of_odd_rows(spark, make):
    rows = odd_rows() + [
        (20, "a b c d e f\n" * 9, None), (21, "Same same same same same Same x y z w v u", None),
        (22, "LOUD WORDS " * 3 + " ".join(f"u{i}" for i in range(9)), None), (23, "# $ % ok fine words " * 2, None),
        (24, "\n\n x\nx \nx\n" + " ".join(f"v{i}" for i in range(30)), None),
    ]
    want = [(r[0], *brute.quality(r[1])) for r in rows]
    same(quality.judge(make(rows)).collect(), want)
    docs = make(rows)
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    same(left.select("doc_id").collect(), [(r[0],) for r in want if r[-1]])
    assert quality.judge(make([])).collect() == []


def test_order_of_rules_does_not_change_the_verdict():
    rng = random.Random(2)
    texts = pa.array([" ".join(rng.choice(["a", "bb", "CC", "#", "d\n"]) for _ in range(rng.randrange(60))) for _ in range(300)])
    want = [brute.quality(t)[-1] for t in texts.to_pylist()]
    for _ in range(5):
        order = list(quality.RULES)
        rng.shuffle(order)
        assert quality.good(texts, order).tolist() == want


def test_rules_are_ordered_by_rejections_for_their_cost(spark, make):
    slow = quality.Rule("slow", lambda t: __import__("time").sleep(0.05) or np.ones(t.rows, dtype=bool))
    never = quality.Rule("never", lambda t: np.zeros(t.rows, dtype=bool))
    quick = quality.Rule("quick", lambda t: np.ones(t.rows, dtype=bool))
    got = quality.order_rules(make([(i, "x") for i in range(50)]), rules=[never, slow, quick])
    assert [r.name for r in got] == ["quick", "slow", "never"]


# --- sharding ----------------------------------------------------------------------


def test_shards_of_odd_rows(spark, make):
    got = sharding.uniform_shards(make(odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r["size"] for r in got)[:2] == [1, 1]
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 1 <= len(slots) <= 2
    assert sharding.uniform_shards(make([])).collect() == []


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    for good, bad, draws in ((5, 7, 4), (0, 3, 2), (3, 0, 2), (40, 60, 30), (1000, 9000, 500)):
        got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)])
        total = good + bad
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
        spread = math.sqrt(draws * good * bad * (total - draws) / total**2 / max(total - 1, 1))
        assert abs(got.mean() - draws * good / total) <= 5 * spread / math.sqrt(4000) + 1e-12
        assert got.std() == pytest.approx(spread, rel=0.1, abs=1e-12)


def test_matrix_has_the_sums():
    sizes, room = [7, 0, 20, 13, 1], sharding.shard_sizes(41, 8)
    matrix = sharding.communication_matrix(sizes, room, 1)
    assert [sum(r) for r in matrix] == sizes and [sum(c) for c in zip(*matrix)] == room
    assert matrix == sharding.communication_matrix(sizes, room, 1)


def test_shuffle_is_uniform(spark, make):
    docs = make([(i, f"t{i}") for i in range(2000)])
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.uniform_shards(docs).collect()}
    early = sum(got[i][0] < 4 for i in range(1000))
    assert abs(early - 500) < 80
    assert abs(sum(got[i][1] for i in range(1000)) / 1000 - 124.5) < 12


# --- language model ----------------------------------------------------------------


def test_likelihood_is_exact_for_any_piece_length(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [None, "", "a b a c", "c c b " * 9, " ".join("abcd"[i % 4] for i in range(37))]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    states = 3
    draw = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    model = hmm.Model(draw(states), draw(states, states), draw(states, hmm.BUCKETS + 1).T, draw(states))
    columns = ["sizes", "held", "top", "tokens", "n_tokens", "buckets"]
    chunk = hmm.Chunk(hmm._chunk(part, 0).select(columns).to_pylist()[0])
    want = []
    for a, b in zip(chunk.begins, chunk.ends):
        weights = model.start * model.emit[chunk.buckets[a]]
        for t in range(a + 1, b):
            weights = (weights @ model.move) * model.emit[chunk.buckets[t]]
        want.append(math.log(weights.sum()))
    for piece in (1, 2, 5, 1000):
        monkeypatch.setattr(hmm, "PIECE", piece)
        assert hmm.log_likelihood(model, chunk) == pytest.approx(want)


def test_expected_counts_like_all_paths(monkeypatch):
    from itertools import product

    rng = np.random.default_rng(7)
    docs = ["a b a", "c", "b b c a"]
    part = pa.RecordBatch.from_arrays([pa.array([1, 3, 4], pa.int64()), pa.array(docs)], ["doc_id", "text"])
    draw = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    model = hmm.Model(draw(2), draw(2, 2), draw(2, hmm.BUCKETS + 1).T, draw(2))
    columns = ["sizes", "held", "top", "tokens", "n_tokens", "buckets"]
    chunk = hmm.Chunk(hmm._chunk(part, 0).select(columns).to_pylist()[0])
    chunk.held[:] = False
    counts, moves, starts = np.zeros((hmm.BUCKETS + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    hmm.expected_counts(model, chunk, counts, moves, starts)
    want_c, want_m, want_s = np.zeros_like(counts), np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(chunk.begins, chunk.ends):
        seen = chunk.buckets[a:b]
        paths = list(product(range(2), repeat=b - a))
        chance = []
        for path in paths:
            p = model.start[path[0]] * model.emit[seen[0], path[0]]
            for x, y, s in zip(path, path[1:], seen[1:]):
                p *= model.move[x, y] * model.emit[s, y]
            chance.append(p)
        for path, p in zip(paths, np.array(chance) / sum(chance)):
            want_s[path[0]] += p
            for x, s in zip(path, seen):
                want_c[s, x] += p
            for x, y in zip(path, path[1:]):
                want_m[x, y] += p
    assert counts == pytest.approx(want_c) and starts == pytest.approx(want_s)
    assert moves * model.move == pytest.approx(want_m)


def test_language_model_of_odd_rows(spark, make):
    rows = [r for r in odd_rows() if r[0] != 6] + [(6, "a b c " * 3000, "a")]
    got = hmm.language_model_scores(make(rows), rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == hmm.held_out(r["doc_id"])
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 1]
    assert hmm.language_model_scores(make([]), rounds=1).collect() == []


def test_training_raises_the_likelihood(spark, make):
    rng = random.Random(1)
    docs = make([(i, " ".join(rng.choice("abcd" if i % 2 else "wxyz") for _ in range(40))) for i in range(200)])
    chunks = hmm.keep(hmm.encode(docs.select("doc_id", "text")), "test-chunks")
    one = hmm.Chunk(hmm_row(chunks))
    scores = [hmm.log_likelihood(hmm.train(chunks, 2, n), one).sum() for n in (0, 1, 4)]
    assert scores[0] < scores[1] <= scores[2]


def hmm_row(chunks):
    return chunks.select("sizes", "held", "top", "tokens", "n_tokens", "buckets").toArrow().to_pylist()[0]


# --- token files -------------------------------------------------------------------


@given(st.lists(st.text(max_size=30) | st.text(alphabet="aB'é9<|startoftext>. \n\x1c ́", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_word_by_word_is_that_of_the_text(texts):
    coder = tokenfile.encoder(vocabulary())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = coder.encode(pa.array(texts, pa.string()), 1)
    got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_remembered_words_are_bounded(monkeypatch):
    coder = tokenfile.Encoder(vocabulary())
    monkeypatch.setattr(tokenfile, "CACHED_WORDS", 5)
    for i in range(60):
        text = f"x{i} Y{i % 7}, z."
        got = coder.encode(pa.array([text]), 1)[0].tolist()
        assert got == coder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(coder.keys) == len(coder.begin) == len(coder.size) <= 5 + 8 and len(coder.pool) <= 60


def test_tokenizers_that_join_across_blanks_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_of_odd_rows(spark, make, tmp_path):
    rows = odd_rows()
    folder = str(tmp_path / "tokens")
    got = tokenfile.written_documents(make(rows), vocabulary(), folder, length=64, batch=4).collect()
    coder = tokenfile.encoder(vocabulary())
    ordered = sorted(as_dicts(rows), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0))
    same(got, brute.token_rows(ordered, coder.tokenizer))
    assert tokenfile.written_documents(make([]), vocabulary(), str(tmp_path / "none")).collect() == []


def test_sequences_are_views_of_the_file(spark, make, tmp_path):
    folder = str(tmp_path / "tokens")
    docs = [(i, f"some words {i} here") for i in range(300)]
    files = tokenfile.write_files(make(docs), folder, vocabulary(), length=32, batch=2).orderBy("piece").collect()
    coder = tokenfile.encoder(vocabulary())
    flat = [x for d in docs for x in coder.tokenizer.encode(d[1], add_special_tokens=False).ids + [1]]
    for f in files:
        count, start = -(-f["n_tokens"] // 32), f["start"]
        got = []
        for n in range(count):
            ids, mask = tokenfile.sequence(folder, f["piece"], n)
            assert len(ids) == len(mask) == 32 and not ids.flags.owndata and not mask.flags.owndata
            got += ids[mask == 1].tolist()
        assert got == flat[start : start + f["n_tokens"]]
    with pytest.raises(IndexError):
        tokenfile.sequence(folder, files[0]["piece"], 10**6)


# --- components --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components_like_union_find(spark, seed):
    from vigilog.llm.components import components

    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1300)]
    edges += [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(900)] + [(5, 5), (7, None)]
    union = brute.Union()
    for a, b in edges:
        if b is not None and a != b:
            union.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    same(got, [(x, union.find(x)) for x in union.up])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- moving only what is decided -----------------------------------------------------


def test_filter_holds_every_key(spark):
    from vigilog.llm import moves

    keys = spark.range(500).select(moves.F.xxhash64("id").alias("key")).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    rows = spark.range(4000).withColumn("m", moves.may_be_in(keys, moves.F.xxhash64("id")))
    got = {r["id"]: r["m"] for r in rows.collect()}
    assert all(got[i] for i in range(500)) and sum(got.values()) < 520
    none = spark.range(50).withColumn("m", moves.may_be_in(keys.limit(0), moves.F.col("id")))
    assert not any(r["m"] for r in none.collect())


def test_salted_join(spark):
    from vigilog.llm import moves

    rows = spark.range(300).selectExpr("id", "if(id < 200, 1, id) AS k")
    table = spark.createDataFrame([(1, "one"), (250, "x"), (999, "none")], "k long, name string")
    got = sorted((r["id"], r["name"]) for r in moves.salted_join(rows, table, "k", "id").collect())
    assert got == [(i, "one") for i in range(200)] + [(250, "x")]


def test_texts_without_words_are_not_repeated_beyond_the_cap(spark, make):
    docs = make([(1, "", "a"), (2, None, "a"), (3, "one two", "b"), (4, "", "b"), (5, "x " * 50, "c")])
    got = {r["doc_id"]: r["times"] for r in mixing.mixture(docs).collect()}
    assert max(got.values()) <= mixing.MAX_EPOCHS and got[1] == got[2] == mixing.MAX_EPOCHS


def test_rules_are_ordered_by_what_they_add(spark):
    texts = ["# " * 40 + "x" * i for i in range(400)] + [f"plain words number {i} " * 5 for i in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    ordered = quality.order_rules(docs)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)
    assert [r.name for r in quality.order_rules(docs.limit(0))] == [r.name for r in quality.RULES]


def test_pipeline_of_odd_and_of_no_rows(spark, make, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    import corpus_pipeline

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    items = pa.table({"item_id": pa.array([1, None], pa.int64()), "text": ["some benchmark words " * 5, None]})
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3), ("odd", [(i, t, None, s, None) for i, t, s in odd_rows()])):
        folder = tmp_path / name
        folder.mkdir()
        columns = list(zip(*rows)) if rows else [[]] * 5
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), folder / "documents.parquet")
        pq.write_table(items, folder / "benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(got) == (name == "odd")
        assert all(r["n_tokens"] > 1 for r in got)


MENTIONED = {
    "GNU GPLv3": "gpl", "LGPL-2.1": "lgpl", "Apache-2.0": "apache", "It is licensed under GPL": "gpl", "BSD-licensed": "bsd",
    "GNU Affero GPL": "agpl", "Creative Commons Zero": "cc0", "CC BY-NC-SA 4.0": "cc-by-nc-sa", "AGPLv3 or later": "agpl",
    "lgplv3": "lgpl", "Lesser GPL v3": "lgpl", "GFDL 1.3": "gfdl", "GNU FDL": "gfdl", "Apache v2 licensed": "apache",
    "apache2 license": "apache", "ASL 2.0": "apache", "MIT-licensed": "mit", "MIT-style license": "mit", "bsd3": "bsd-3-clause",
    "ISC licensed": "isc", "zlib-licensed": "zlib", "Boost license 1.0": "boost", "MPL 2.0": "mpl", "MPLv2": "mpl", "EPL-2.0": "epl",
    "EUPL 1.2": "eupl", "Artistic-2.0": "artistic", "SIL OFL 1.1": "ofl", "ODbL": "odbl", "PSF license": "psf",
    "Server Side Public License v1": "sspl", "BUSL-1.1": "bsl", "cc zero": "cc0", "public domain software": "public-domain",
    "Creative Commons Attribution 4.0 International": "cc-by", "a proprietary license": "proprietary",
}


def test_plain_mentions(spark, make):
    from vigilog.llm.licenses import scan

    texts = [*MENTIONED, "He did mit gplus apache helicopters 2 0 zero"]
    got = {r["doc_id"]: r["labels"] for r in scan(make([(i, f"Some words. {t}, and more", None) for i, t in enumerate(texts)])).collect()}
    for i, label in enumerate(MENTIONED.values()):
        assert label in got[i].split(","), texts[i]
        assert {*got[i].split(",")} <= {label, "cc-by"}, (texts[i], got[i])
    assert got[len(MENTIONED)] == ""


def test_rules_are_hundreds_and_each_is_gated_by_its_own_word():
    from vigilog.llm.licenses import MENTIONS, rules

    assert len(rules()) > 380 and len({r["pattern"] for r in rules()}) > 0.95 * len(rules())
    assert all(keyword in pattern for _, keyword, pattern in MENTIONS)
