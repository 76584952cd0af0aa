"""Registered queries beside their SQL twins or plain versions, on the smallest tables."""

import base64
import hashlib
import uuid
import zlib
from collections import Counter

import brute
import pyarrow.parquet as pq
import pytest
from compare import compare, duck
from conftest import SF

from vigilog.llm.queries import ORACLES, QUERIES


def rows_of(spark, key):
    return [tuple(r) for r in QUERIES[key](spark, SF).collect()]


@pytest.mark.parametrize("key", list(ORACLES))
def test_twin(spark, key):
    diff, rows = compare(spark, duck(SF), key, QUERIES[key], ORACLES[key], SF)
    assert not diff and rows, diff


def test_every_operator_has_one_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14))


def test_op1_finds_something(spark):
    found = [r for r in QUERIES["op1_decontaminate"](spark, SF).collect() if r["contaminated"]]
    assert found and all(r["n_hit"] >= 10 and r["n_items"] for r in found)


def test_op2(spark):
    import html.parser

    class Text(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.title, self.links, self.inside = "", 0, False

        def handle_starttag(self, tag, attrs):
            self.inside = tag == "title" or (self.inside and tag not in ("style", "script"))
            self.links += sum(k in ("href", "src", "action") for k, _ in attrs)

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "title"

        def handle_data(self, data):
            self.title += data if self.inside else ""

    pages = {p["page_id"]: p for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = QUERIES["op2_warc"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    assert len({r["refers_to"] for r in got}) == len({r["metadata_id"] for r in got}) == len(got)
    for r in got:
        seen = Text()
        seen.feed(pages[r["page_id"]]["html"])
        assert (r["title"], r["n_links"], r["target_uri"]) == (
            seen.title.strip(), seen.links, pages[r["page_id"]]["url"],
        )
        assert r["digests_ok"] and r["conversion_id"] and r["n_text_chars"]
        body = pages[r["page_id"]]["html"].encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        source = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["payload_digest"] == source and block.partition(b"\r\n\r\n")[2] == body
        for kind in ("metadata", "conversion"):
            assert r[f"{kind}_id"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r['refers_to']} {kind}')}>"
        text = brute.visible_text(pages[r["page_id"]]["html"])
        assert (r["n_text_chars"], r["text_sha1"]) == (len(text), hashlib.sha1(text.encode()).hexdigest())


def test_op3(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op3_passages"](spark, SF).collect()}
    assert len(got) == len(documents)
    exact = brute.passage_classes(documents)
    sizes = Counter(exact.values())
    for d, root in exact.items():
        assert got[d]["class_id"] == got[root]["class_id"]
        assert sizes[root] == 1 or got[d]["n_repeated"] >= 50
    assert all(r["class_id"] <= d for d, r in got.items())
    alone = [d for d, r in got.items() if r["n_passages"] == 0]
    assert all(got[d]["class_id"] == d for d in alone) and len(alone) > len(got) / 2


def test_op5(spark, documents):
    assert sorted(rows_of(spark, "op5_simhash")) == sorted(brute.simhash_classes(documents))


def test_op6(spark, documents):
    from vigilog.llm.licenses import PHRASES, rules

    got = {r["doc_id"]: r for r in QUERIES["op6_licenses"](spark, SF).collect()}
    every = rules()
    for d in documents:
        r, base = got[d["doc_id"]], brute.license_base(d["text"], PHRASES)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == base[:4]
        assert r["base_labels"] == ",".join(base[4])
        labels, covered = brute.license_rules(d["text"], every)
        assert r["labels"] == ",".join(sorted(labels | set(base[4])))
        assert r["score"] == pytest.approx(covered / base[0] if base[0] else 0.0)
    assert any(r["n_base"] for r in got.values())


def test_op8(spark, documents):
    got = QUERIES["op8_sharding"](spark, SF).collect()
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    slots = {}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert sorted(map(tuple, got)) == sorted(rows_of(spark, "op8_sharding"))


def test_op9(spark, documents):
    import math

    got = {r["doc_id"]: r for r in QUERIES["op9_hmm"](spark, SF).collect()}
    tokens = {d["doc_id"]: [*brute.words(d["text"], brute.BLANK), None] for d in documents}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(ts), sum(c[t] > 0 for t in ts), n,
        )
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_op10(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(rows_of(spark, "op10_tokens")) == sorted(brute.token_rows(documents, tokenizer))


def test_pipeline(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    docs = [d for d in documents if brute.quality(d["text"])[-1]]
    classes = {i: c for i, _, c in brute.simhash_classes(docs)}
    docs = [d for d in docs if classes[d["doc_id"]] == d["doc_id"]]
    clean = {r[0] for r in brute.contamination(docs, items) if not r[2]}
    docs = [d for d in docs if d["doc_id"] in clean]
    times = {r[0]: r[4] for r in brute.mixture(docs)}
    docs = [d for d in docs for _ in range(times[d["doc_id"]])]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.token_rows(docs, tokenizer))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output",
    ]
