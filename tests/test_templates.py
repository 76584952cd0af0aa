"""The template tree beside a miner that takes one message after the other."""

import hashlib
import random
import re

import pytest

from vigilog.operators import template_tree as tree
from vigilog.operators.templates import MASKS

SF = "/root/testdata/sf0.001"


def masked(message):
    for pattern, name in MASKS:
        message = re.sub(pattern, name, message)
    return message


def sequential(messages, similarity=0.4, prefix=2):
    """The template of each masked message, taken by falling count, then text."""
    counts = {}
    for m in messages:
        if m is not None:
            counts[masked(m)] = counts.get(masked(m), 0) + 1
    leaves, joined = {}, {}
    for text in sorted(counts, key=lambda t: (-counts[t], t)):
        tokens = text.split(" ")
        way = (len(tokens), *["<*>" if re.search("[0-9]", x) else x for x in tokens[:prefix]])
        own, best = leaves.setdefault(way, []), None
        for n, known in enumerate(own):
            same = sum(a == b != "<*>" for a, b in zip(known, tokens))
            rank = (same, known.count("<*>"), -n)
            if same >= similarity * len(tokens) and (best is None or rank > best[0]):
                best = (rank, n)
        if best is None:
            own.append(tokens)
            joined[text] = (way, len(own) - 1)
        else:
            own[best[1]] = [a if a == b else "<*>" for a, b in zip(own[best[1]], tokens)]
            joined[text] = (way, best[1])
    return {t: " ".join(leaves[way][n]) for t, (way, n) in joined.items()}, counts


def messages():
    rng = random.Random(1)
    kinds = [
        lambda: f"Failed password for {rng.choice('abc')} from 10.0.0.{rng.randrange(9)} port {rng.randrange(99)}",
        lambda: f"session {rng.choice(['opened', 'closed'])} for user {rng.choice('xyz')}",
        lambda: f"disk sd{rng.choice('ab')}{rng.randrange(3)} is {rng.choice(['full', 'slow'])} now",
        lambda: "  odd  blanks " + rng.choice("pq"),
        lambda: rng.choice(["", "one", "<*> two", "a b c d e", "a b x y z"]),
    ]
    return [rng.choice(kinds)() for _ in range(400)] + [None]


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(i, m, "x", "y") for i, m in enumerate(rows)], "id long, m string, text string, leaf string")
    templates, assigned = tree.mined_templates(frame, "m", **options)
    got = {r["id"]: r for r in tree.with_templates(frame, "m", assigned).collect()}
    return templates.collect(), got


def test_like_a_sequential_miner(spark):
    rows = messages()
    want, counts = sequential(rows)
    templates, got = mined(spark, rows)
    assert {i: r["template"] for i, r in got.items()} == {i: m if m is None else want[masked(m)] for i, m in enumerate(rows)}
    sizes = {}
    for text, template in want.items():
        sizes[template] = sizes.get(template, 0) + counts[text]
    assert {r["template"]: r["size"] for r in templates} == sizes
    for r in templates:
        assert r["template_id"] == int(hashlib.md5(r["template"].encode()).hexdigest()[:15], 16)
        assert r["tokens"] == len(r["template"].split(" "))
    assert all(r["text"] == "x" for r in got.values())


@pytest.mark.parametrize("leaf_texts", [1, 5])
def test_large_leaves_are_mined_in_parts(spark, leaf_texts):
    rows = [f"load of host {h} reached {w} percent" for h in "abcdefghijkl" for w in ("some", "high", "full")] * 2
    templates, got = mined(spark, rows, leaf_texts=leaf_texts)
    assert sum(r["size"] for r in templates) == len(rows)
    for i, m in enumerate(rows):
        told = got[i]["template"].split(" ")
        assert all(t in ("<*>", w) for t, w in zip(told, masked(m).split(" ")))
    if leaf_texts == 5:
        assert [r["template"] for r in templates] == ["load of host <*> reached <*> percent"]


def test_no_messages(spark):
    templates, got = mined(spark, [])
    assert templates == [] and got == {}


def test_known_templates_are_given_to_new_messages(spark):
    templates, assigned = tree.mined_templates(spark.createDataFrame([(m,) for m in messages()], "m string"), "m")
    new = spark.createDataFrame([("session opened for user k",), ("session opened for nobody",), (None,), ("",)], "m string")
    got = {r["m"]: r["template"] for r in tree.assign_stream(new, "m", templates).collect()}
    assert got["session opened for user k"] == "session opened for user <*>"
    assert got["session opened for nobody"] is None and got[None] is None


def test_lines_of_documents(spark):
    from vigilog.plans import QUERIES

    lines = [x for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for x in r[0].split("\n") if x]
    want, counts = sequential(lines)
    got = {r["template"]: r["size"] for r in QUERIES["document_templates"](spark, SF).collect()}
    sizes = {}
    for text, template in want.items():
        sizes[template] = sizes.get(template, 0) + counts[text]
    assert got == sizes
