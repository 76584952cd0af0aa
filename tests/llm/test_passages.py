"""Near-duplicate passages: planted edits beside a search of sets, places, and what stays apart."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vigilog.llm import passages
from vigilog.llm.words import ALNUM, Words

WORDS = [f"w{i}" for i in range(4000)]


def text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def similarity(one, two):
    """Jaccard similarity of the sets of five-word shingles."""
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
    return len(a & b) / len(a | b)


def one_word(rng):
    """Fifty words, one of them replaced anywhere."""
    p = text(rng, 50)
    q = list(p)
    q[rng.randrange(50)] = rng.choice(WORDS)
    return p, q


def inserted(rng):
    """One to twelve words put in anywhere."""
    p = text(rng, rng.randrange(60, 130))
    at = rng.randrange(len(p))
    return p, p[:at] + text(rng, rng.randrange(1, 13)) + p[at:]


def nine_in_the_middle(rng):
    p = text(rng, rng.choice([85, 95]))
    return p, p[: len(p) // 2] + text(rng, 9) + p[len(p) // 2 :]


def three_words(rng):
    p = text(rng, rng.randrange(110, 250))
    q = list(p)
    for _ in range(3):
        q[rng.randrange(len(q))] = rng.choice(WORDS)
    return p, q


def long_block(rng):
    """A long passage with a block of a sixth of it put in."""
    p = text(rng, 600)
    at = rng.randrange(100, 500)
    return p, p[:at] + text(rng, 100) + p[at:]


KINDS = [one_word, inserted, nine_in_the_middle, three_words, long_block]


def planted(rng, kind):
    """Two texts around a pair of passages of similarity 0.8 or more."""
    while True:
        p, q = kind(rng)
        if similarity(p, q) >= passages.SIMILARITY:
            return tuple(text(rng, rng.randrange(20, 200)) + x + text(rng, rng.randrange(20, 200)) for x in (p, q))


def prepared(*texts):
    def packed(words):
        hashes = Words(pa.array([" ".join(words)]), ALNUM).hashes()
        return (hashes >> np.uint64(32)).astype(np.uint32).tobytes()

    return passages.prepared([packed(t) for t in texts])


@pytest.mark.parametrize("kind", KINDS)
def test_edited_passages_of_a_pair(kind):
    rng = random.Random(kind.__name__)
    found = 0
    for _ in range(100):
        one, two = planted(rng, kind)
        spans = passages.near_passages(*prepared(one, two))
        found += bool(spans)
        for a, b, c, d in spans:
            assert min(b - a, d - c) >= passages.MIN_WORDS
            assert similarity(one[a:b], two[c:d]) >= passages.SIMILARITY
    assert found >= 95


def test_edited_passages_are_linked(spark, make):
    rng = random.Random(11)
    pairs = [planted(rng, kind) for kind in KINDS for _ in range(24)]
    rows = [(2 * i + side, " ".join(words), None) for i, pair in enumerate(pairs) for side, words in enumerate(pair)]
    rows += [(10_000 + i, " ".join(text(rng, 150)), None) for i in range(50)]
    got = {r["doc_id"]: r for r in passages.repeated_passages(make(rows)).collect()}
    linked = sum(got[2 * i]["class_id"] == got[2 * i + 1]["class_id"] == 2 * i for i in range(len(pairs)))
    assert linked >= 0.95 * len(pairs)
    assert all(got[10_000 + i]["class_id"] == 10_000 + i for i in range(50))
    assert len({r["class_id"] for r in got.values()}) == len(rows) - linked


def test_every_place_of_a_key_meets_its_counterpart():
    """An exact passage that stands behind a variant of it in both texts is found where it stands."""
    rng = random.Random(5)
    found = 0
    for _ in range(60):
        p = text(rng, 60)
        variant = [w if i % 12 else rng.choice(WORDS) for i, w in enumerate(p)]
        one = text(rng, 80) + variant + text(rng, 100) + p + text(rng, 50)
        two = text(rng, 60) + variant + text(rng, 90) + p + text(rng, 50)
        spans = passages.near_passages(*prepared(one, two))
        found += any(a <= 245 and b >= 295 and c <= 215 and d >= 265 for a, b, c, d in spans)
    assert found >= 57


def test_passages_less_alike_stay_apart():
    rng = random.Random(9)
    for _ in range(60):
        p = text(rng, 60)
        q = list(p)
        for at in range(5, 60, 10):  # every tenth word differs: similarity below a half
            q[at] = rng.choice(WORDS)
        one, two = text(rng, 60) + p + text(rng, 60), text(rng, 60) + q + text(rng, 60)
        assert passages.near_passages(*prepared(one, two)) == []


def test_repeating_texts():
    line = text(random.Random(1), 7)
    one, two = prepared(line * 40, line * 55)
    spans = passages.near_passages(one, two)
    assert spans and all(b - a >= 50 and d - c >= 50 for a, b, c, d in spans)
    assert passages.near_passages(*prepared(["a"] * 300, ["b"] * 300)) == []
    assert passages.near_passages(*prepared([], ["a"] * 60)) == []


def test_fewest_tokens():
    rng = random.Random(2)
    for _ in range(200):
        n, k = rng.randrange(0, 130), rng.choice([1, 3, 20, 500])
        tokens = np.array([rng.randrange(k) for _ in range(n)], dtype=np.uint64)
        spans = [len(set(tokens[i : i + 46].tolist())) for i in range(n - 45)]
        assert passages._fewest_tokens(tokens) == min(spans, default=n)


def test_texts_with_near_duplicates_share_enough_tokens():
    rng = random.Random(3)
    texts = [t for kind in KINDS for _ in range(6) for t in planted(rng, kind)]
    line = text(rng, 25)
    texts += [text(rng, 90) + line + text(rng, 90) for _ in range(10)] + [["a", "b"] * 60, ["a", "b"] * 45, []]
    ready = prepared(*texts)
    enough = passages._tokens_enough(ready)
    for x in range(len(texts)):
        for y in range(x):
            if passages.near_passages(ready[x], ready[y]):
                assert enough[x, y]
    # A shared line of 25 words is no passage.
    assert not enough[60:70, 60:70][~np.eye(10, dtype=bool)].any()


def packed(*texts):
    hashes = [Words(pa.array([" ".join(t)]), ALNUM).hashes() for t in texts]
    return [(h >> np.uint64(32)).astype(np.uint32).tobytes() for h in hashes]


def test_only_pairs_that_cannot_hold_a_passage_are_left_out():
    rng = random.Random(13)
    texts = [t for kind in KINDS for _ in range(6) for t in planted(rng, kind)]
    run, line = ["x"] * 75, text(rng, 25)
    texts += [text(rng, 60) + run + text(rng, 60), text(rng, 40) + run[:60] + text(rng, 90), ["a", "b"] * 60, ["a", "b"] * 45]
    stock = [text(rng, 60) + line + text(rng, 60) + run[:30] + text(rng, 60) for _ in range(8)]
    texts += stock + [text(rng, 49), []]
    held, ready = passages.held_tokens(packed(*texts)), prepared(*texts)
    for x in range(len(texts)):
        for y in range(x):
            if passages.near_passages(ready[x], ready[y]):
                assert passages.may_hold(held[x], held[y]) and passages.may_hold(held[y], held[x])
    # Lines shared by texts that are far from a passage are no reason to prepare their windows.
    ours = held[len(texts) - 10 : len(texts) - 2]
    assert not any(passages.may_hold(a, b) for a in ours for b in ours if a is not b)


def test_a_text_is_prepared_once_a_group(monkeypatch):
    rng = random.Random(17)
    shared = text(rng, 80)
    texts = [text(rng, 40) + shared + text(rng, 40) for _ in range(12)]
    done = []
    once = passages.prepared
    monkeypatch.setattr(passages, "prepared", lambda p: done.extend(p) or once(p))
    pairs = pa.table({"x": [x for x in range(12) for _ in range(x)], "y": [y for x in range(12) for y in range(x)]})
    rows = pa.table({"node": list(range(12)), "id": [f"t{i}" for i in range(12)], "words": packed(*texts)})
    found = passages._examined(pairs, rows)
    assert found.num_rows == 66 and len(done) == 12


def test_nearest_smaller_with_runs_of_equal_values():
    rng = random.Random(19)
    for _ in range(200):
        tree = np.array([0, *(v for _ in range(12) for v in [rng.randrange(1, 5)] * rng.randrange(1, 4)), 0], np.uint64)
        before, after = passages._nearest_smaller(tree, -1), passages._nearest_smaller(tree, 1)
        for i in range(1, len(tree) - 1):
            assert before[i] == max(j for j in range(i) if tree[j] <= tree[i])
            assert after[i] == min(j for j in range(i + 1, len(tree)) if tree[j] < tree[i])
