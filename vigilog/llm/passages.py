"""Near-duplicate passages by compact windows.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; the tokens
of a text are its shingles of five words. Two spans of at least ``MIN_WORDS`` words in
different texts are near-duplicates if the sets of their shingles have a Jaccard
similarity of ``SIMILARITY`` or more.

* For each of ``HASHES`` hash functions, all spans whose smallest hash is at the same place
  form one compact window (left, place, right): places and bounds come from the Cartesian
  tree of the hashes. Only windows that hold a span of the least length are kept, about
  two for each such length of text.
* Windows with the same function and smallest hash meet if the 20 words to the right or
  those to the left of the place are the same, which every near-duplicate of this length
  shares around most of its places; short lines found everywhere meet nobody. Texts of
  one slice that share a window have met; one of them looks for texts of other slices,
  so a passage that stands everywhere does not send a row for each place to one task.
* In each meeting all texts are paired with one of them. A pair is examined whole: its
  windows are intersected over all functions, intervals covered by at least
  ``ENOUGH`` functions are candidates, and their shingle sets decide.
* A pair is examined only if its tokens leave a near-duplicate passage possible: no link is
  lost by that (``may_hold``).
* Rounds go on with LEADS other texts of each meeting that still holds several classes, as
  long as they link one pair of FRUITFUL. What is open then is finished: its texts are dealt
  to blocks of about BLOCK, and each two blocks meet in a cell, which names the pairs of
  different classes with enough tokens in common; each of these is examined once.
* Equal texts are one text from the start. Connected components of the links are classes.

Null texts have no words and no passages. Rows that repeat share their text's class. Rows
without an id belong to a class like others; one of such rows alone has a null class. An
empty table gives no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.components import components
from vigilog.llm.scratch import keep, plain
from vigilog.llm.words import ALNUM, Words, mix, shingles, slices, sliding_min

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES, ENOUGH = 5, 2
CONTEXT = 20  # words around a place that divide a meeting
SHIFT = 8  # words by which places may drift in any passage; a quarter of it in longer ones
BLOOM_BITS = 26
LEADS = 4  # texts of a meeting that a later round pairs with the others
FRUITFUL = 16  # rounds go on while one pair of so many is linked
BLOCK, BLOCK_WORDS = 256, 200_000  # texts of a block when a meeting is finished, and their words
ALIGNED = 0.6  # share of a span's tokens that must be paired before its sets are compared
GROUP = 256  # pairs of a group that are examined together
_AT_ONCE = 200_000  # words of texts prepared together
_COLUMNS = 8192  # tokens of a cell counted at once
_CLOSE = 8  # places within which a token that repeats counts once
_LEAST = MIN_WORDS - SHINGLE + 1  # shingles of the shortest passage
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def compact_windows(values: np.ndarray, first: np.ndarray, least: int, ties: bool = True):
    """(place, left, right) of the compact windows of at least ``least`` tokens.

    ``values`` are the hashes (none 0) of texts put end to end, text ``d`` at
    first[d]:first[d + 1]; bounds are inclusive and stay inside the text. Of equal hashes
    the leftmost is smaller. Without ``ties``, a window is left out whose hash stands in
    the window of an equal one less than ``least`` tokens before it, as in a text that
    repeats a few words over and over.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    low = sliding_min(values, least)
    end = np.repeat(first[1:], np.diff(first))
    whole = np.arange(len(low)) + least <= end[: len(low)]
    # A place has a window long enough only if it is smallest in some run of that length,
    # and then so is the nearest smaller place on either side: the tree needs no others.
    # It is smallest in one of the runs around it if it equals the largest of their minima.
    padded = np.zeros(n + 2 * least, dtype=np.uint64)
    padded[least : least + len(low)] = np.where(whole, low, np.uint64(0))
    best = ~sliding_min(~padded, least)[1 : n + 1]
    places = np.flatnonzero((values == best) & (best > 0))
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    owner = np.searchsorted(first, places, side="right") - 1
    # A 0 between texts, smaller than every hash, ends all searches.
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    at = np.arange(len(places)) + np.cumsum(np.diff(owner, prepend=-1) != 0)
    tree = np.zeros(len(places) + len(starts) + 1, dtype=np.uint64)
    spot = np.full(len(tree), -1, dtype=np.int64)
    tree[at], spot[at] = values[places], places
    before, after = _nearest_smaller(tree, -1)[at], _nearest_smaller(tree, 1)[at]
    left = np.where(spot[before] < 0, first[owner], spot[before] + 1)
    right = np.where(spot[after] < 0, first[owner + 1] - 1, spot[after] - 1)
    kept = right - left + 1 >= least
    if not ties:
        kept &= (tree[before] != tree[at]) | (places - spot[before] >= least)
    return places[kept], left[kept], right[kept]


def _nearest_smaller(tree: np.ndarray, side: int) -> np.ndarray:
    """For each value the nearest smaller one on a side (on the left equal ones count).

    All links are followed at once: what lies between a value and where its link points is
    never smaller, so a link that points at a larger value may take over that one's link.
    Neighbours of one value, as repeating words make them, are one value.
    """
    begins = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    sizes = np.diff(begins, append=len(tree))
    values = tree[begins]
    link = np.arange(len(values)) + side
    link[0], link[-1] = 0, len(values) - 1
    todo = np.flatnonzero(values)
    while len(todo):
        there = values[link[todo]]
        todo = todo[there > values[todo] if side < 0 else there >= values[todo]]
        link[todo] = link[link[todo]]
    if side > 0:
        return np.repeat(begins[link], sizes)
    out = np.arange(len(tree)) - 1
    out[begins] = (begins + sizes - 1)[link]
    return out


def _tokens(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles inside texts, their bounds by text, and the word each begins at."""
    runs = shingles(hashes, SHINGLE)
    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    return runs[at], bounds, at


def _packed_tokens(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts given as the first halves of their words' hashes, and their bounds by text."""
    hashes, first = _packed_hashes(packed)
    return _tokens(hashes, first)[:2]


def _packed_hashes(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    short = [np.frombuffer(x, np.uint32) for x in packed]
    first = np.concatenate(([0], np.cumsum([len(x) for x in short]))).astype(np.int64)
    return mix(np.concatenate([np.zeros(0, np.uint32), *short]).astype(np.uint64)), first


def _contexts(around: np.ndarray, first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the CONTEXT words from each place on, and of those up to its shingle's end; 0 if there are fewer.

    ``around`` are the hashes of all runs of CONTEXT words, ``first`` the bounds of the texts,
    ``word`` the words at which the shingles begin.
    """
    text = np.searchsorted(first, word, side="right") - 1
    to_right, to_left = np.zeros((2, len(word)), np.uint64)
    fits = word + CONTEXT <= first[text + 1]
    to_right[fits] = around[word[fits]]
    back = word + SHINGLE - CONTEXT
    fits = back >= first[text]
    to_left[fits] = around[back[fits]]
    return to_right, to_left


def _meetings(words: Words, nodes: np.ndarray) -> pa.RecordBatch:
    """(grp, node, met): the windows of a slice, by key and the words to one side of the place.

    All texts of a group that has several here have met; the first of each group looks for
    texts of other slices.
    """
    hashes = words.hashes()
    tokens, bounds, at = _tokens(hashes, words.first)
    around = shingles(hashes, CONTEXT)
    groups, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for seed in _SEEDS:
        values = mix(tokens ^ seed)
        place, _, _ = compact_windows(values, bounds, _LEAST, ties=False)
        word = at[place]
        key = mix(values[place] ^ seed)
        owner = nodes[np.searchsorted(words.first, word, side="right") - 1]
        for tag, side in enumerate(_contexts(around, words.first, word), 1):
            groups.append(mix(key ^ mix(side ^ np.uint64(tag)))[side != 0])
            owners.append(owner[side != 0])
    grp, node = np.concatenate(groups), np.concatenate(owners)
    order = np.lexsort((node, grp))
    grp, node = grp[order], node[order]
    once = np.ones(len(grp), dtype=bool)
    once[1:] = (grp[1:] != grp[:-1]) | (node[1:] != node[:-1])
    grp, node = grp[once], node[once]
    new = np.ones(len(grp), dtype=bool)
    new[1:] = grp[1:] != grp[:-1]
    several = ~new
    several[:-1] |= ~new[1:]
    met = np.repeat([False, True], [np.count_nonzero(new), np.count_nonzero(several)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((grp[new], grp[several])).view(np.int64)),
            pa.array(np.concatenate((node[new], node[several])).view(np.int64)),
            pa.array(met),
        ],
        ["grp", "node", "met"],
    )


def _shared(batches):
    """Rows that have met and, of the others, those whose group stands next to them with another text.

    They come in order of group; a group's texts come in any order, and may come out repeated.
    """
    rest, given = None, False  # rows of a group that may go on; whether the first was yielded
    for batch in batches:
        done = batch.column("met").to_numpy(zero_copy_only=False)
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "node")]
        if done.any():
            yield _rows(*(c[done] for c in now))
        now = [c[~done] for c in now]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        once = np.ones(len(now[0]), dtype=bool)
        once[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
        grp, node = (c[once] for c in now)
        last = grp == grp[-1]
        met = np.zeros(len(grp) + 1, dtype=bool)
        met[1:-1] = grp[1:] == grp[:-1]
        out = met[1:] | met[:-1]
        many = np.count_nonzero(last) > 1 << 20  # a group of very many rows goes on piece by piece
        if not many:
            out &= ~last
        if given:
            out[0] = False
        if out.any():
            yield _rows(grp[out], node[out])
        given = many or (given and bool(last[0]))
        rest = [grp[-1:], node[-1:]] if many else [grp[last], node[last]]
    if rest is not None and len(rest[0]) > 1:
        yield _rows(*(c[int(given) :] for c in rest))


def _rows(grp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(node)], ["grp", "node"])


def meetings(texts: DataFrame) -> DataFrame:
    """(grp, node): texts, by the 64-bit ``node`` of (node, text), that share a window."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                nodes = part.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                yield _meetings(Words(part.column("text"), ALNUM), nodes)

    rows = texts.mapInArrow(scan, "grp long, node long, met boolean")
    place = F.when(F.col("met"), F.xxhash64("grp", "node")).otherwise(F.col("grp"))
    dealt = rows.repartition(place).sortWithinPartitions("grp")
    return _different(keep(dealt.mapInArrow(_shared, "grp long, node long").distinct(), "passage-windows"))


def _different(meet: DataFrame) -> DataFrame:
    """One of the meetings that hold the same texts, and none of a single text.

    A copied passage is met once for each function and place, each time by the same texts;
    their number and 128 bits of all of them tell.
    """
    told = meet.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("h2"),
    )
    one = told.where("n > 1").groupBy("n", "h1", "h2").agg(F.min("grp").alias("grp")).select("grp")
    return meet.join(one, "grp", "left_semi")


@dataclass
class Tokens:
    """A text's tokens."""

    tokens: np.ndarray


@dataclass
class Prepared(Tokens):
    """A text's tokens and its windows, in order of their keys.

    ``beside`` are the keys with the words to the right, and those with the words to the left
    of the place (0 where there are too few), each ascending in ``order``.
    """

    key: np.ndarray
    beside: np.ndarray
    order: np.ndarray
    function: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray


def prepared(packed: list[bytes]) -> list[Prepared]:
    """All texts' windows at once: one run over the texts for all functions."""
    hashes, first = _packed_hashes(packed)
    tokens, bounds, at = _tokens(hashes, first)
    n = len(tokens)
    values = np.concatenate([mix(tokens ^ s) for s in _SEEDS])
    firsts = np.concatenate([bounds[:-1] + f * n for f in range(HASHES)] + [[HASHES * n]]).astype(np.int64)
    place, left, right = compact_windows(values, firsts, _LEAST, ties=False)
    function = place // n if n else place
    place, left, right = place - function * n, left - function * n, right - function * n
    text = np.searchsorted(bounds, place, side="right") - 1
    key = mix(tokens[place] ^ _SEEDS[function])
    beside = np.stack(
        [np.where(c != 0, mix(key ^ mix(c ^ np.uint64(tag))), np.uint64(0))
         for tag, c in enumerate(_contexts(shingles(hashes, CONTEXT), first, at[place]), 1)], axis=1
    ).reshape(-1, 2)
    order = np.lexsort((key, text))
    text, beside = text[order], beside[order]
    place, left, right = (x[order] - bounds[text] for x in (place, left, right))
    key, function = key[order], function[order]
    cuts = np.searchsorted(text, np.arange(len(packed) + 1)).tolist()
    edges = bounds.tolist()
    sides = np.stack([np.lexsort((beside[:, side], text)) for side in (0, 1)])
    beside = np.stack([beside[sides[side], side] for side in (0, 1)])
    out = []
    for d in range(len(packed)):
        own = slice(cuts[d], cuts[d + 1])
        rest = (x[own] for x in (key, function, place, left, right))
        found = next(rest)
        out.append(Prepared(tokens[edges[d] : edges[d + 1]], found, beside[:, own], sides[:, own] - cuts[d], *rest))
    return out


def _collisions(a: Prepared, b: Prepared):
    """Windows of both texts with the same function and hash.

    Each place meets the other text's first one of its key, and the first one that has the
    same words to its right or to its left: of a key that stands often in both texts every
    place meets its counterpart, and a run of equal places is met once each.
    """
    if not len(a.key) or not len(b.key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [_equal(a.key, b.key)]
    for side in (0, 1):
        i, j = _equal(a.beside[side], b.beside[side])
        found.append((a.order[side][i], b.order[side][j]))
    i, j = (np.concatenate(x) for x in zip(*found))
    good = a.key[i] == b.key[j]
    pairs = _distinct(i[good] * len(b.key) + j[good])
    return pairs // len(b.key), pairs % len(b.key)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values of two ascending arrays, each with the other's first."""
    to_b = np.minimum(np.searchsorted(b, a), len(b) - 1)
    to_a = np.minimum(np.searchsorted(a, b), len(a) - 1)
    one, two = np.flatnonzero(b[to_b] == a), np.flatnonzero(a[to_a] == b)
    return np.concatenate((one, to_a[two])), np.concatenate((to_b[one], two))


def near_passages(a: Prepared, b: Prepared) -> list[tuple[int, int, int, int]]:
    """Word spans (begin and end in a, begin and end in b) of near-duplicate passages."""
    i, j = _collisions(a, b)
    if not len(i):
        return []
    drift = a.place[i] - b.place[j]
    order = np.argsort(drift, kind="stable")
    i, j, drift = i[order], j[order], drift[order]
    low = np.maximum(a.left[i], b.left[j] + drift)
    high = np.minimum(a.right[i], b.right[j] + drift) + 1
    # What is put into a passage moves the places behind it: by a quarter of it at most.
    span = np.minimum(high[1:] - low[1:], high[:-1] - low[:-1])
    edges = np.flatnonzero(np.diff(drift) > np.maximum(SHIFT, span // 4)) + 1
    begins, ends = np.append(0, edges), np.append(edges, len(i))
    out: set[tuple[int, int, int, int]] = set()
    for x in np.flatnonzero(ends - begins >= ENOUGH).tolist():
        own = slice(begins[x], ends[x])
        wide = high[own] - low[own] >= _LEAST * 3 // 4
        function = a.function[i[own]][wide]
        if np.count_nonzero(np.bincount(function, minlength=HASHES)) < ENOUGH:
            continue
        drifts = _distinct(drift[own][wide])
        for begin, end in _covered(low[own][wide], high[own][wide], function):
            out.update(_verified(a.tokens, b.tokens, begin, end, drifts))
    return sorted(out)


def _covered(low: np.ndarray, high: np.ndarray, function: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that lie in windows of at least ENOUGH functions."""
    marks = _distinct(np.concatenate((low, high)))
    step = np.zeros((HASHES, len(marks)), np.int64)
    np.add.at(step, (function, np.searchsorted(marks, low)), 1)
    np.add.at(step, (function, np.searchsorted(marks, high)), -1)
    enough = (np.cumsum(step, axis=1) > 0).sum(0) >= ENOUGH
    change = np.diff(np.concatenate(([0], enough.astype(np.int8), [0])))
    opened, closed = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return list(zip(marks[opened].tolist(), marks[np.minimum(closed, len(marks) - 1)].tolist()))


def _verified(a: np.ndarray, b: np.ndarray, begin: int, end: int, drifts: np.ndarray):
    """Spans inside begin..end of ``a`` that are near-duplicates of spans of ``b``.

    Equal tokens are paired along the drifts of the windows that met; between the ends of
    a run of pairs the token sets decide, and a span that is not alike enough is cut at
    its widest gap.
    """
    back = np.full(end - begin, -1, np.int64)
    for d in drifts.tolist():
        low, high = max(begin, d), min(end, len(b) + d)
        if high > low:
            at = np.flatnonzero(a[low:high] == b[low - d : high - d]) + low
            at = at[back[at - begin] < 0]
            back[at - begin] = at - d
    p = np.flatnonzero(back >= 0)
    q = back[p]
    p = p + begin
    if len(p) < _LEAST * SIMILARITY:
        return []
    gaps = np.maximum(np.diff(p), np.abs(np.diff(q)))
    found, todo = [], [(0, len(p))]
    while todo:
        x, y = todo.pop()
        if y - x < _LEAST * SIMILARITY:
            continue
        a0, a1, b0, b1 = int(p[x]), int(p[y - 1]) + 1, int(q[x:y].min()), int(q[x:y].max()) + 1
        # Far fewer pairs than either span has tokens: no need to compare the sets.
        if y - x >= ALIGNED * max(a1 - a0, b1 - b0):
            span = _alike_span(a, b, a0, a1, b0, b1)
            if span:
                found.append((span[0], span[1] + SHINGLE - 1, span[2], span[3] + SHINGLE - 1))
                continue
        cut = x + int(gaps[x : y - 1].argmax())
        if gaps[cut] > 1:
            todo += [(x, cut + 1), (cut + 1, y)]
    return found


def _alike_span(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int):
    """The spans, or ones around them that reach the least length, if their sets are alike; else None.

    An edit near an end of a short passage leaves fewer paired tokens than a passage needs,
    so up to a fifth of it may lie outside of them, on either side.
    """
    short = _LEAST - min(a1 - a0, b1 - b0)
    for before in range(max(short, 0) + 1):
        after = max(short, 0) - before
        at = a0 - before, a1 + after, b0 - before, b1 + after
        inside = at[0] >= 0 and at[2] >= 0 and at[1] <= len(a) and at[3] <= len(b)
        if inside and _alike(a[at[0] : at[1]], b[at[2] : at[3]]):
            return at
    return None


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets of tokens have the similarity asked for."""
    one, two = _distinct(a), _distinct(b)
    both = np.sort(np.concatenate((one, two)))
    common = np.count_nonzero(both[1:] == both[:-1])
    return common >= SIMILARITY * (len(one) + len(two) - common)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values, ascending; for short arrays much faster than numpy's."""
    values = np.sort(values)
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _examined(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Verified passages of the pairs of a group: (a, b, a_begin, a_end, b_begin, b_end)."""
    ids, words = texts.column("id").to_pylist(), texts.column("words").to_pylist()
    named: dict[int, list[int]] = {}
    for at, node in enumerate(texts.column("node").to_pylist()):
        named.setdefault(node, []).append(at)
    held = [x for own in _portions(words) for x in held_tokens(own)]
    met = zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist())
    open_pairs = [(a, b) for x, y in met for a in named[x] for b in named[y] if a != b and may_hold(held[a], held[b])]
    wanted = sorted({at for pair in open_pairs for at in pair})
    ready = dict(zip(wanted, (x for own in _portions([words[at] for at in wanted]) for x in prepared(own))))
    rows = [(ids[a], ids[b], *span) for a, b in open_pairs for span in near_passages(ready[a], ready[b])]
    return pa.Table.from_batches([_found(rows)])


def _portions(packed: list[bytes]):
    """Texts of about _AT_ONCE words; a longer one alone."""
    steps = np.cumsum([len(x) for x in packed]) // (4 * _AT_ONCE)
    for step in np.unique(steps):
        own = np.flatnonzero(steps == step)
        yield packed[int(own[0]) : int(own[-1]) + 1]


@dataclass
class Held:
    """What a text's tokens tell of the passages it may share with another.

    ``known`` are its different tokens, ascending, ``number`` the place in ``known`` of each
    token of the text; ``gain`` is what a token counts if the other text has it, ``loss`` what
    it costs if not, ``slack`` what ``gain`` may leave out of a span.
    """

    known: np.ndarray
    number: np.ndarray
    gain: np.ndarray
    loss: np.ndarray
    slack: float
    fewest: int


def held_tokens(packed: list[bytes]) -> list[Held]:
    tokens, bounds = _packed_tokens(packed)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = tokens[begin:end]
        order = np.argsort(own, kind="stable")
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[order][1:] != own[order][:-1]
        number = np.empty(len(own), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        before = np.full(len(own), -1, dtype=np.int64)  # the same token's place before
        before[order[1:][~new[1:]]] = order[:-1][~new[1:]]
        # A span has each token once: one that stands a few places before counts there, if the
        # span begins no later, and one that the other text lacks costs where it stands first.
        close = (before >= 0) & (np.arange(len(own)) - before <= _CLOSE)
        gain = np.where(close, 0.0, 1 - SIMILARITY)
        slack = (1 - SIMILARITY) * _CLOSE if close.any() else 0.0
        loss = np.where(before < 0, SIMILARITY, 0.0)
        out.append(Held(own[order[new]], number, gain, loss, slack, _fewest_new(before)))
    return out


def may_hold(a: Held, b: Held) -> bool:
    """Whether the tokens of two texts leave any near-duplicate passages possible.

    Each of the two spans has at least the fewest different tokens of its text's spans, and
    a share of SIMILARITY of them stands in the other text.
    """
    if min(len(a.number), len(b.number)) < _LEAST:
        return False
    at = np.minimum(np.searchsorted(b.known, a.known), len(b.known) - 1)
    in_a = b.known[at] == a.known
    if np.count_nonzero(in_a) < SIMILARITY * max(a.fewest, b.fewest) - 1e-6:
        return False
    in_b = np.zeros(len(b.known), dtype=bool)
    in_b[at[in_a]] = True
    return _dense(a, in_a) and _dense(b, in_b)


def _dense(text: Held, shared: np.ndarray) -> bool:
    """Whether a span of the least length or more may have its share of tokens that the other text has."""
    sums = np.zeros(len(text.number) + 1)
    np.cumsum(np.where(shared[text.number], text.gain, -text.loss), out=sums[1:])
    lowest = np.minimum.accumulate(sums[: len(sums) - _LEAST])
    return bool((sums[_LEAST:] - lowest >= -text.slack - 1e-6).any())


def _found(rows: list[tuple]) -> pa.RecordBatch:
    names = ["a", "b", "a_begin", "a_end", "b_begin", "b_end"]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if n in "ab" else pa.int32()) for n, c in zip(names, cols)], names
    )


def _needed(nodes: DataFrame):
    """A Bloom filter, of a fixed number of bits, of the texts that met any other."""
    place = F.shiftrightunsigned("node", 64 - BLOOM_BITS)
    filled = (
        nodes.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"))
    )
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    for batch in filled.toArrow().to_batches():  # 2**(BLOOM_BITS - 6) rows at most
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def _packed_texts(texts: DataFrame, meet: DataFrame) -> DataFrame:
    """(node, id, words): the word hashes of texts that met another, one row a text."""
    told = texts.sparkSession.sparkContext.broadcast(_needed(meet.select("node").distinct()))

    def scan(batches):
        bits = told.value
        for batch in batches:
            for part in slices(batch.filter(pa.array(_maybe(bits, batch.column("node"))))):
                words = Words(part.column("text"), ALNUM)
                short = (words.hashes() >> np.uint64(32)).astype(np.uint32)
                packed = [short[a:b].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("id"), pa.array(packed, pa.binary())], ["node", "id", "words"]
                )

    found = texts.select("node", "id", "text").mapInArrow(scan, "node long, id string, words binary")
    return found.groupBy("node", "id").agg(F.first("words").alias("words"))


def _links(texts: DataFrame, meet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified passages of all rounds, as _examined gives them, and (node, root) of their texts."""
    spark = texts.sparkSession
    packed = keep(_packed_texts(texts, meet), "passage-texts")
    lead = meet.groupBy("grp").agg(F.min("node").alias("lead"))
    pairs = meet.join(lead, "grp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    tested = keep(pairs.distinct(), "passage-pairs")
    found = _passages_of(tested, packed)
    roots = keep(components(found.select("a", "b").distinct()), "passage-roots")
    names = packed.select("node", "id")
    turn, fruitful = 0, True
    while True:
        # Meetings whose texts are all of one class are done for good.
        label = F.min(F.coalesce("root", "id")).alias("label")
        labels = names.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").groupBy("node").agg(label)
        placed = meet.select("grp", "node").join(labels, "node")
        sides = placed.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        open_groups = sides.where("low <> high").select("grp")
        meet = keep(placed.join(open_groups, "grp"), "passage-open")
        if not fruitful:
            new = _rest_of(meet, packed, tested)
            return found.unionAll(new), keep(_merged(roots, new), "passage-roots")
        pairs = _more_pairs(meet, turn).join(tested, ["x", "y"], "left_anti")
        pairs = keep(pairs, "passage-pairs")
        new = _passages_of(pairs, packed)
        roots = keep(_merged(roots, new), "passage-roots")
        found, tested, turn = found.unionAll(new), tested.unionAll(pairs), turn + 1
        fruitful = new.select("a", "b").distinct().count() * FRUITFUL > pairs.count()


def _more_pairs(meet: DataFrame, turn: int) -> DataFrame:
    """Each open meeting's texts with LEADS of them, other each turn, of other classes."""
    order = Window.partitionBy("grp").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    leads = meet.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADS)
    leads = leads.select("grp", F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    met = meet.join(leads, "grp").where("label <> lead_label")
    return met.select(F.least("node", "lead").alias("x"), F.greatest("node", "lead").alias("y")).distinct()


def _rest_of(meet: DataFrame, packed: DataFrame, tested: DataFrame) -> DataFrame:
    """Passages of all pairs of different classes in open meetings that no round has tested."""
    lengths = packed.select("node", (F.octet_length("words") / 4).alias("n")).groupBy("node").agg(F.max("n").alias("n"))
    sizes = meet.join(lengths, "node").groupBy("grp").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS).alias("n"))
    sizes = keep(sizes.select("grp", "n", F.ceil("n").alias("blocks")), "passage-sizes")
    small = sizes.where("blocks = 1").agg(F.ceil(F.sum("n"))).first()[0] or 1
    dealt = meet.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    alone = F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))
    together = F.pmod(F.xxhash64("grp"), F.lit(small))
    cells = dealt.select("grp", "node", "label", "block", "blocks", other).select(
        F.when(F.col("blocks") > 1, alone).otherwise(together).alias("cell"), "grp",
        (F.col("block") != F.col("other")).alias("crossing"), "block", "node", "label",
    )
    texts = _among(packed, meet.select("node"))
    rows = cells.join(texts, "node")
    pairs = rows.groupBy("cell").applyInArrow(_cell_pairs, "x long, y long").distinct()
    return _passages_of(keep(pairs.join(tested, ["x", "y"], "left_anti"), "passage-pairs"), packed)


def _cell_pairs(cell: pa.Table) -> pa.Table:
    """Pairs of a meeting, of different classes and with enough tokens in common.

    A cell holds two blocks of a meeting, or one (then not ``crossing``), or whole small meetings.
    """
    grp, node, block = (cell.column(c).to_numpy() for c in ("grp", "node", "block"))
    label = cell.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    crossing = cell.column("crossing").to_numpy()
    names, place = np.unique(node, return_index=True)
    words = cell.column("words").take(pa.array(place))
    tokens, bounds = _packed_tokens(words.to_pylist())
    enough = _tokens_enough([Tokens(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    text = np.searchsorted(names, node)
    pairs = np.triu(enough[text[:, None], text], 1) & (grp[:, None] == grp) & (label[:, None] != label)
    pairs &= ~crossing[:, None] | (block[:, None] != block)
    x, y = (node[side] for side in np.nonzero(pairs))
    return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})


def _fewest_tokens(tokens: np.ndarray) -> int:
    """The fewest different tokens of any span of the least length."""
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1, dtype=np.int64)  # the same token's place before
    same = tokens[order][1:] == tokens[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return _fewest_new(before)


def _fewest_new(before: np.ndarray) -> int:
    """``_fewest_tokens`` by the place before of the same token, -1 if there is none."""
    n = len(before)
    if n < _LEAST:
        return n
    # A token is new in the spans that begin after its place before.
    at = np.arange(n)
    before = np.maximum(before, -1)
    step = np.bincount(np.maximum(before, at - _LEAST) + 1, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return int(np.cumsum(step)[: n - _LEAST + 1].min())


def _tokens_enough(texts: list[Tokens]) -> np.ndarray:
    """Whether two texts have as many tokens in common as any near-duplicate passages of theirs.

    A passage has at least the fewest different tokens of its text's spans, and of the larger
    of two sets that are alike the other holds a share of SIMILARITY.
    """
    n = len(texts)
    sizes = [len(t.tokens) for t in texts]
    text = np.repeat(np.arange(n), sizes)
    tokens = np.concatenate([t.tokens for t in texts])
    order = np.argsort(tokens, kind="stable")
    tokens, text = tokens[order], text[order]
    again = np.zeros(len(tokens), dtype=bool)
    again[1:] = (tokens[1:] == tokens[:-1]) & (text[1:] == text[:-1])
    before = np.full(len(tokens), -1, dtype=np.int64)
    before[order[1:][again[1:]]] = order[:-1][again[1:]]
    bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
    fewest = np.array([_fewest_new(before[a:b] - a) for a, b in zip(bounds[:-1], bounds[1:])])
    tokens, text = tokens[~again], text[~again]
    # Tokens that the same texts hold are one column that counts as often.
    begins = np.flatnonzero(np.concatenate((tokens[:1] == tokens[:1], tokens[1:] != tokens[:-1])))
    sizes = np.diff(begins, append=len(tokens))
    holders = np.add.reduceat(mix(text.astype(np.uint64) + np.uint64(1)), begins) if len(begins) else tokens
    common = sizes > 1
    _, at, times = np.unique(holders[common], return_index=True, return_counts=True)
    begins, sizes = begins[common][at], sizes[common][at]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, len(begins), _COLUMNS):
        own = slice(low, low + _COLUMNS)
        column = np.repeat(np.arange(len(sizes[own])), sizes[own])
        place = np.repeat(begins[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(len(column))
        holds = np.zeros((n, len(sizes[own])), np.float32)
        holds[text[place], column] = 1
        shared += (holds * times[own].astype(np.float32)) @ holds.T
    return shared >= SIMILARITY * np.maximum(fewest[:, None], fewest) - 1e-6


def _passages_of(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Passages of pairs (x, y) of nodes, those of a text in one group, so that it is prepared once there.

    A text's pairs go where those of the smallest text go that it is paired with; a group of
    many is dealt by text, small ones are put together.
    """
    home = pairs.groupBy("y").agg(F.min("x").alias("home"))
    placed = pairs.join(home, "y")
    sizes = placed.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    several = F.xxhash64("home", F.pmod(F.xxhash64("y"), "parts"))
    single = F.pmod(F.xxhash64("home"), F.lit(pairs.count() // GROUP + 1))
    grp = F.when(F.col("parts") > 1, several).otherwise(single).alias("grp")
    placed = keep(placed.join(sizes, "home").select(grp, "x", "y"), "passage-placed")
    nodes = placed.select(F.col("grp").alias("part"), F.explode(F.array("x", "y")).alias("node")).distinct()
    # Only the texts of these pairs are moved.
    texts = _among(packed, nodes.select("node")).join(nodes, "node").select("part", "node", "id", "words")
    examined = placed.groupBy("grp").cogroup(texts.groupBy("part")).applyInArrow(_examined, _FOUND)
    return keep(examined, "passage-links")


def _among(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``packed`` whose node may be one of ``nodes``, by a Bloom filter of fixed size."""
    told = packed.sparkSession.sparkContext.broadcast(_needed(nodes.distinct()))

    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array(_maybe(told.value, batch.column("node"))))

    return packed.select("node", "id", "words").mapInArrow(scan, "node long, id string, words binary")


def _maybe(bits: np.ndarray, nodes: pa.Array) -> np.ndarray:
    node = nodes.to_numpy(zero_copy_only=False).view(np.uint64)
    place = node >> np.uint64(64 - BLOOM_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _merged(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Roots after the links of a round: only the classes that it joins are worked on."""
    ids = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = roots.unionAll(ids.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    known = keep(known, "passage-roots")
    root_a = known.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    root_b = known.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    edges = new.select("a", "b").distinct().join(root_a, "a").join(root_b, "b")
    joined = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return known.join(joined, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))


_FOUND = "a string, b string, a_begin int, a_end int, b_begin int, b_end int"


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_words, n_repeated, n_passages), a row for each input row.

    ``class_id`` is the smallest id of the documents reached by near-duplicate passages and
    equal texts of at least MIN_WORDS words, the row's own if there is none; ``n_repeated``
    counts the words in passages that also stand in another text, ``n_passages`` the
    passages, overlapping ones joined. Equal texts repeat as a whole.
    """
    text = F.coalesce("text", F.lit(""))
    texts = plain(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.xxhash64(text).alias("node"), F.md5(text).alias("id"), text.alias("text")
    )
    meet = keep(meetings(texts.select("node", "text")), "passage-meetings")
    found, roots = _links(texts, meet)
    places = F.explode(
        F.array(
            F.struct(F.col("a").alias("id"), F.col("a_begin").alias("begin"), F.col("a_end").alias("end")),
            F.struct(F.col("b").alias("id"), F.col("b_begin").alias("begin"), F.col("b_end").alias("end")),
        )
    )
    # A row for each word of the text at most, however many texts share its passages.
    sides = found.select(places.alias("p")).groupBy("p.id", "p.begin").agg(F.max("p.end").alias("end"))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("parts"), F.lit(-1).alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["reach"]), F.lit(0))).alias("n"),
            (acc["parts"] + (s["begin"] > acc["reach"]).cast("long")).alias("parts"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
    )
    spans = sides.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).select("id", joined.alias("j"))
    return _classified(texts, roots, spans)


def _classified(texts: DataFrame, roots: DataFrame, spans: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part in slices(batch):
                words = pa.array(Words(part.column("text"), ALNUM).counts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("id"), words], ["doc_id", "id", "n_words"]
                )

    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, id string, n_words long"
    rows = keep(texts.select("doc_id", "id", "text").mapInArrow(count, schema), "passage-rows")
    by_text = rows.groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_words").alias("n"))
    known = (
        by_text.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .join(spans, "id", "left")
        .select("id", "low", "copies", "n", F.coalesce("root", "id").alias("root"), "j")
    )
    known = keep(known, "passage-classes")
    lowest = known.groupBy("root").agg(F.min("low").alias("class_id"))
    placed = known.join(lowest, "root").select("id", "copies", "class_id", "j")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= MIN_WORDS)
    alone = (F.col("n_words") < MIN_WORDS) & F.col("j").isNull()
    return rows.join(placed, "id").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("j.n", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("j.parts", F.lit(0))).cast("long").alias("n_passages"),
    )
