"""Runs: stretches of a text that repeat a period at least ``EXPONENT`` times over.

A run with period q, start s and length L holds the same words at s and s + q for L - q
words. These two places are a maximal pair: the words before them differ (or there is
none) and so do the words after. So every run is a maximal pair whose distance q satisfies

    3 q <= common words,   common words + q >= SHORTEST         (EXPONENT 4, SHORTEST 6)

and every maximal pair within these bounds is a stretch that nothing extends: its ends are
read off the pair and never searched for. Pairs at a multiple of the smallest period
describe the same stretch, of which the smallest distance is kept.

Pairs are enumerated bottom-up over the LCP-interval tree of a text:

* Suffixes are ordered by doubling the number of words compared, only where words still
  agree. Pairs have at least ``DEPTH`` words in common, so intervals below that depth hold
  none: only suffixes whose first DEPTH words occur twice in their text are ordered.
* An interval keeps its places with their left words as classes; the class lists lie merged
  in one ascending list. Intervals are joined smaller into larger: each place of the smaller
  one meets the nearest places on both sides, and those of another class make a pair.
  Between the two places of a run's smallest period the common words never stand again, so
  nothing nearer hides a pair. Each place moves to another list about log(n) times.
* Intervals whose places are all further apart than the bound allows are left out.

Texts are handled in slices of some megabytes, a text always whole; a text of n words costs
n log n. No row moves between tasks.

A null or empty text has no words and no runs; repeated rows are judged each; longest runs
that tie are told apart by start, then period. An empty table gives no rows. Columns beyond
the named ones are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigilog.llm.scratch import plain
from vigilog.llm.words import NON_BLANK, Words, mix, shingles, slices
from vigilog.session import ship_package

EXPONENT = 4  # a run holds its period this often
SHORTEST = 6  # words of the shortest run
DEPTH = 5  # the fewest words that the two places of a run have in common


def suffix_order(hashes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple:
    """Suffixes that share DEPTH words with another of their text, and what they share.

    ``hashes`` are the words of texts put end to end, ``owner`` the text of each and ``ends``
    the number after its text's last word. Returns (places, common): suffixes that share a
    beginning stand together, and ``common[k]`` is the number of words that ``places[k]``
    has in common with the one before it; 0 where it shares fewer than DEPTH.
    """
    n = len(hashes)
    hashes = np.maximum(hashes, np.uint64(1))  # 0 stands for a text's end
    none = np.zeros(0, np.int64)
    whole = np.flatnonzero(np.arange(max(n - DEPTH + 1, 0)) + DEPTH <= ends[: max(n - DEPTH + 1, 0)])
    if not len(whole):
        return none, none
    keys = mix(shingles(hashes, DEPTH)[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = keys[1:] != keys[:-1]
    many = np.zeros(len(keys), dtype=bool)  # equal to a neighbour
    many[1:] |= ~begins
    many[:-1] |= ~begins
    places = whole[order[many]]
    if not len(places):
        return none, none
    # Suffixes must lie in the order of their words, not of a hash, for those that share
    # more words to lie closer together.
    again, differs = _sorted(owner[places], _next_words(places, hashes, ends[places]))
    places, group = places[again], np.cumsum(differs) - 1
    number = np.full(n + 1, -1, dtype=np.int64)  # of an ordered suffix; -1 for any other
    levels, width = [(DEPTH, places, group)], DEPTH
    while True:
        open_ = np.zeros(len(places), dtype=bool)
        same = group[1:] == group[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        if not open_.any():
            return places, _common(places, levels, hashes, ends)
        number[places] = np.arange(len(places))
        here = np.flatnonzero(open_)
        own = places[here]
        met = number[np.where(own + width < ends[own], own + width, n)]
        # The first DEPTH words of a suffix that is not ordered stand nowhere else.
        follow = _next_words(own + width, hashes, ends[own])
        again, differs = _sorted(group[here], [*follow, np.where(met >= 0, group[met], 0)])
        begins = np.ones(len(places), dtype=bool)
        begins[1:] = ~same
        begins[here] = differs
        places = places.copy()
        places[here] = own[again]
        group = np.cumsum(begins) - 1
        width *= 2
        levels.append((width, places, group))


def _next_words(places: np.ndarray, hashes: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """The DEPTH words from each place on; zero from the text's end on."""
    last = len(hashes) - 1
    told = []
    for step in range(DEPTH):
        at = places + step
        told.append(np.where(at < stops, hashes[np.minimum(at, last)], np.uint64(0)))
    return told


def _sorted(major: np.ndarray, minor: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by several keys, and which rows in it differ from the row before."""
    order = np.lexsort((*reversed(minor), major))
    differs = np.ones(len(order), dtype=bool)
    differs[1:] = False
    for key in (major, *minor):
        key = key[order]
        differs[1:] |= key[1:] != key[:-1]
    return order, differs


def _common(places: np.ndarray, levels: list, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before: by levels, then word by word."""
    n = len(ends)
    left, right = places[:-1].copy(), places[1:].copy()
    common = np.zeros(len(places), dtype=np.int64)
    rank = np.full(n + 1, -1, dtype=np.int64)
    for width, at, group in reversed(levels):
        rank[at] = group
        a, b = rank[np.minimum(left, n)], rank[np.minimum(right, n)]
        same = (a >= 0) & (a == b)
        left[same] += width
        right[same] += width
    # What is left agrees in fewer than DEPTH words.
    stop_left, stop_right = ends[places[:-1]], ends[places[1:]]
    going = np.arange(len(left))
    for _ in range(DEPTH - 1):
        going = going[(left[going] < stop_left[going]) & (right[going] < stop_right[going])]
        going = going[hashes[left[going]] == hashes[right[going]]]
        left[going] += 1
        right[going] += 1
    common[1:] = left - places[:-1]
    common[1:][common[1:] < DEPTH] = 0
    return common


def _pairs_at(big: list, small: list, common: int, left: dict, found: list) -> list:
    """Join the lists of two children of an interval of ``common`` words."""
    reach = common // (EXPONENT - 1)
    size = len(big)
    for p in small:
        k = bisect_left(big, p)
        if k and p - big[k - 1] <= reach and left[p] != left[big[k - 1]]:
            found.append((big[k - 1], p, common))
        if k < size and big[k] - p <= reach and left[p] != left[big[k]]:
            found.append((p, big[k], common))
    if 8 * len(small) < size:
        for p in small:
            insort(big, p)
    else:
        big += small
        big.sort()  # two ascending stretches: linear
    return big


def maximal_pairs(places: list, common: list, left: dict) -> list[tuple[int, int, int]]:
    """(first place, second place, words in common) of the tree over one block of suffixes.

    ``common[k]`` belongs to ``places[k - 1]`` and ``places[k]``. Only pairs of different
    left words within the distance of a run are formed.
    """
    depths, lists, found = [], [], []
    child = [places[0]]
    for k in range(1, len(places) + 1):
        here = common[k] if k < len(places) else 0
        while depths and depths[-1] >= max(here, 1):
            depth, other = depths.pop(), lists.pop()
            if len(other) < len(child):
                other, child = child, other
            child = _pairs_at(other, child, depth, left, found)
            if depth == here:
                break
        if here:
            depths.append(here)
            lists.append(child)
            child = [places[k]]
    return found


def _promising(places: np.ndarray, common: np.ndarray) -> list[tuple[int, int]]:
    """Blocks of suffixes (by DEPTH words) whose closest places are near enough for a run."""
    begins = np.flatnonzero(common == 0)
    ends = np.append(begins[1:], len(places))
    block = np.repeat(np.arange(len(begins)), ends - begins)
    order = np.lexsort((places, block))
    gaps = np.full(len(places), np.iinfo(np.int64).max)
    gaps[1:] = np.where(block[order][1:] == block[order][:-1], np.diff(places[order]), gaps[0])
    nearest = np.minimum.reduceat(gaps, begins)
    deepest = np.maximum.reduceat(common, begins)
    good = (EXPONENT - 1) * nearest <= deepest
    return list(zip(begins[good].tolist(), ends[good].tolist()))


def runs_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs (text, start, length, period) of texts put end to end, by text, start, period.

    ``first[d]:first[d + 1]`` are the words of text d; starts are counted in their text.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    places, common = suffix_order(hashes, owner, np.repeat(first[1:], counts))
    found = []
    if len(places):
        before = np.zeros(len(hashes), dtype=np.uint64)
        before[1:] = hashes[:-1]
        at_start = np.zeros(len(hashes) + 1, dtype=bool)
        at_start[first] = True
        for low, high in _promising(places, common):
            block = places[low:high]
            own = block.tolist()
            # A text's first word follows nothing, which differs from every word.
            words = [None if s else w for s, w in zip(at_start[block].tolist(), before[block].tolist())]
            found += maximal_pairs(own, common[low:high].tolist(), dict(zip(own, words)))
    if not found:
        return np.zeros((0, 4), np.int64)
    a, b, shared = np.array(found, dtype=np.int64).T
    period = b - a
    length = shared + period
    keep = (length >= SHORTEST) & (length >= EXPONENT * period)
    a, length, period = a[keep], length[keep], period[keep]
    order = np.lexsort((period, length, a))
    a, length, period = a[order], length[order], period[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (length[1:] != length[:-1])
    a, length, period = a[new], length[new], period[new]
    order = np.lexsort((period, a))
    a, length, period = a[order], length[order], period[order]
    text = owner[a]
    return np.stack([text, a - first[text], length, period], axis=1)


def collapsed(words: Words, runs: np.ndarray) -> pa.Array:
    """The texts without what runs repeat: each keeps its first period; one space between words."""
    n = len(words)
    step = np.zeros(n + 1, dtype=np.int64)
    begin = words.first[runs[:, 0]] + runs[:, 1]
    np.add.at(step, begin + runs[:, 3], 1)
    np.add.at(step, begin + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    followed = np.zeros(len(kept), dtype=bool)  # by another kept word of the text
    followed[:-1] = owner[1:] == owner[:-1]
    data = words.data.copy()
    data[words.ends[kept[followed]]] = 32  # behind a word that is not the last stands a blank
    size = len(data)
    edge = np.zeros(size + 2, dtype=np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept] + followed] -= 1
    inside = np.cumsum(edge[:size], dtype=np.int8).astype(bool)
    sums = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(inside, out=sums[1:])
    offsets = sums[words.offsets]
    body = pa.py_buffer(data[inside].tobytes())
    whole = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), body)
    return whole.cast(pa.string())


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each input row.

    ``runs`` are structs (start, length, period) by start, then period, in words from 0;
    ``collapsed`` is the text without the words that repeat a run's first period.
    """
    ship_package(docs.sparkSession)
    narrow = plain(docs, doc_id=id_col, text=text_col)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), NON_BLANK, lower=False)
                runs = runs_of(words.hashes(), words.first)
                offsets = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                told = pa.StructArray.from_arrays(
                    [pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(words.counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), told),
                        collapsed(words, runs),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(scan, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
