"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it. What each rule costs and how much it rejects beyond
the rules before it is measured on a bounded sample; rules then run in the order of rejections per second, and
texts already rejected are left out of the rest as soon as half of a slice is gone. The
order changes the work, never the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have no words and are rejected like empty
ones. Rows that repeat are judged alike; other columns, whatever their names, are passed
through by ``keep_good`` and left out by ``judge``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import plain
from vigilog.llm.words import NON_BLANK, Words, mix, shingles, slices
from vigilog.session import ship_package

SAMPLE_ROWS = 500  # texts on which cost and rejections are measured
SAMPLE_SHARE = 0.25  # of the rows may be among them
RUN = 5  # words of a repeated run

_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IN_WORD_START = NON_BLANK & ((np.arange(256) & 0xC0) != 0x80)  # first byte of a character


class Texts:
    """A slice of texts and what is counted in them, each count made when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.rows = len(texts)

    def _per_text(self, mask_by_byte: np.ndarray) -> np.ndarray:
        w = self.words
        sums = np.zeros(len(w.data) + 1, dtype=np.int64)
        np.cumsum(mask_by_byte[w.data], out=sums[1:])
        return np.diff(sums[w.offsets])

    @cached_property
    def words(self) -> Words:
        return Words(self.texts, NON_BLANK, lower=False)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.words.hashes()

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.words.counts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._per_text(_IN_WORD_START)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL)

    @cached_property
    def n_capitals(self) -> np.ndarray:
        return self._per_text(_CAPITAL)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that hold a word: how many, and how many equal an earlier one."""
        lines = Words(self.texts, _NOT_NEWLINE, lower=False)
        solid = np.zeros(len(lines.data) + 1, dtype=np.int64)
        np.cumsum(NON_BLANK[lines.data], out=solid[1:])
        real = solid[lines.ends] > solid[lines.starts]
        owner = np.repeat(np.arange(self.rows), lines.counts)[real]
        total = np.bincount(owner, minlength=self.rows)
        _, first = np.unique(_within(lines.hashes()[real], owner), return_index=True)
        return total, total - np.bincount(owner[first], minlength=self.rows)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside runs of RUN words that occur twice or more in the text."""
        runs = shingles(self.hashes, RUN)
        whole = np.flatnonzero(np.arange(len(runs)) + RUN <= self.words.doc_end()[: len(runs)])
        _, same, times = np.unique(
            _within(runs[whole], self.text_of_word[whole]), return_inverse=True, return_counts=True
        )
        again = whole[times[same] > 1]
        step = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + RUN, -1)
        return np.bincount(self.text_of_word[np.cumsum(step[:-1]) > 0], minlength=self.rows)

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words equal to the word before."""
        h, owner = self.hashes, self.text_of_word
        same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        return np.bincount(owner[same], minlength=self.rows)


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one text."""
    return mix(hashes + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = [
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_runs", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("word_length", lambda t: (10 * t.word_chars < 25 * t.n_words) | (10 * t.word_chars > 150 * t.n_words)),
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * t.n_lines),
    Rule("capitals", lambda t: 100 * t.n_capitals > 30 * t.word_chars),
    Rule("stutter", lambda t: 100 * t.n_stutter > 20 * t.n_words),
]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(docs: DataFrame, text_col: str = "text", rules=None, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second of a sample of texts, ties in the given order.

    Rejections are those of texts that no rule before has rejected. Cutting texts into words
    is common to all rules and charged to none. The sample decides the order alone: its rows
    are drawn from as many partitions as it takes.
    """
    rules = RULES if rules is None else rules
    drawn = docs.select(docs[text_col].alias("text")).where(F.rand(20240601) < SAMPLE_SHARE)
    texts = pa.array([r["text"] for r in drawn.take(sample_rows)], pa.string())
    told = []
    for rule in rules:
        own = Texts(texts)
        _ = own.words, own.rows
        start = time.perf_counter()
        rejected = rule.rejects(own)
        told.append((rule, rejected, max(time.perf_counter() - start, 1e-9)))
    ordered, left = [], np.ones(len(texts), dtype=bool)
    while told:
        rate = [(np.count_nonzero(r & left) / cost, np.count_nonzero(r) / cost) for _, r, cost in told]
        best = max(range(len(told)), key=lambda i: (*rate[i], -i))
        rule, rejected, _ = told.pop(best)
        ordered.append(rule)
        left &= ~rejected
    return ordered


def good(texts: pa.Array, ordered: list[Rule], counted: Texts | None = None) -> np.ndarray:
    """Which texts no rule rejects.

    Rules after the first see only texts that are left, once half of them are gone.
    ``counted`` are the texts where all are counted anyway, so that nothing is done twice.
    """
    kept, rows, now = np.ones(len(texts), dtype=bool), np.arange(len(texts)), counted or Texts(texts)
    for rule in ordered:
        kept[rows[rule.rejects(now)]] = False
        alive = kept[rows]
        if not alive.any():
            break
        if counted is None and 2 * np.count_nonzero(alive) < len(rows):
            now, rows = Texts(now.texts.filter(pa.array(alive))), rows[alive]
    return kept


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """(doc_id, the counts of BASE, kept), a row for each input row."""
    ship_package(docs.sparkSession)
    ordered = order_rules(docs, text_col, rules)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                counted = Texts(texts)
                kept = good(texts, ordered, counted)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(getattr(counted, c), pa.int64()) for c in BASE],
                     pa.array(kept)],
                    ["doc_id", *BASE, "kept"],
                )

    narrow = plain(docs, doc_id=id_col, text=text_col)
    counts = ", ".join(f"{c} long" for c in BASE)
    return narrow.mapInArrow(scan, f"doc_id {dict(narrow.dtypes)['doc_id']}, {counts}, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """The rows, all columns, that no rule rejects.

    A null or empty text has no words and is rejected by the rule of few words; rows that
    repeat are judged each.
    """
    ship_package(docs.sparkSession)
    ordered = order_rules(docs, text_col, rules)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(good(part.column(text_col), ordered)))

    return docs.mapInArrow(scan, docs.schema)
