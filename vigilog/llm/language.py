"""Language identification: sparse multinomial logistic regression on character n-grams.

Features. A text is lower-cased and cut into words (letters a-z and everything beyond
ASCII); a word with a blank on both sides gives its runs of 1 to 4 characters that hold one
of the blanks at most. An n-gram is a bucket of 2**BITS by hash. Its value is its share of the text's n-grams, in percent, times
its inverse document frequency: ln((1 + N) / (1 + documents with it)) + 1.

Learning, from texts with a language whose crc32(id as text) modulo FOLDS is not HELD_OUT:

* Document frequencies come from all of them, whole: each task counts buckets, counts are
  added by bucket, the driver gets 2**BITS numbers.
* Weights are fitted on a bounded sample, ``SAMPLE`` rows in expectation, shared evenly by
  the languages and drawn by a hash of id and text; sampled texts are read whole. One task
  learns from the sample: follow-the-regularised-leader with a learning rate for each weight,
  an L1 penalty (weights that explain little are zero) and an L2 penalty.
* A fifth of the sample is kept from learning and sets the temperature that the scores are
  divided by before they become probabilities (least negative log likelihood).

The model has 2**BITS x languages numbers, so its size follows the number of different
languages and never the rows. Prediction is a sum of weights over a text's words, row by row.

A text that is null or has no letter is ``und`` with score 0. Without any row to learn from
every text is ``und`` with score 0. Rows that repeat are judged each; a tie goes to the
language that is first in order. A null id counts as the empty text, so it is held out. An
empty table gives no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import plain
from vigilog.llm.sums import PARTIAL, added, partial_sums
from vigilog.llm.words import Words, mix, slices
from vigilog.session import ship_package

FOLDS, HELD_OUT = 5, 0
SAMPLE = 4096  # rows to fit the weights on, all languages together
BITS = 16
LONGEST = 4  # characters of an n-gram
UNKNOWN = "und"
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
CALIBRATION = 5  # one sampled row in so many sets the temperature

LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True
_SPACE = 32
_AT_ONCE = 1 << 18  # words whose n-grams are spread out at once


class Grams:
    """The n-grams of a slice of texts: computed once for each different word."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.utf8_lower(texts), LETTERS, lower=False)
        self.rows = len(words.counts)
        self.first = words.first
        self.text = np.repeat(np.arange(self.rows), words.counts)
        _, index, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.owner, self.bucket = _ngrams(words, index)
        #: n-grams of different word w: bucket[start[w]:start[w + 1]]
        self.start = np.searchsorted(self.owner, np.arange(len(index) + 1))

    @property
    def total(self) -> np.ndarray:
        """N-grams of each text."""
        return self.summed(np.diff(self.start).astype(np.float64))

    def summed(self, by_word: np.ndarray) -> np.ndarray:
        """Sums over each text's words of a value that different words have."""
        return np.bincount(self.text, weights=by_word[self.word], minlength=self.rows)

    def spread(self, low: int, high: int):
        """(text, bucket) of all n-grams of the texts ``low`` to ``high``, in pieces."""
        for begin in range(int(self.first[low]), int(self.first[high]), _AT_ONCE):
            end = min(begin + _AT_ONCE, int(self.first[high]))
            word = self.word[begin:end]
            many = self.start[word + 1] - self.start[word]
            shift = np.repeat(self.start[word] - np.cumsum(many) + many, many)
            yield np.repeat(self.text[begin:end], many), self.bucket[np.arange(len(shift)) + shift]


def _ngrams(words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the words, bucket) of every n-gram of the words ``index``, in their order."""
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = words.data.tobytes()
    told = " ".join(data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[index], words.ends[index]))
    chars = np.frombuffer(f" {told} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = chars == _SPACE
    word_at = np.cumsum(blank) - 1  # a blank belongs to the word behind it
    owners, buckets = [], []
    mixed = mix(chars.astype(np.uint64) + np.uint64(1))
    for size in range(1, LONGEST + 1):
        n = len(chars) - size + 1
        if n <= 0:
            break
        inner = np.zeros(n, dtype=bool)
        for k in range(1, size - 1):
            inner |= blank[k : k + n]
        good = np.flatnonzero(~(inner | (blank[:n] if size == 1 else blank[:n] & blank[size - 1 :])))
        h = np.full(len(good), size, dtype=np.uint64)
        for k in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + mixed[good + k])
        owners.append(word_at[good])
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


# --- counts over all texts ---------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


_BLOCK = 1024  # buckets in a row of partial counts


def document_counts(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket stands."""
    size = 1 << BITS

    def count(batches):
        total = np.zeros(size)
        some = 64
        seen = np.zeros((some, size), dtype=bool)
        for batch in batches:
            for part in slices(batch):
                grams = Grams(part.column("text"))
                for low in range(0, grams.rows, some):
                    high = min(low + some, grams.rows)
                    seen[: high - low] = False
                    for text, bucket in grams.spread(low, high):
                        seen[text - low, bucket] = True
                    total += seen[: high - low].sum(axis=0)
        yield partial_sums(total.reshape(-1, _BLOCK))

    found = added(texts.select("text").mapInArrow(count, PARTIAL))
    return found.ravel() if len(found) else np.zeros(size)


# --- learning ----------------------------------------------------------------------------


def _sampled(learn: DataFrame, counts: dict[str, int], sample_rows: int) -> DataFrame:
    """(label, draw, text): rows of each language, the same number of each in expectation."""
    names = sorted(counts)
    share = sample_rows / len(names)
    rate = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, share / counts[n]))])
    label = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    drawn = learn.withColumn("draw", F.xxhash64(F.lit(20240601), "doc_id", "text"))
    part = (F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))).cast("double")
    return drawn.where(part < rate[F.col("lang")]).select(label[F.col("lang")].alias("label"), "draw", "text")


def _counted(sample: DataFrame) -> DataFrame:
    """(label, draw, buckets, times, total) of each sampled text."""

    def count(batches):
        size = 1 << BITS
        for batch in batches:
            for part in slices(batch):
                grams = Grams(part.column("text"))
                buckets, times = [], []
                for row in range(grams.rows):
                    held = np.zeros(size, dtype=np.int64)
                    for _, bucket in grams.spread(row, row + 1):
                        held += np.bincount(bucket, minlength=size)
                    at = np.flatnonzero(held)
                    buckets.append(at.astype(np.int32))
                    times.append(held[at].astype(np.float32))
                ends = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x)))
                    for x in (buckets, times)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("draw"), *lists, pa.array(grams.total)],
                    ["label", "draw", "buckets", "times", "total"],
                )

    return sample.mapInArrow(count, "label int, draw bigint, buckets array<int>, times array<float>, total double")


class Ftrl:
    """Follow the regularised leader, for a weight of each (bucket, class); the last row is the bias."""

    def __init__(self, classes: int, size: int = (1 << BITS) + 1):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        """Closed form: zero up to the L1 penalty, shrunk by the L2 penalty beyond."""
        z = self.z[at]
        pull = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -pull / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax((x @ w)[None])[0]
        error[label] -= 1
        g = np.outer(x, error)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood (golden section)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, part = -3.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    """Languages in order, what a percent of each bucket adds to each, and the temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray  # (2**BITS, languages), times the inverse document frequency
    bias: np.ndarray
    temperature: float


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE,
) -> Model | None:
    """A model of the languages of ``docs``; None where no row may be learnt from."""
    ship_package(docs.sparkSession)
    narrow = plain(docs, doc_id=id_col, text=text_col, lang=lang_col)
    learn = narrow.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not counts:
        return None
    names = tuple(sorted(counts))
    frequency = document_counts(learn)
    idf = np.log((1 + sum(counts.values())) / (1 + frequency)) + 1
    bias_row = 1 << BITS

    def train(batches):
        kept = []
        for batch in batches:
            lists = batch.column("buckets"), batch.column("times")
            for i in range(batch.num_rows):
                at, times = (c[i].values.to_numpy() for c in lists)
                x = np.append(100 * times / batch.column("total")[i].as_py() * idf[at], 1.0)
                kept.append((np.append(at, bias_row), x, batch.column("label")[i].as_py(), batch.column("draw")[i].as_py()))
        judged = [k for k in kept if k[3] % CALIBRATION == 0]
        learnt = [k for k in kept if k[3] % CALIBRATION] or kept
        model = Ftrl(len(names))
        for _ in range(EPOCHS):
            for at, x, label, _ in learnt:
                model.learn(at, x, label)
        weights = model.weights()
        logits = np.array([x @ weights[at] for at, x, *_ in judged]).reshape(len(judged), len(names))
        heat = temperature(logits, np.array([k[2] for k in judged], dtype=np.int64))
        some = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*some.tolist(), bias_row + 1], pa.int64()),
                pa.array([*weights[some].tolist(), [heat]], pa.list_(pa.float64())),
            ],
            ["row", "v"],
        )

    sample = _counted(_sampled(learn, counts, sample_rows))
    # The sample is bounded, so one task may hold it; the order is drawn and always the same.
    rows = sample.repartition(1).sortWithinPartitions("draw", "label").mapInArrow(train, "row bigint, v array<double>").collect()
    weights, heat = np.zeros((bias_row + 1, len(names))), 1.0
    for r in rows:
        if r["row"] > bias_row:
            heat = r["v"][0]
        else:
            weights[r["row"]] = r["v"]
    return Model(names, weights[:-1] * idf[:, None], weights[-1], heat)


def predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of the likeliest language, its probability) of each text; -1 without n-grams."""
    grams = Grams(texts)
    total = grams.total
    logits = np.empty((grams.rows, len(model.languages)))
    for c in range(len(model.languages)):
        by_word = np.bincount(grams.owner, weights=model.weights[grams.bucket, c], minlength=len(grams.start) - 1)
        logits[:, c] = 100 * grams.summed(by_word) / np.maximum(total, 1) + model.bias[c]
    best = logits.argmax(axis=1) if len(logits) else np.zeros(0, np.int64)
    score = softmax(logits / model.temperature).max(axis=1) if len(logits) else np.zeros(0)
    return np.where(total > 0, best, -1), np.where(total > 0, score, 0.0)


def languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each input row."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows)
    narrow = plain(docs, doc_id=id_col, text=text_col)
    lettered = F.col("text").rlike(r"\p{L}")
    told = narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(lettered, F.col("text")).alias("text"))
    if model is None:
        return told.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = pa.array([*model.languages, UNKNOWN])

    def judge(batches):
        for batch in batches:
            for part in slices(batch):
                best, score = predict(part.column("text"), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), names.take(pa.array(best % len(names))), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = dict(narrow.dtypes)["doc_id"]
    return told.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
