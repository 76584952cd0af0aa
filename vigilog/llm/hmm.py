"""A hidden Markov language model over word buckets.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z, then one
end. A latent state emits a bucket (a word's hash modulo ``BUCKETS``; the end has its own),
and the bucket emits the word by its share of the bucket's training tokens. So the
parameters the states need have a fixed size, and every word keeps its own probability:

    P(text) = sum over state paths of start * transitions * P(bucket | state)
              * product of (c + 1) / (C_b + V_b + 1)

with c the word's training count, C_b and V_b the tokens and different words of its bucket,
the last 1 for a word never seen.

* Texts are encoded once, in chunks: local word numbers, written to the shared folder.
* Word counts meet by word, one row for each chunk and different word, and go back to the
  chunks; no vocabulary is held by a task or the driver.
* Training (Baum-Welch): each task sums expected counts over its chunks, Spark sums them by
  bucket, the driver gets BUCKETS x STATES numbers. All training texts take part in every
  round, whole, in pieces of PIECE tokens so that long texts do not serialise a task.
* Scoring is the scaled forward recursion over the whole text. The pieces of a long text
  are run from every state side by side and joined, which is exact.

The first states come from the corpus: texts with the same most frequent bucket share one.

Training texts are those whose crc32(id as text) modulo ``FOLDS`` is not ``HELD_OUT``; a
null id counts as the empty text. A null text is empty: one end token. Rows that repeat are
scored each. An empty table gives no rows. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain
from vigilog.llm.words import NON_BLANK, Words, slices

STATES = 8
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS  # the end is bucket BUCKETS
ROUNDS = 3
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 8 << 20
PIECE = 1024
PRIOR = 1000.0  # pseudo tokens of the whole corpus in each state's emissions
_AT_ONCE = 150_000  # tokens of pieces handled together


def held_out(doc_id) -> bool:
    told = "" if doc_id is None else str(doc_id)
    return zlib.crc32(told.encode()) % FOLDS == HELD_OUT


def encode(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text): ids, sizes, local word numbers and what the words are."""

    def scan(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                yield _chunk(part, number)
                number += 1

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        scan,
        f"chunk long, doc_ids array<{id_type}>, held array<boolean>, sizes array<long>, top array<int>, "
        "tokens binary, n_tokens long, buckets binary, words array<string>, trained array<long>, "
        "word_buckets array<int>",
    )


def _chunk(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
    words = Words(part.column("text"), NON_BLANK)
    unique, first, local, counts = np.unique(
        words.hashes(), return_index=True, return_inverse=True, return_counts=True
    )
    order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    local, first, unique = rank[local], first[order], unique[order]
    buckets = (unique >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    held = np.array([held_out(i) for i in part.column("doc_id").to_pylist()], dtype=bool)
    sizes = words.counts
    trained = np.bincount(local[np.repeat(~held, sizes)], minlength=len(unique))
    top = [
        int(np.bincount(buckets[local[a:b]]).argmax()) if b > a else BUCKETS
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())
    ]
    told = [words.data[a:b].tobytes() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    ids = part.column("doc_id")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([held.tolist()], pa.list_(pa.bool_())),
            pa.array([sizes.tolist()], pa.list_(pa.int64())),
            pa.array([top], pa.list_(pa.int32())),
            pa.array([pa.compress(local.tobytes(), "zstd", asbytes=True)], pa.binary()),
            pa.array([len(local)], pa.int64()),
            pa.array([buckets.tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), pa.array(told, pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), pa.array(trained, pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), pa.array(buckets.astype(np.int32))),
        ],
        ["chunk", "doc_ids", "held", "sizes", "top", "tokens", "n_tokens", "buckets", "words", "trained", "word_buckets"],
    )


class Chunk:
    """A chunk's documents as runs of token buckets, each closed by the end's bucket."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64) + 1
        self.held = np.array(row["held"], dtype=bool)
        self.top = np.array(row["top"], np.int64)
        raw = pa.decompress(row["tokens"], decompressed_size=4 * row["n_tokens"], codec="zstd")
        self.local = np.frombuffer(raw, np.uint32)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.is_word = np.ones(int(self.sizes.sum()), dtype=bool)
        self.is_word[self.ends - 1] = False
        of_word = np.frombuffer(row["buckets"], np.uint16)
        self.buckets = np.full(len(self.is_word), BUCKETS, np.int64)
        self.buckets[self.is_word] = of_word[self.local]

    def pieces(self, docs: np.ndarray):
        """Begin, length, document, whether first, of the pieces of the documents."""
        n = -(-self.sizes[docs] // PIECE)
        doc = np.repeat(docs, n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = self.begins[doc] + number * PIECE
        return begin, np.minimum(PIECE, self.ends[doc] - begin), doc, number == 0


class Model:
    """Start, transition and emission probabilities; ``usual`` starts a later piece."""

    def __init__(self, start, move, emit, usual):
        self.start, self.move, self.emit, self.usual = start, move, emit, usual


def forward(model: Model, buckets, begin, length, before, keep_steps: bool = False):
    """Scaled forward recursion of many runs at once, longest first.

    ``before`` holds each run's state weights ahead of its first token. Returns the last
    weights (summing to 1), log of the scale, and if asked for the weights, scales, buckets
    and emissions of every step.
    """
    alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    log_scale = np.zeros(len(begin))
    now, last, steps = before, np.array(before), []
    for t, n in enumerate(alive.tolist()):
        at = buckets[begin[:n] + t]
        emit = model.emit[at]
        fresh = (now[:n] if t == 0 else now[:n] @ model.move) * emit
        scale = fresh.sum(1)
        fresh /= scale[:, None]
        log_scale[:n] += np.log(scale)
        go_on = alive[t + 1] if t + 1 < len(alive) else 0
        last[go_on:n] = fresh[go_on:]
        now = fresh
        if keep_steps:
            steps.append((fresh, scale, at, emit))
    return last, log_scale, steps


def expected_counts(model: Model, chunk: Chunk, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray):
    """Add the expected counts of the chunk's training texts (one Baum-Welch round)."""
    begin, length, _, first = chunk.pieces(np.flatnonzero(~chunk.held))
    order = np.argsort(-length, kind="stable")
    begin, length, first = begin[order], length[order], first[order]
    group = np.cumsum(length) // _AT_ONCE
    for g in np.unique(group):
        own = group == g
        b, size, head = begin[own], length[own], first[own]
        before = np.where(head[:, None], model.start, model.usual)
        _, _, steps = forward(model, chunk.buckets, b, size, before, keep_steps=True)
        behind, told, weights = None, [], []
        for t in range(len(steps) - 1, -1, -1):
            alpha, scale, at, emit = steps[t]
            n = len(alpha)
            beta = np.ones((n, model.move.shape[0]))
            if behind is not None:
                m = len(behind)
                beta[:m] = behind @ model.move.T
                moves += alpha[:m].T @ behind
            gamma = alpha * beta
            told.append(at)
            weights.append(gamma)
            behind = emit * beta / scale[:, None]
            if t == 0:
                starts += gamma[head].sum(0)
        told, weights = np.concatenate(told), np.concatenate(weights).T.copy()
        for k in range(counts.shape[1]):
            counts[:, k] += np.bincount(told, weights[k], BUCKETS + 1)


def log_likelihood(model: Model, chunk: Chunk) -> np.ndarray:
    """Natural log probability of each document's buckets, exact for any length."""
    states = len(model.start)
    begin, length, doc, first = chunk.pieces(np.arange(len(chunk.sizes)))
    lanes = np.where(first, 1, states)
    piece = np.repeat(np.arange(len(begin)), lanes)
    state = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    before = np.where(first[piece][:, None], model.start[None, :], model.move[state])
    order = np.argsort(-length[piece], kind="stable")
    last, logs = np.empty((len(piece), states)), np.empty(len(piece))
    group = np.cumsum(length[piece][order]) // _AT_ONCE
    for g in np.unique(group):
        own = order[group == g]
        last[own], logs[own], _ = forward(model, chunk.buckets, begin[piece[own]], length[piece[own]], before[own])
    lane = np.cumsum(lanes) - lanes
    total = np.zeros(len(chunk.sizes))
    total[doc[first]] = logs[lane[first]]
    weights = last[lane[first]]  # one row a document, in order
    for p in np.flatnonzero(~first).tolist():
        d, a = doc[p], lane[p]
        high = logs[a : a + states].max()
        joined = (weights[d] * np.exp(logs[a : a + states] - high)) @ last[a : a + states]
        total[d] += high + np.log(joined.sum())
        weights[d] = joined / joined.sum()
    return total


def _from_counts(counts, moves, starts, whole) -> Model:
    """Probabilities from expected counts, with the corpus as prior of the emissions."""
    share = (whole + 1.0) / (whole.sum() + len(whole))
    used = counts.sum(0)
    emit = (counts + PRIOR * share[:, None]) / (used + PRIOR)
    move = (moves + 1.0) / (moves + 1.0).sum(1, keepdims=True)
    start = (starts + 1.0) / (starts + 1.0).sum()
    return Model(start, move, emit, (used + 1.0) / (used + 1.0).sum())


def _summed(chunks: DataFrame, add, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts that ``add`` makes of every chunk, summed: by bucket, by move, by start."""
    names = [f"s{k}" for k in range(states)]

    def scan(batches):
        sums = np.zeros((BUCKETS + 1 + states + 1, states))
        split = BUCKETS + 1, BUCKETS + 1 + states
        for batch in batches:
            for i in range(batch.num_rows):
                add(Chunk(batch.slice(i, 1).to_pylist()[0]), sums[: split[0]], sums[split[0] : split[1]], sums[split[1]])
        rows = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *[pa.array(sums[rows, k]) for k in range(states)]], ["row", *names]
        )

    schema = ", ".join(["row int", *[f"{n} double" for n in names]])
    used = chunks.select("sizes", "held", "top", "tokens", "n_tokens", "buckets")
    total = used.mapInArrow(scan, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((BUCKETS + 1 + states + 1, states))
    for row in total.collect():  # BUCKETS + STATES + 2 rows at most
        out[row["row"]] = row[1:]
    return out[: BUCKETS + 1], out[BUCKETS + 1 : -1], out[-1]


def train(chunks: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts, begun from texts grouped by their top bucket."""
    context = chunks.sparkSession.sparkContext
    tops = chunks.select(F.explode(F.arrays_zip("top", "held")).alias("x")).where("NOT x.held")
    common = tops.groupBy("x.top").count().orderBy(F.desc("count"), "top").collect()  # BUCKETS + 1 rows at most
    state_of = np.zeros(BUCKETS + 1, np.int64)
    for i, row in enumerate(common):
        state_of[row["top"]] = i % states
    given = context.broadcast(state_of)

    def begin(chunk, counts, moves, starts):
        doc_state = given.value[chunk.top]
        used = ~chunk.held
        np.add.at(starts, doc_state[used], 1)
        of_token = np.repeat(np.where(used, doc_state, -1), chunk.sizes)
        for k in range(counts.shape[1]):
            counts[:, k] += np.bincount(chunk.buckets[of_token == k], minlength=BUCKETS + 1)

    counts, moves, starts = _summed(chunks, begin, states)
    whole = counts.sum(1)
    stay = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = _from_counts(counts, stay * 1000, starts, whole)
    for _ in range(rounds):
        told = context.broadcast(model)
        sums = _summed(chunks, lambda c, n, m, s, told=told: expected_counts(told.value, c, n, m, s), states)
        told.unpersist()
        # Moves were summed without the transition probability, the same for every term.
        model = _from_counts(sums[0], sums[1] * model.move, sums[2], whole)
    return model


def count_words(chunks: DataFrame) -> DataFrame:
    """(chunk, local, bucket, c, owner): each chunk's words with their training counts.

    ``owner`` marks one row of each word, so that words can be counted.
    """
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "trained", "word_buckets")).alias("local", "w"))
    dealt = words.select(
        "chunk", "local", F.col("w.words").alias("word"), F.col("w.trained").alias("n"),
        F.col("w.word_buckets").alias("bucket"),
    ).repartition("word")
    counts = dealt.groupBy("word").agg(F.sum("n").alias("c"), F.min("chunk").alias("one"))
    return dealt.join(counts, "word").select(
        "chunk", "local", "bucket", "c", (F.col("chunk") == F.col("one")).alias("owner")
    )


def language_model_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    ``base_score`` is the add-one unigram score, ``score`` the model's, both log10 of the
    whole text with its end.
    """
    narrow = plain(docs, doc_id=id_col, text=text_col)
    chunks = keep(encode(narrow), "lm-chunks")
    placed = keep(count_words(chunks), "lm-words")
    owned = placed.where("owner").groupBy("bucket").agg(
        F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")
    )
    in_bucket, different = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in owned.collect():  # BUCKETS rows at most
        in_bucket[row["bucket"]], different[row["bucket"]] = row["c"], row["v"]
    n_docs = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    train_tokens = int(in_bucket.sum()) + n_docs
    vocabulary = int(different.sum()) + (n_docs > 0)

    model = train(chunks, states, rounds)
    told = docs.sparkSession.sparkContext.broadcast((model, in_bucket, different))
    spread = np.log10(train_tokens + vocabulary + 1)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield _scored(row, told.value, n_docs, spread, train_tokens)

    counts = placed.groupBy("chunk").agg(F.collect_list(F.struct("local", "c")).alias("counts"))
    parts = chunks.select("chunk", "doc_ids", "held", "sizes", "top", "tokens", "n_tokens", "buckets")
    return parts.join(counts, "chunk", "left").mapInArrow(
        score,
        f"doc_id {dict(narrow.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double",
    )


def _scored(row: pa.RecordBatch, told, n_docs: int, spread: float, train_tokens: int) -> pa.RecordBatch:
    model, in_bucket, different = told
    counts = row.column("counts")[0].values
    columns = ["sizes", "held", "top", "tokens", "n_tokens", "buckets"]
    chunk = Chunk(row.select(columns).to_pylist()[0])
    c = np.zeros(len(counts) if counts is not None else 0)
    if counts is not None:
        c[counts.field("local").to_numpy()] = counts.field("c").to_numpy()
    each = np.full(len(chunk.is_word), float(n_docs))  # the end's count
    each[chunk.is_word] = c[chunk.local]
    base = np.log10(each + 1) - spread
    inside = np.zeros(len(each))
    b = chunk.buckets[chunk.is_word]
    inside[chunk.is_word] = np.log10((each[chunk.is_word] + 1) / (in_bucket[b] + different[b] + 1))
    n = len(chunk.sizes)

    def per_text(x):
        return np.add.reduceat(x, chunk.begins) if n else np.zeros(0)

    score = log_likelihood(model, chunk) / np.log(10) + per_text(inside)
    ids = row.column("doc_ids")[0].values
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(chunk.held), pa.array(chunk.sizes), pa.array(per_text((each > 0).astype(np.int64)), pa.int64()),
         pa.array(np.full(n, train_tokens)), pa.array(per_text(base)), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
