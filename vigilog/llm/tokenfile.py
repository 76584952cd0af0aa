"""Token ids of all documents in Arrow stream files of equal-length sequences.

Documents are ordered by id (null ids first, then by text), encoded, closed with an end
id, and put end to end. Each range of ids becomes one file

    part-000012.arrow       ids: fixed_size_list<uint16 or uint32>[length],
                            mask: fixed_size_list<uint8>[length]; a batch holds ``batch``
                            sequences; the file's last sequence is padded, mask 0
    part-000012.docs.arrow  doc_id, start, n_tokens: where each document lies in the file

Every batch but the last is of the same size, so a mapped file gives any sequence and its
mask without a copy (``sequence``). A task writes under a name of its own and renames the
file when it is whole; a task that runs again writes the same bytes.

Texts are split at ASCII blanks and each different word is encoded once by the tokenizer
library; the tokenizers meant here drop blanks and never join across them (others are
refused), so this is the encoding of the whole text; a test compares both. Words are told
apart by 64-bit hashes. Null and empty texts hold the end id
alone. Rows that repeat are written each. An empty table gives no files and no rows.
Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain
from vigilog.llm.words import LOWER, NON_BLANK, Words, slices
from vigilog.session import shared_dir

LENGTH = 1024  # ids of a sequence
BATCH = 256  # sequences of a batch
END_ID = 1
CACHED_WORDS = 2_000_000  # pieces that a worker remembers before it begins anew
MARKS = ".,;:!?"
_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS.encode())] = True
_ASCII_ALNUM = np.zeros(256, dtype=bool)
_ASCII_ALNUM[48:58] = _ASCII_ALNUM[65:91] = _ASCII_ALNUM[97:123] = True
_SLICE = 8 << 20

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts, each different piece of a text encoded once and remembered.

    A piece is a word, or a word's core and the marks after it where the tokenizer cuts
    there itself; where it lowers case, ASCII words are lowered first, so ``The`` and
    ``the,`` are not encoded anew. Pieces are known by 64-bit hash, in arrays: sorted keys,
    where their ids begin in a pool, and how many they are.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lowers = self._ids(["aQ Z9"]) == self._ids(["aq z9"])
        self.cuts = all(self._ids([f"ab{m}"]) == self._ids(["ab", m]) for m in ("?!", *MARKS))
        if self._ids(["ab c"]) != self._ids(["ab", "c"]):
            raise ValueError("the tokenizer joins words across blanks")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[int]:
        return [i for e in self.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]

    def _pieces(self, words: Words) -> np.ndarray:
        """Cut the words into pieces, in place; the pieces before each text, and all."""
        data, starts, ends = words.data, words.starts, words.ends
        if self.lowers:
            # A special token's text, which begins with <, is not lower-cased.
            odd = np.concatenate([[0], np.cumsum((data >= 128) | (data == 60))])
            plain_word = odd[ends] == odd[starts]
            edge = np.zeros(len(data) + 1, dtype=np.int8)
            edge[starts[plain_word]] += 1
            edge[ends[plain_word]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            data = np.where(inside, LOWER[data], data)
        cut = ends.copy()
        if self.cuts:
            at = np.flatnonzero(_MARK[data[ends - 1]]) if len(ends) else ends
            while len(at):
                cut[at] -= 1
                at = at[cut[at] > starts[at]]
                at = at[_MARK[data[cut[at] - 1]]]
            cut = np.where((cut > starts) & _ASCII_ALNUM[data[np.maximum(cut, 1) - 1]], cut, ends)
        tailed = cut < ends
        place = np.concatenate([[0], np.cumsum(1 + tailed)])
        begin, end = np.empty(place[-1], np.int64), np.empty(place[-1], np.int64)
        begin[place[:-1]], end[place[:-1]] = starts, cut
        begin[place[:-1][tailed] + 1], end[place[:-1][tailed] + 1] = cut[tailed], ends[tailed]
        words.data, words.starts, words.ends = data, begin, end
        return place[words.first]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces and remember them."""
        coded = []
        for at in range(0, len(pieces), 10_000):
            told = [p.decode("utf-8", "replace") for p in pieces[at : at + 10_000]]
            coded += [e.ids for e in self.tokenizer.encode_batch_fast(told, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = len(self.pool) + np.cumsum(size) - size
        new = np.fromiter((i for ids in coded for i in ids), self.dtype, int(size.sum()))
        self.pool = np.concatenate([self.pool, new])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed with ``end_id``, and how many each text has."""
        words = Words(texts, NON_BLANK, lower=False)
        first = self._pieces(words)
        unique, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self._forget()
        if len(unique):
            at = np.searchsorted(self.keys, unique)
            found = np.zeros(len(unique), dtype=bool)
            if len(self.keys):
                found = self.keys[np.minimum(at, len(self.keys) - 1)] == unique
            if not found.all():
                new = index[~found]
                data, spans = words.data, zip(words.starts[new].tolist(), words.ends[new].tolist())
                self._learn(unique[~found], [data[a:b].tobytes() for a, b in spans])
                at = np.searchsorted(self.keys, unique)
            at = at[inverse]
            size, begin = self.size[at], self.begin[at]
        else:
            size = begin = np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        sizes = np.diff(sums[first]) + 1
        ids = np.full(int(sizes.sum()), end_id, dtype=self.dtype)
        body = np.ones(len(ids), dtype=bool)
        body[np.cumsum(sizes) - 1] = False
        ids[body] = self.pool[np.repeat(begin - sums[:-1], size) + np.arange(sums[-1])]
        return ids, sizes


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.uint8(), length))],
        {b"length": str(length).encode()},
    )


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them in batches of a fixed size."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.schema, self.dtype, self.length, self.batch = _schema(dtype, length), dtype, length, batch
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[bytes] = []
        self.held_bytes = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        full = self.length * self.batch * self.dtype.itemsize
        if self.held_bytes >= full:
            data = b"".join(self.held)
            stop = len(data) // full * full
            for at in range(0, stop, full):
                self._put(np.frombuffer(data, self.dtype, self.length * self.batch, at))
            self.held, self.held_bytes = [data[stop:]], len(data) - stop

    def _put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        mask = (np.arange(rows * self.length) < len(ids)).view(np.uint8)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held_bytes:
            self._put(np.frombuffer(b"".join(self.held), self.dtype))
        self.out.close()


def write_files(
    docs: DataFrame, folder: str, vocabulary: str, *, id_col="doc_id", text_col="text", length=LENGTH,
    batch=BATCH, end_id=END_ID,
) -> DataFrame:
    """Write the files into ``folder``; (piece, start, n_docs, n_tokens) for each, start over all files."""

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        coder, own = encoder(vocabulary), f"{root}/_{uuid.uuid4().hex}"
        data = index = None
        at = n_docs = 0
        for incoming in batches:
            for part in slices(incoming, size=_SLICE):
                if data is None:
                    files = [fs.open_output_stream(f"{own}.arrow"), fs.open_output_stream(f"{own}.docs.arrow")]
                    data = SequenceWriter(files[0], coder.dtype, length, batch)
                    fields = [("doc_id", part.column("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())]
                    index = pa.ipc.new_stream(files[1], pa.schema(fields))
                ids, sizes = coder.encode(part.column("text"), end_id)
                data.add(ids.tobytes())
                columns = [part.column("doc_id"), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes)]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=index_schema(columns)))
                at += int(sizes.sum())
                n_docs += part.num_rows
        if data is None:
            return
        data.close()
        index.close()
        for f in files:
            f.close()
        piece = task.partitionId()
        for end in (".docs.arrow", ".arrow"):
            fs.move(own + end, f"{root}/{file_name(piece)}{end}")
        yield pa.RecordBatch.from_pydict({"piece": [piece], "n_docs": [n_docs], "n_tokens": [at]})

    def index_schema(columns):
        return pa.schema([(n, c.type) for n, c in zip(("doc_id", "start", "n_tokens"), columns)])

    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = plain(docs, doc_id=id_col, text=text_col).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    files = keep(ordered.mapInArrow(write, "piece long, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return files.select("piece", start.alias("start"), "n_docs", "n_tokens")


def file_name(piece: int) -> str:
    return f"part-{piece:06d}"


def open_stream(fs, path: str) -> pa.RecordBatchReader:
    """A reader that maps local files and so copies nothing."""
    local = isinstance(fs, pa.fs.LocalFileSystem)
    return pa.ipc.open_stream(pa.memory_map(path) if local else fs.open_input_file(path))


def sequence(folder: str, piece: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of a file and its mask (1 for an id, 0 for padding).

    All batches but the last take the same bytes, so the place of the sequence's batch is
    computed and no other batch but the first is read. Of a local file both are views.
    """
    fs, root = pa.fs.FileSystem.from_uri(folder)
    path = f"{root}/{file_name(piece)}.arrow"
    source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
    schema = pa.ipc.read_schema(source)
    head = source.tell()
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    if number >= batch.num_rows:
        whole, width = batch.num_rows, source.tell() - head
        place = head + number // whole * width
        if place + 8 >= source.size():  # a stream ends with a mark of eight bytes
            raise IndexError(number)
        source.seek(place)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        number %= whole
    if not 0 <= number < batch.num_rows:
        raise IndexError(number)
    length = schema.field("ids").type.list_size
    at = slice(number * length, (number + 1) * length)
    return tuple(batch.column(c).values.to_numpy()[at] for c in ("ids", "mask"))


def read_documents(files: DataFrame, folder: str, id_type: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    n_files = max(1, files.count())

    def read(batches):
        for incoming in batches:
            for piece, start in zip(incoming.column("piece").to_pylist(), incoming.column("start").to_pylist()):
                yield from _documents(folder, piece, start)

    pieces = files.select("piece", "start").repartition(n_files, "piece")
    return pieces.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _flat(fs, path: str):
    for batch in open_stream(fs, path):
        ids = batch.column("ids").flatten().to_numpy()
        yield ids[: int(batch.column("mask").flatten().to_numpy().sum(dtype=np.int64))]  # only the end is padded


def _documents(folder: str, piece: int, start: int):
    fs, root = pa.fs.FileSystem.from_uri(folder)
    runs = _flat(fs, f"{root}/{file_name(piece)}.arrow")
    run, at = np.zeros(0, np.uint32), 0
    for batch in open_stream(fs, f"{root}/{file_name(piece)}.docs.arrow"):
        sums = []
        for size in batch.column("n_tokens").to_pylist():
            crc = 0
            while size:
                if at == len(run):
                    run, at = next(runs).astype("<u4"), 0
                step = min(size, len(run) - at)
                crc = zlib.crc32(run[at : at + step], crc)
                at, size = at + step, size - step
            sums.append(crc)
        starts = pc.add(batch.column("start"), start)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), starts, batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def written_documents(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to token files and give what the files hold of each document.

    ``folder`` is a path of the shared storage; a fresh one in the session's shared folder
    if not given.
    """
    folder = folder or shared_dir(docs.sparkSession, "llm-tokens")
    files = write_files(docs, folder, vocabulary, **options)
    id_col = options.get("id_col", "doc_id")
    return read_documents(files, folder, dict(docs.dtypes)[id_col])
