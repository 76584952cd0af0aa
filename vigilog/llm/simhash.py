"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles of four words
joined by a space (fewer words: the whole sequence), XXH64 with seed 42 of each, repeats
included; a bit is 1 if more than half of the hashes have it. A text without words, or
null, has fingerprint zero.

Linking fingerprints that differ in at most ``limit`` bits:

* Equal fingerprints are one from the start, so exact copies cost nothing.
* The 64 bits are cut into parts, correlated bits together. Part ``i`` gets a threshold
  ``t_i`` (-1: not looked at) with sum(t_i + 1) = limit + 1; two linked fingerprints differ
  in at most ``t_i`` bits of some part. Number of parts and thresholds come from dynamic
  programming over estimated probes and candidates; they change the cost, never the links.
* Each fingerprint stands at its own part values and probes those within ``t_i`` bits.
  Fingerprints that meet are compared whole. Meetings of many fingerprints are split into
  blocks, every pair of blocks compared, and of the links in a block pair only a spanning
  forest goes on: it connects the same fingerprints, without all pairs of a group.
* Connected components give the classes.

Rows that repeat, also under one id, take part each with its own text. Rows without an id
link like any other; a component of such rows alone has a null component_id. An empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.components import components
from vigilog.llm.moves import may_be_in, salted_join
from vigilog.llm.scratch import keep, plain

SHINGLE = 4
LIMIT = 4
BLOCK = 4096  # fingerprints of one meeting that are compared in one piece
PROBE_COST, PAIR_COST = 1.0, 0.05  # a moved probe row against one comparison


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp): the signed long that holds each row's 64 bits.

    ``row_key`` is the same for rows of the same id and text only.
    """
    narrow = plain(docs, doc_id=id_col, text=text_col).select("doc_id", row_key().alias("row_key"), "text")

    def scan(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            values = [
                _fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", xxh64_intdigest)
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(values, np.uint64).view(np.int64))],
                ["doc_id", "row_key", "fp"],
            )

    return narrow.mapInArrow(scan, f"doc_id {dict(narrow.dtypes)['doc_id']}, row_key string, fp long")


def row_key():
    """128 bits of ``doc_id`` and ``text``, nulls told from empty values."""
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.md5(F.col(c).cast("string"))))
             for c in ("doc_id", "text")]
    return F.md5(F.concat_ws("|", *parts))


def _fingerprint(text: bytes, digest) -> int:
    words = text.lower().split()  # on bytes: only A-Z, only ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    cuts = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(line[a:b], 42) for a, b in cuts], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * set_bits > len(hashes)).tolist()))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j set (64 x 64), over all of them."""

    def count(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            both += bits.T @ bits
            n += len(fp)
        if n:
            place = np.arange(64 * 64 + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), pa.array(np.append(both.ravel(), n).astype(np.int64))],
                ["place", "n"],
            )

    rows = distinct.select("fp").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    flat = np.zeros(64 * 64 + 1)
    for row in rows.collect():  # 4,097 rows
        flat[row["place"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size, correlated bits together."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    tie = np.abs(np.divide(share - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 1e-12))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, limit: int = LIMIT) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost for each fingerprint.

    The candidates of a part are estimated from how often each bit agrees in two random
    fingerprints. For each number of parts the thresholds come from dynamic programming.
    """
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best = None
    for parts in range(1, limit + 2):
        groups = group_bits(n, both, parts)
        costs = []  # by part, then by threshold + 1
        for group in groups:
            apart = np.array([1.0])  # chance of so many differing bits
            for b in group:
                apart = np.append(apart * agree[b], 0) + np.append(0, apart * (1 - agree[b]))
            cost, probes = [0.0], 0
            for t in range(limit + 1):
                probes += comb(len(group), t)
                cost.append(probes * PROBE_COST + n * apart[: t + 1].sum() * PAIR_COST)
            costs.append(cost)
        table = {0: (0.0, [])}  # steps used -> (cost, thresholds so far)
        for cost in costs:
            step: dict[int, tuple] = {}
            for used, (spent, chosen) in table.items():
                for more in range(limit + 2 - used):
                    option = (spent + cost[more], [*chosen, more - 1])
                    if used + more not in step or option < step[used + more]:
                        step[used + more] = option
            table = step
        found = (table[limit + 1][0], groups, table[limit + 1][1])
        best = min(best, found) if best else found
    return best[1], best[2]


def _part_value(bits: list[int]):
    """SQL value of the part: bits moved together."""
    value = F.lit(0).cast("long")
    for to, b in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), to))
    return value


def _flips(size: int, threshold: int) -> list[int]:
    """Values to xor for all probes at distance 1 to ``threshold``."""
    return [sum(1 << b for b in c) for d in range(1, threshold + 1) for c in combinations(range(size), d)]


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all that differ in ``limit`` bits at most."""
    n, both = bit_statistics(distinct)
    groups, thresholds = allocate(n, both, limit)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), _part_value(g).alias("value")) for i, g, _ in used])
    own = distinct.select("fp", F.explode(parts).alias("p")).select(
        "fp", "p.part", "p.value", F.lit(0).alias("side")
    )
    rows = own
    for i, group, t in used:
        if flips := _flips(len(group), t):
            value = F.explode(F.array(*[F.lit(x).cast("long") for x in flips]))
            rows = rows.unionAll(
                distinct.select("fp", _part_value(group).alias("v"), value.alias("x")).select(
                    "fp", F.lit(i).alias("part"), F.col("v").bitwiseXOR(F.col("x")).alias("value"),
                    F.lit(1).alias("side"),
                )
            )
    crowded = (
        rows.groupBy("part", "value")
        .agg(F.sum(F.lit(1) - F.col("side")).alias("own"), F.sum("side").alias("probing"))
        .where(f"own > {BLOCK} OR own > 0 AND probing > {BLOCK}")
        .select("part", "value", F.ceil(F.col("own") / BLOCK).cast("int").alias("na"),
                F.greatest(F.ceil(F.col("probing") / BLOCK), F.lit(0)).cast("int").alias("nb"))
    )
    block = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb"))).cast("int")
    unit = """
        CASE WHEN na IS NULL THEN array(named_struct('kind', 0, 'x', 0, 'y', 0, 'at', side))
        WHEN side = 0 THEN concat(
          transform(sequence(0, na - 1), o -> named_struct('kind', 1, 'x', least(o, block),
            'y', greatest(o, block), 'at', cast(block > o AS int))),
          CASE WHEN nb = 0 THEN array() ELSE transform(sequence(0, nb - 1),
            o -> named_struct('kind', 2, 'x', block, 'y', o, 'at', 0)) END)
        ELSE transform(sequence(0, na - 1), o -> named_struct('kind', 2, 'x', o, 'y', block, 'at', 1)) END"""
    units = (
        rows.join(crowded, ["part", "value"], "left")
        .withColumn("block", block)
        .select("part", "value", F.explode(F.expr(unit)).alias("u"), "fp")
        .select(F.xxhash64("part", "value", "u.kind", "u.x", "u.y").alias("unit"), "part", "value",
                "u.kind", "u.x", "u.y", "u.at", "fp")
    )
    dealt = units.repartition("unit").sortWithinPartitions("unit", "part", "value", "kind", "x", "y", "at")
    compare = dealt.select("unit", "part", "value", "kind", "x", "y", "at", "fp").mapInArrow(
        lambda batches: _compare(batches, limit), "a long, b long"
    )
    return compare


def _compare(batches, limit: int):
    """Links inside each unit; a unit's rows follow each other, but may span batches."""
    names = ("part", "value", "kind", "x", "y")
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "at", "fp")]
        if rest is not None:
            now = [np.concatenate(pair) for pair in zip(rest, now)]
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), dtype=bool)
        new[0] = True
        for c in now[:5]:
            new[1:] |= c[1:] != c[:-1]
        begins = np.flatnonzero(new)
        last = begins[-1]
        rest = [c[last:] for c in now]
        if last:
            yield _linked([c[:last] for c in now], begins[:-1], limit)
    if rest is not None:
        yield _linked(rest, np.zeros(1, np.int64), limit)


SMALL = 32


def _linked(cols, begins, limit) -> pa.RecordBatch:
    kind, at, fp = cols[2], cols[5], cols[6].view(np.uint64)
    ends = np.append(begins[1:], len(fp))
    sizes = ends - begins
    out_a, out_b = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if len(small):
        rows = np.repeat(begins[small], sizes[small]) + _counted(sizes[small])
        after = np.repeat(ends[small], sizes[small]) - rows - 1
        i = np.repeat(rows, after)
        j = i + 1 + _counted(after)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
        near &= (at[i] == 0) | (at[j] == 0)
        near &= fp[i] != fp[j]
        out_a.append(fp[i[near]])
        out_b.append(fp[j[near]])
    for g in np.flatnonzero(sizes > SMALL).tolist():
        one, side = fp[begins[g] : ends[g]], at[begins[g] : ends[g]]
        a, b = one[side == 0], one[side == 1]
        if kind[begins[g]] == 0 or not len(b):
            _forest(a, a, limit, out_a, out_b)
        if len(b):
            _forest(a, b, limit, out_a, out_b)
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.uint64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)


def _forest(a: np.ndarray, b: np.ndarray, limit: int, out_a: list, out_b: list) -> None:
    """Edges that connect what links from ``a`` to ``b`` connect, one at most for each member."""
    if not len(a) or not len(b):
        return
    strip = 256
    met = np.concatenate(
        [np.bitwise_count(a[s : s + strip, None] ^ b[None, :]) <= limit for s in range(0, len(a), strip)]
    )
    label_a = np.full(len(a), len(b), np.int32)
    label_b = np.arange(len(b), dtype=np.int32)
    rows, cols = met.any(1), met.any(0)
    while True:
        for s in range(0, len(a), strip):
            label_a[s : s + strip] = np.where(met[s : s + strip], label_b[None, :], len(b)).min(1)
        best = np.full(len(b), len(b), np.int32)
        for s in range(0, len(a), strip):
            best = np.minimum(best, np.where(met[s : s + strip], label_a[s : s + strip, None], len(b)).min(0))
        best = np.where(cols, np.minimum(best, label_b), label_b)
        if (best == label_b).all():
            break
        label_b = best
    for members, labels in ((a[rows], label_a[rows]), (b[cols], label_b[cols])):
        roots = b[labels]
        other = members != roots
        out_a.append(members[other])
        out_b.append(roots[other])


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id); ``root`` names a component, with or without ids."""
    prints = keep(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(keep(links(distinct.select("fp"), limit), "links").distinct())
    placed = keep(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "fingerprint-roots")
    linked = placed.where("root IS NOT NULL")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    several = salted_join(linked, lowest, "root", "fp").select("fp", "root", "component_id")
    alone = placed.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    return prints.join(several.unionByName(alone), "fp")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each input row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id that links
    of at most ``limit`` differing bits reach.
    """
    return classes(docs, id_col=id_col, text_col=text_col, limit=limit).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents, all columns, one row for each component: that of the smallest doc_id.

    A row without an id is taken only if none of its component has one; of rows that are
    equal in id and text one is taken. Null and empty texts have fingerprint zero. Only rows
    of components with several rows are moved.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    placed = keep(classes(docs, limit=limit).select("doc_id", "row_key", "root"), "simhash-rows")
    sizes = placed.groupBy("root").agg(F.min(order).alias("c"), F.count("*").alias("n"))
    several = keep(sizes.where("n > 1").select("root", "c.row_key"), "simhash-chosen")
    moved = salted_join(placed, several.select("root"), "root", "row_key").select(F.xxhash64("row_key").alias("key"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"),
        docs["text"].alias("text"),
    ).select("doc", row_key().alias("row_key"))
    told = rows.withColumn("moved", may_be_in(moved, F.xxhash64("row_key")))
    chosen = sizes.select("c.row_key")
    of_several = told.where("moved").join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"])
    return told.where("NOT moved").select("doc.*").unionByName(of_several.select("doc.*"))
