"""Rules met through an index of the texts they look for.

``detect.run_rules`` tests every rule of a source on each of its lines, which suits some
hundred rules. Here an automaton (Aho and Corasick, 1975) over all texts that rules look for
reads a line once and names the rules of which the line holds a needed text; only these are
tested. So the cost of a line follows the rules it comes close to and not their number.

A rule is indexed if its condition is made of text tests (contains, startswith, endswith,
equality, lists, absence, keywords) and some text must be in every line it matches: of an
``and`` the best side is taken, of an ``or`` all sides. The others (regular expressions,
wildcards, numbers, negations alone) stay in the plain pass beside it. Both give the alerts
of ``detect.run_rules``.

Rules given as a list are held by the driver and by each worker. Rules given as a table
(``run_rules(..., table=)``) are not: tasks compile them, a filter of bounded size tells which
of their texts a line may hold (``functions.keyscan``), and only lines that may hold one are
joined with the rules that need it and tested.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions import keyscan
from vigilog.operators import detect
from vigilog.rules.compiler import EMPTY_VALUES, Fields, RuleCompiler, check_counts, fields_of
from vigilog.rules.pack import RULE_SCHEMA, Rule, rule_from_row
from vigilog.session import cut_lineage, ship_package

SEPARATOR = "\n"  # between the fields of a line; a text that holds it is no key
LEAST_KEY = 2  # characters; shorter texts would name too many rules


class _Undecided(Exception):
    """The condition holds a test that is left to the plain pass."""


class TreeForm:
    """Conditions as nested tuples: ("or", parts), ("and", parts), ("not", part), or a test."""

    false, true = ("or", ()), ("and", ())

    @staticmethod
    def any_of(parts) -> tuple:
        return ("or", tuple(parts))

    @staticmethod
    def all_of(parts) -> tuple:
        return ("and", tuple(parts))

    @staticmethod
    def negated(part) -> tuple:
        return ("not", part)

    @staticmethod
    def known(part) -> tuple:
        return part  # unknown is false here already

    @staticmethod
    def contains(text, values) -> tuple:
        return ("contains", text, tuple(v.lower() for v in values))

    @staticmethod
    def affix(modifier, text, value) -> tuple:
        return (modifier, text, (value,))

    @staticmethod
    def listed(text, values) -> tuple:
        return ("in", text, tuple(values))

    @staticmethod
    def plain(text, value) -> tuple:
        if "*" in value:
            raise _Undecided
        return ("in", text, (value.lower(),))

    @staticmethod
    def not_listed(text, values) -> tuple:
        return ("and", (("present", text, ()), ("not", ("in", text, tuple(values)))))

    @staticmethod
    def empty(text) -> tuple:
        return ("or", (("not", ("present", text, ())), ("in", text, tuple(EMPTY_VALUES))))

    @staticmethod
    def regex(text, value) -> tuple:
        raise _Undecided

    gte = regex


class _Names(Fields):
    """Texts as (field, whether the whole line stands in for an absent one)."""

    def __init__(self):
        super().__init__(lambda name: (name, False), "raw")

    def searched(self, name: str, with_raw: bool):
        return (name, with_raw)

    def line(self):
        return ("", True)


def condition_tree(rule: Rule, mode: str = "intent") -> tuple | None:
    """The rule's condition as a tree, or None where the plain pass has to decide it."""
    try:
        return RuleCompiler(rule, _Names(), mode, TreeForm).condition()
    except _Undecided:
        return None


def needed_texts(tree: tuple) -> frozenset[str] | None:
    """Texts of which every matching line holds one; None where there is no such set."""
    kind = tree[0]
    if kind == "or":
        sides = [needed_texts(t) for t in tree[1]]
        return None if any(s is None for s in sides) else frozenset().union(*sides)
    if kind == "and":
        sides = [s for t in tree[1] if (s := needed_texts(t)) is not None]
        # The side whose shortest text is longest, then the one with fewest texts.
        return max(sides, key=lambda s: (min(map(len, s), default=1 << 30), -len(s)), default=None)
    if kind in ("contains", "startswith", "endswith", "in"):
        texts = frozenset(tree[2])
        return texts if all(len(t) >= LEAST_KEY and SEPARATOR not in t for t in texts) else None
    return None


def holds(tree: tuple, values: dict[str, str | None]) -> bool:
    """Whether a line with these fields satisfies the condition."""
    kind = tree[0]
    if kind == "or":
        return any(holds(t, values) for t in tree[1])
    if kind == "and":
        return all(holds(t, values) for t in tree[1])
    if kind == "not":
        return not holds(tree[1], values)
    (name, with_raw), wanted = tree[1], tree[2]
    text = values.get(name)
    if text is None and with_raw:
        text = values["raw"] or ""
    if text is None:
        return False
    if kind == "contains":
        return any(w in text for w in wanted)
    if kind == "startswith":
        return text.startswith(wanted)
    if kind == "endswith":
        return text.endswith(wanted)
    return kind == "present" or text in wanted


class RuleIndex:
    """The indexed rules of one source: keys, and the condition of each by its number."""

    def __init__(self, trees: dict[int, tuple]):
        self.trees = trees
        self.keys: dict[str, list[int]] = {}
        for number, tree in trees.items():
            for text in needed_texts(tree):
                self.keys.setdefault(text, []).append(number)

        self._automaton = None  # built where it is used

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for text, numbers in self.keys.items():
                found.add_word(text, tuple(numbers))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def matches(self, values: dict[str, str | None]) -> list[int]:
        """Numbers of the rules that a line satisfies, rising."""
        if not self.keys:
            return []
        line = SEPARATOR.join(v for v in values.values() if v)
        near = {n for _, numbers in self.automaton().iter(line) for n in numbers}
        return sorted(n for n in near if holds(self.trees[n], values))


def split_rules(rules: Sequence[Rule], mode: str = "intent") -> tuple[dict[str, RuleIndex], list[int]]:
    """An index of each source, and the positions of the rules of the plain pass."""
    trees: dict[str, dict[int, tuple]] = {}
    plain = []
    for number, rule in enumerate(rules):
        tree = condition_tree(rule, mode)
        if tree is None or needed_texts(tree) is None:
            plain.append(number)
        else:
            trees.setdefault(rule.log_source, {})[number] = tree
    return {source: RuleIndex(own) for source, own in trees.items()}, plain


def _hits(index: RuleIndex, names: Sequence[str]) -> Callable:
    columns = [f"f{i}" for i in range(len(names))]

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            told = []
            for row in zip(*[rows[c] for c in (*columns, "raw")]):
                values = {n: v if isinstance(v, str) else None for n, v in zip((*names, "raw"), row)}
                told.append(index.matches(values) if values["raw"] is not None else None)
            yield pd.Series(told, dtype=object)

    return hits


def run_rules(
    logs: DataFrame, rules: Sequence[Rule], mode: str = "intent", table: DataFrame | None = None
) -> DataFrame:
    """The alerts of ``detect.run_rules`` for ``rules`` and for the rows of a rule table.

    For the list nothing is shuffled; its index goes to the workers with the function, so it
    suits some ten thousand rules. ``table`` has the columns of ``pack.RULE_SCHEMA`` and may hold
    any number; those of its rules that the plain pass has to decide join the list.
    """
    ship_package(logs.sparkSession)
    if table is not None:
        compiled = cut_lineage(logs.sparkSession, compile_table(table, mode), "rule-table")
        left = compiled.where("tree IS NULL").select(*RULE_SCHEMA.fieldNames()).toLocalIterator()
        listed = [*rules, *(rule_from_row(r.asDict(recursive=True)) for r in left)]
        return run_rules(logs, listed, mode).unionByName(_run_compiled(logs, compiled.where("tree IS NOT NULL"), mode))
    active = detect.row_rules(rules, mode)
    indexes, plain = split_rules(active, mode)
    if not indexes:
        return detect.run_rules(logs, rules, mode)
    view = detect._with_host(detect.parsed_view(logs))
    columns = view.columns
    rest = [active[i] for i in plain]
    found = detect.matched_rules(view, rest, mode) if rest else view.withColumn("_hits", F.array().cast("array<int>"))
    positions = F.array(*map(F.lit, plain)).cast("array<int>")
    found = found.withColumn("_hits", F.transform("_hits", lambda i: F.get(positions, i)))
    indexed = [r for i, r in enumerate(active) if i not in set(plain)]
    found = detect.with_fields(found, indexed, mode)
    near = [F.coalesce("_hits", F.array().cast("array<int>"))]
    for source, index in indexes.items():
        names = fields_of(r for r in indexed if r.log_source == source)
        told = _hits(index, names)(F.col(f"_f_{source}"))
        near.append(F.coalesce(told, F.array().cast("array<int>")))
    exploded = found.select(*columns, F.explode_outer(F.concat(*near)).alias("_rule"))
    return detect.build_alerts(exploded.where(F.col("_rule").isNotNull()), active)


# ---- rule tables ----------------------------------------------------------------------

COMPILED = (
    ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RULE_SCHEMA)
    + ", tree string, keys array<string>, fields array<string>"
)
PIECE_BITS = 19  # a piece of the filter is 64 KB


def compile_table(table: DataFrame, mode: str = "intent") -> DataFrame:
    """The enabled rules of a table as decided on single rows, each with a ``number``.

    ``tree`` is null for a rule that is left to the plain pass. A rule whose condition no line
    meets is left out.
    """

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for r in batch.to_pylist() if (row := _compiled_row(r, mode)) is not None]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_COMPILED)

    # A table of many rules may be a single small file: compiling is dealt out anew.
    rows = table.select(*RULE_SCHEMA.fieldNames()).hint("rebalance").mapInArrow(compiled, COMPILED)
    return rows.withColumn("number", F.monotonically_increasing_id())


_TEXTS = pa.list_(pa.string())
_ARROW_COMPILED = pa.schema(
    [
        (f.name, {"boolean": pa.bool_(), "string": pa.string()}.get(f.dataType.simpleString(), _TEXTS))
        for f in RULE_SCHEMA
    ]
    + [("tree", pa.string()), ("keys", _TEXTS), ("fields", _TEXTS)]
)


def _compiled_row(row: dict, mode: str) -> dict | None:
    for rule in detect.row_rules([check_counts(rule_from_row(row))], mode):
        tree = condition_tree(rule, mode)
        keys = None if tree is None else needed_texts(tree)
        if keys is not None and not keys:
            return None
        told = {name: getattr(rule, name) for name in RULE_SCHEMA.fieldNames()}
        if keys is None:
            return {**told, "detection": json.dumps(rule.detection), "tree": None, "keys": [], "fields": []}
        # The detection is in the tree; a text that UTF-8 cannot hold is in no line.
        keys = [k for k in sorted(keys) if k.encode("utf-8", "ignore").decode() == k]
        return {**told, "detection": None, "tree": json.dumps(tree), "keys": keys, "fields": fields_of([rule])}
    return None


def _keys_of(rules: DataFrame) -> DataFrame:
    """(number, log_source, key) and its hashes and length."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = keyscan.key_hashes(batch.column("key").to_pylist())
            columns = [*batch.columns, *map(pa.array, told)]
            yield pa.RecordBatch.from_arrays(columns, ["number", "log_source", "key", "hash", "begun", "length"])

    keys = rules.select("number", "log_source", F.explode("keys").alias("key"))
    return keys.mapInArrow(hashed, "number long, log_source string, key string, hash long, begun long, length long")


def _filter_of(keys: DataFrame) -> keyscan.KeyFilter:
    """The filter of all keys. Its pieces are made by tasks; the driver joins them."""
    told = keys.agg(F.approx_count_distinct("hash").alias("n"), F.collect_set("length").alias("lengths")).first()
    bits = keyscan.bits_for(told["n"])
    piece_bits = min(bits, PIECE_BITS)
    data = np.zeros(1 << (bits - 3), np.uint8)
    pieces = (
        keys.select("hash", "begun").distinct()
        .mapInArrow(lambda batches: keyscan.filter_pieces(batches, bits, piece_bits), "piece int, place int")
        .repartition("piece")
        .mapInArrow(lambda batches: keyscan.packed_pieces(batches, piece_bits), "piece int, bytes binary")
    )
    size = 1 << (piece_bits - 3)
    for row in pieces.toLocalIterator():
        data[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["bytes"], np.uint8)
    return keyscan.KeyFilter(bits, data, told["lengths"])


def _run_compiled(logs: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """Alerts of the compiled rules of a table."""
    used = rules.select("log_source", F.explode("fields").alias("field")).distinct().collect()
    names_of: dict[str, list[str]] = {s: [] for s in sorted({r["log_source"] for r in rules.select("log_source").distinct().collect()})}
    for source, name in sorted(map(tuple, used)):
        names_of[source].append(name)
    keys = cut_lineage(logs.sparkSession, _keys_of(rules), "rule-keys")
    known = _filter_of(keys)

    @F.arrow_udf("array<bigint>")
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in texts:
            yield known.scan(own)

    @F.arrow_udf("boolean")
    def met(sources: pa.Array, values: pa.Array, trees: pa.Array, keys: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (sources, values, trees, keys)))
        return pa.array([_met(dict(zip((*names_of[s], "raw"), v)), t, k) for s, v, t, k in rows], pa.bool_())

    view = detect._with_host(detect.parsed_view(logs))
    columns = view.columns
    values = F.lit(None).cast("array<string>")
    for source, names in names_of.items():
        told = F.array(*[F.col(f"_f_{source}.f{i}") for i in range(len(names))], F.col(f"_f_{source}.raw"))
        values = F.when((F.col("log_source") == source) & F.col("content").isNotNull(), told).otherwise(values)
    found = detect.with_named_fields(view, names_of, mode).select(*columns, values.alias("_values"))
    near = found.select(*columns, "_values", F.explode_outer(scan(F.array_join("_values", SEPARATOR))).alias("_hash"))
    near = near.where(F.col("_hash").isNotNull())
    own = keys.select(F.col("log_source").alias("_source"), F.col("hash").alias("_key_hash"), F.col("key").alias("_key"), F.col("number").alias("_number"))
    met_by = near.join(own, (near["log_source"] == own["_source"]) & (near["_hash"] == own["_key_hash"]))
    texts = ("id", "title", "description", "level", "falsepositives", "references")
    of_number = rules.select(F.col("number").alias("_rule_number"), F.struct(*texts).alias("_rule"), F.col("tree").alias("_tree"))
    tested = met_by.join(of_number, F.col("_number") == F.col("_rule_number"))
    return detect.alert_rows(tested.where(met("_source", "_values", "_tree", "_key")), F.col("_rule"))


def _met(values: dict[str, str | None], tree: str, key: str) -> bool:
    """Whether a line satisfies a rule, told for the first of the rule's texts that it holds."""
    condition, needed = _read_tree(tree)
    line = SEPARATOR.join(v for v in values.values() if v)
    return next((k for k in needed if k in line), None) == key and holds(condition, values)


@lru_cache(maxsize=4096)
def _read_tree(text: str) -> tuple[tuple, list[str]]:
    def tuples(part):
        return tuple(map(tuples, part)) if isinstance(part, list) else part

    tree = tuples(json.loads(text))
    return tree, sorted(needed_texts(tree))
