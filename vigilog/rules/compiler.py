"""Detection blocks to SQL conditions.

``mode="intent"`` gives every modifier its evident meaning. ``mode="compat"``
reproduces the plain matcher: unknown modifiers compare for equality, a field
that is absent is looked for in the whole raw line, and the connective of a
condition is decided by its text alone.

A condition is one SQL text, so a pack of rules reaches the planner as one
expression instead of thousands of single Column calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from vigilog.rules.pack import Rule

# Rule field names and the log fields they read.
FIELD_MAP = {
    "linux": {
        "CommandLine": "message",
        "ProcessName": "program",
        "User": "user",
        "SourceIp": "source_ip",
        "DestinationIp": "destination_ip",
        "Message": "message",
    },
    "windows": {
        "CommandLine": "command_line",
        "ProcessName": "process_name",
        "ParentProcessName": "parent_process_name",
        "User": "user_name",
        "EventID": "event_id",
        "Channel": "channel",
        "Message": "message",
    },
    "nginx": {
        "Url": "path",
        "RequestMethod": "method",
        "StatusCode": "status_code",
        "UserAgent": "user_agent",
        "SourceIp": "remote_addr",
        "Referer": "referer",
    },
}
EMPTY_VALUES = ["", "-"]
TEXT_MODIFIERS = ("contains", "startswith", "endswith")
AGGREGATE_MODIFIERS = {"count", "count|gte", "duplicate"}
DEFAULT_TIMEFRAME = "1m"

FALSE = "false"


def quoted(text: str) -> str:
    """SQL literal of a text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def log_field(source: str, name: str) -> str:
    return FIELD_MAP.get(source, {}).get(name, name.lower())


def split_key(key: str) -> tuple[str, str | None]:
    name, _, modifier = key.partition("|")
    return name, modifier or None


def values_of(value: Any) -> list[str]:
    items = value if isinstance(value, list) else [value]
    return [str(v) for v in items]


def any_of(conditions: Iterable[str]) -> str:
    parts = [c for c in conditions if c != FALSE]
    return f"({' OR '.join(parts)})" if parts else FALSE


def all_of(conditions: Iterable[str]) -> str:
    parts = list(conditions)
    return FALSE if FALSE in parts else f"({' AND '.join(parts)})"


def safe_regex(pattern: str) -> str | None:
    """The pattern in Java's spelling, or null when one of both languages has no such pattern.

    Rule patterns follow Python's syntax. Java differs in a brace that repeats
    nothing, in brackets and ``&&`` inside a character class, and in named groups.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    spelled = _java_spelling(pattern)
    return spelled if _java_accepts(spelled) else None


@lru_cache(maxsize=10_000)
def _java_accepts(pattern: str) -> bool:
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # a PatternSyntaxException is one
        return False
    return True


def _java_spelling(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(JAVA_ESCAPES.get(pattern[i : i + 2], pattern[i : i + 2]))
            i += 2
            continue
        repeat = re.match(r"\{(\d*)(,?)(\d*)\}", pattern[i:])
        if in_class:
            opens = out[-1] in ("[", "[^")
            if c == "]" and not opens:
                in_class = False
            elif c in "[]&":
                c = "\\" + c
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                c, i = "[^", i + 1
        elif repeat and (repeat[1] or repeat[3]):
            low, comma, high = repeat.groups()
            c, i = f"{{{low or 0}{comma}{high}}}", i + len(repeat[0]) - 1
        elif c == "{":
            c = "\\{"
        out.append(c)
        i += 1
    named = "".join(out).replace("(?P<", "(?<")
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)


# Escapes whose meaning differs between the two pattern languages.
JAVA_ESCAPES = {"\\Z": "\\z"}


@dataclass(frozen=True)
class Fields:
    """SQL of a rule's field values in the rows it is applied to, lower-cased.

    ``present(name)`` is the field's own text or null and ``raw`` the whole line.
    """

    present: Callable[[str], str]
    raw: str

    def searched(self, name: str, with_raw: bool) -> str:
        own = self.present(name)
        return f"coalesce({own}, {self.raw}, '')" if with_raw else own

    def line(self) -> str:
        return f"coalesce({self.raw}, '')"


def match_contains(text: str, values: list[str]) -> str:
    return any_of(f"contains({text}, {quoted(v.lower())})" for v in values)


def match_regex(text: str, value: str) -> str:
    pattern = safe_regex(value)
    return FALSE if pattern is None else f"{text} RLIKE {quoted('(?id)' + pattern)}"


def match_plain(text: str, value: str) -> str:
    """Equality, or an anchored pattern when the value holds a ``*``."""
    value = value.lower()
    if "*" not in value:
        return f"{text} = {quoted(value)}"
    pattern = safe_regex(value.replace("*", ".*"))
    return FALSE if pattern is None else f"{text} RLIKE {quoted(f'(?id)^{pattern}$')}"


def match_list(text: str, values: list[str]) -> str:
    return f"{text} IN ({', '.join(quoted(v) for v in values)})"


def match_gte(text: str, values: list[str]) -> str:
    """At least one of the limits is reached; a limit that is no number never is."""
    limits = [n for n in map(number, values) if n is not None]
    return any_of(f"try_cast({text} AS DOUBLE) >= {n}D" for n in limits)


def number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)\s*", text) else None


def known(condition: str) -> str:
    """The condition with unknown taken as false."""
    return condition if condition in (FALSE, "true") else f"coalesce({condition}, false)"


class SqlForm:
    """Conditions as SQL text."""

    false, true = FALSE, "true"
    any_of = staticmethod(any_of)
    all_of = staticmethod(all_of)
    known = staticmethod(known)
    contains = staticmethod(match_contains)
    regex = staticmethod(match_regex)
    plain = staticmethod(match_plain)
    listed = staticmethod(match_list)
    gte = staticmethod(match_gte)

    @staticmethod
    def negated(condition: str) -> str:
        return f"NOT {condition}"

    @staticmethod
    def affix(modifier: str, text: str, value: str) -> str:
        return f"{modifier}({text}, {quoted(value)})"

    @staticmethod
    def not_listed(text: str, values: list[str]) -> str:
        return f"({text} IS NOT NULL AND NOT {match_list(text, values)})"

    @staticmethod
    def empty(text: str) -> str:
        return f"({text} IS NULL OR {match_list(text, EMPTY_VALUES)})"


class RuleCompiler:
    """Compiles the row conditions of one rule over ``fields``, as SQL or in another ``form``."""

    def __init__(self, rule: Rule, fields: Fields, mode: str = "intent", form=SqlForm):
        if mode not in ("intent", "compat"):
            raise ValueError(f"unknown mode {mode!r}")
        self.rule = rule
        self.fields = fields
        self.compat = mode == "compat"
        self.form = form

    def condition(self) -> str:
        text = self.rule.detection.get("condition", "selection")
        return self._compat_condition(text) if self.compat else self._condition(text)

    # -- conditions ------------------------------------------------------------

    def _condition(self, text: str) -> str:
        """``or`` of ``and`` of optionally negated block names; anything else is false."""
        if re.search(r"[()|]|\bof\b", text):
            return self.form.false
        return self.form.any_of(
            self.form.all_of(self._term(term.strip()) for term in branch.split(" and "))
            for branch in text.split(" or ")
        )

    def _term(self, term: str) -> str:
        if term.startswith("not "):
            return self.form.negated(self._named(term[4:]))
        return self._named(term)

    def _named(self, name: str) -> str:
        return self.form.known(self.block(name.strip()))

    def _compat_condition(self, text: str) -> str:
        """The first connective found anywhere in the text splits the whole condition."""
        if text == "selection":
            return self._named(text)
        if "and not" in text:
            sides = text.split(" and not ")
            if len(sides) != 2:
                return self.form.false
            return self.form.all_of([self._named(sides[0]), self.form.negated(self._named(sides[1]))])
        if "or" in text:
            return self.form.any_of(self._named(part) for part in text.split(" or "))
        if "and" in text:
            return self.form.all_of(self._named(part) for part in text.split(" and "))
        return self.form.false

    # -- blocks ----------------------------------------------------------------

    def block(self, name: str) -> str:
        content = self.rule.detection.get(name)
        if not content:
            return self.form.false
        if name == "aggregation" and not self.compat:
            # Counted over groups of rows, see operators.correlate.
            return self.form.true
        if isinstance(content, dict):
            return self._fields(content)
        if isinstance(content, list):
            maps = [self._fields(c) for c in content if isinstance(c, dict) and c]
            words = [str(c) for c in content if not isinstance(c, dict)]
            if words and not self.compat:
                maps.append(self.form.contains(self.fields.line(), words))
            return self.form.any_of(maps)
        return self.form.false

    def _fields(self, block: dict[str, Any]) -> str:
        return self.form.all_of(self._field(key, value) for key, value in block.items())

    def _field(self, key: str, value: Any) -> str:
        name, modifier = split_key(key)
        if counts(key) and not self.compat:
            # Decided over groups of rows, see operators.correlate.
            return self.form.true
        field = log_field(self.rule.log_source, name)
        values = values_of(value)
        if self.compat:
            return self._compat_field(field, modifier, values)
        return self._intent_field(field, modifier, values)

    def _compat_field(self, field: str, modifier: str | None, values: list[str]) -> str:
        text = self.fields.searched(field, with_raw=True)
        if modifier == "re":
            return self.form.any_of(self.form.regex(text, v.lower()) for v in values)
        if modifier in TEXT_MODIFIERS:
            return self._text_match(text, modifier, values)
        return self.form.any_of(self.form.plain(text, v) for v in values)

    def _text_match(self, text: str, modifier: str, values: list[str]) -> str:
        if modifier == "contains":
            return self.form.contains(text, values)
        return self.form.any_of(self.form.affix(modifier, text, v.lower()) for v in values)

    def _intent_field(self, field: str, modifier: str | None, values: list[str]) -> str:
        own = self.fields.present(field)
        text = self.fields.searched(field, with_raw=not self.rule.require_fields)
        lowered = [v.lower() for v in values]
        if modifier in TEXT_MODIFIERS:
            return self._text_match(text, modifier, values)
        if modifier == "re":
            return self.form.any_of(self.form.regex(text, v) for v in values)
        if modifier in ("in", "ip_in"):
            return self.form.listed(own, lowered)
        if modifier == "not_in":
            return self.form.not_listed(own, lowered)
        if modifier == "gte":
            return self.form.gte(own, values)
        if modifier == "empty":
            empty = self.form.empty(own)
            return empty if lowered[0] == "true" else self.form.negated(empty)
        return self.form.any_of(self.form.plain(own, v) for v in values)


def counts(key: str) -> bool:
    """Whether a block's key counts rows instead of testing one."""
    name, modifier = split_key(key)
    return modifier in AGGREGATE_MODIFIERS or (name == "count" and modifier == "gte")


NEVER = 2**63 - 1


@dataclass(frozen=True)
class Counting:
    """What a counting rule counts in each group and window of its matching rows.

    ``field`` names the group; without one rows are grouped by their server. With
    ``distinct`` the different values of that field are counted instead of rows.
    The count is met inside one of ``ranges``, both ends included.
    """

    timeframe: str
    group: str | None
    distinct: str | None
    ranges: tuple[tuple[int, int], ...]

    @property
    def least(self) -> int:
        return min(low for low, _ in self.ranges)


def counting_of(rule: Rule) -> Counting | None:
    """The first count a rule asks for, if it asks for any."""
    for name, block in rule.detection.items():
        for part in block if isinstance(block, list) else [block]:
            if isinstance(part, dict):
                for key, value in part.items():
                    if counts(key):
                        return _counting(rule, key, values_of(value), _timeframe(rule))
    return None


def _timeframe(rule: Rule) -> str:
    block = rule.detection.get("aggregation")
    return str(block.get("timeframe", DEFAULT_TIMEFRAME)) if isinstance(block, dict) else DEFAULT_TIMEFRAME


def _counting(rule: Rule, key: str, limits: list[str], frame: str) -> Counting:
    """Three spellings: ``field|count: '>n'`` counts rows for each value of the field,
    ``count|gte: n`` rows for each server, ``field|count|gte: n`` different values for each
    server; ``field|duplicate`` asks for a value that two servers share. Of several limits
    one has to be met; one that is no number never is.
    """
    name, modifier = split_key(key)
    field = log_field(rule.log_source, name)
    if modifier == "duplicate":
        return Counting(frame, field, SERVER, ((2 if limits[0].lower() == "true" else NEVER, NEVER),))
    bare = ">" if modifier == "count" else ">="
    ranges = tuple(count_range(limit, bare) or (NEVER, NEVER) for limit in limits)
    if modifier == "count":
        return Counting(frame, field, None, ranges)
    return Counting(frame, None, None if name == "count" else field, ranges)


def count_range(limit: str, bare: str = ">=") -> tuple[int, int] | None:
    """Counts that meet a limit such as ``>5``; ``bare`` is the sign of a mere number."""
    found = re.fullmatch(r"\s*(>=|<=|==|>|<|=|)\s*(\d+)\s*", limit)
    if not found:
        return None
    sign, n = found[1] or bare, int(found[2])
    return {
        ">": (n + 1, NEVER), ">=": (n, NEVER), "<": (1, n - 1), "<=": (1, n), "=": (n, n), "==": (n, n),
    }[sign]


@dataclass(frozen=True)
class Branch:
    """One way to satisfy a rule: conditions on rows, and all counts that must be met.

    ``rule`` is the rule with the blocks of this branch alone.
    """

    rule: Rule
    counts: tuple[Counting, ...]


def branches_of(rule: Rule) -> list[Branch]:
    """The ways that a rule's condition leaves, one for each ``or`` and each map of a list.

    A block named ``aggregation`` holds for every branch if the condition does not name it.
    """
    text = rule.detection.get("condition", "selection")
    if not isinstance(text, str) or re.search(r"[()|]|\bof\b", text):
        return []
    always = ["aggregation"] if rule.detection.get("aggregation") and "aggregation" not in text else []
    parts = [[t.strip() for t in part.split(" and ")] for part in text.split(" or ")]
    return [b for terms in parts for b in _ways(rule, [*terms, *always])]


def _ways(rule: Rule, terms: list[str]) -> list[Branch]:
    ways: list[tuple[dict, list[Counting]]] = [({}, [])]
    for term in terms:
        name = term.removeprefix("not ").strip()
        block = rule.detection.get(name)
        if term.startswith("not ") or not isinstance(block, (list, dict)):
            ways = [({**d, name: block}, c) for d, c in ways]
            continue
        if isinstance(block, list) and not any(counts(k) for m in block if isinstance(m, dict) for k in m):
            ways = [({**d, name: block}, c) for d, c in ways]
            continue
        maps = block if isinstance(block, list) else [block]
        ways = [({**d, name: m if isinstance(m, dict) else [m]}, [*c, *_counts_of(rule, m)]) for d, c in ways for m in maps]
    condition = " and ".join(terms)
    return [Branch(replace(rule, detection={**d, "condition": condition}), tuple(c)) for d, c in ways]


def _counts_of(rule: Rule, part: Any) -> list[Counting]:
    if not isinstance(part, dict):
        return []
    return [_counting(rule, k, values_of(v), _timeframe(rule)) for k, v in part.items() if counts(k)]


def plain_part(rule: Rule) -> Rule | None:
    """What of a counting rule is decided on single rows: its branches without counts."""
    plain = [b.rule for b in branches_of(rule) if not b.counts]
    if not plain:
        return None
    detection, conditions = {}, []
    for i, own in enumerate(plain):
        terms = []
        for term in own.detection["condition"].split(" and "):
            name = term.strip().removeprefix("not ").strip()
            named = name if name == "aggregation" else f"way{i}_{name}"
            detection[named] = own.detection.get(name)
            terms.append(f"not {named}" if term.strip().startswith("not ") else named)
        conditions.append(" and ".join(terms))
    return replace(rule, detection={**detection, "condition": " or ".join(conditions)})


def check_counts(rule: Rule) -> Rule:
    """The rule, if every count in it has a meaning; else ``ValueError``.

    Without meaning are a limit that is no number with a known sign, a count that is
    negated or in a block no condition names, and counts of one branch over different groups.
    """

    def refuse(why: str):
        raise ValueError(f"rule {rule.id}: {why}")

    if counting_of(rule) is None:
        return rule
    for block in rule.detection.values():
        for part in block if isinstance(block, list) else [block]:
            for key, value in part.items() if isinstance(part, dict) else ():
                if counts(key):
                    told = values_of(value)
                    if split_key(key)[1] == "duplicate":
                        if told[0].lower() not in ("true", "false"):
                            refuse(f"{key}: {told[0]!r} is neither true nor false")
                    elif bad := [v for v in told if count_range(v) is None]:
                        refuse(f"{key}: {bad[0]!r} is no limit")
    ways = branches_of(rule)
    if len({id_ for b in ways for id_ in b.counts}) == 0:
        refuse("its condition reads no count")
    text = str(rule.detection.get("condition", "selection"))
    for name, block in rule.detection.items():
        maps = block if isinstance(block, list) else [block]
        if any(counts(k) for m in maps if isinstance(m, dict) for k in m) and re.search(rf"\bnot {re.escape(name)}\b", text):
            refuse(f"{name} is negated but counts")
    for b in ways:
        if len({c.group for c in b.counts}) > 1:
            refuse("it counts over different groups at once")
    return rule


#: Stands for the server of a row where a field's name is meant.
SERVER = "server"


def fields_of(rules: Iterable[Rule]) -> list[str]:
    """Log fields the blocks of ``rules`` read, in a stable order."""
    names: dict[str, None] = {}
    for rule in rules:
        for block in rule.detection.values():
            maps = block if isinstance(block, list) else [block]
            for m in maps:
                if isinstance(m, dict):
                    for key in m:
                        names[log_field(rule.log_source, split_key(key)[0])] = None
    return list(names)
