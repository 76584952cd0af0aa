"""Line parsers as Column expressions, one struct (or map) per log type.

Each pattern runs once per line: the captured groups are joined with a private
separator by one ``regexp_replace`` and split again, so a parser with nineteen
groups costs one regex pass, not nineteen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import blank_to_null, strip

# The line formats. (?d) makes "\\n" the only line end.
SYSLOG_HEADER = (
    r"(?d)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[\.\d]*[Z\+\-\:0-9]*|\S+\s+\S+\s+\S+|\S+)"
    r"\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s+"
)
SYSLOG_MESSAGE = r"(.*)"
SSH_EVENT = (
    r"(Accepted|Failed)[^\S\n]+(?:password|publickey)[^\S\n]+for[^\S\n]+"
    r"(?:invalid[^\S\n]+user[^\S\n]+)?(\S+)[^\S\n]+from[^\S\n]+(\S+)"
)
ACCESS_REQUEST = (
    r"(?d)^([\d\.]+)\s+-\s+(\S+)\s+\[(.*?)\]\s+"
    r'"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\d+)'
)
ACCESS_TAIL = r'\s+"([^"]*)"\s+"([^"]*)"'
CONN_RECORD = (
    r"(?d)^(\d+\.\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
    r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    r"(?:\s+\(empty\)|\s+\S+)?"
)
CONN_FIELDS = [
    "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration",
    "orig_bytes", "resp_bytes", "conn_state", "local_orig", "missed_bytes", "history",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
CONN_INTS = ["orig_p", "resp_p"]
CONN_LONGS = [
    "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
IPV4_LEAD = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+"
RELAY_PREFIX = r"^(?:\[[^\]]*\]\s+)?(?:<\d{1,3}>)?"
ACCESS_TIME = "d/MMM/yyyy:H:m:s"
STORED_TIME = "yyyy-MM-dd HH:mm:ss"

# Stands between captured groups. A single private-use character may be part of a line and
# is kept; only these three in a row are not.
SEPARATOR = "\ue000\ue001\ue002"


def _captures(line: Column, pattern: str, groups: int, rest: str = r"(?s:.*)") -> Column:
    """Captured groups as an array; an array of another size when there is no match."""
    template = SEPARATOR.join(f"${i}" for i in range(1, groups + 1))
    clean = F.replace(line, F.lit(SEPARATOR), F.lit("\ufffd"))
    return F.split(F.regexp_replace(clean, pattern + rest + r"\z", template), SEPARATOR, -1)


def fence(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns computed once and for all.

    Filters on the columns stay above this point. Without it the optimizer moves
    a filter below the projections and repeats their expressions inside it, which
    would run every line pattern twice.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def without_relay_prefix(line: Column) -> Column:
    """Drop a ``[address] <priority>`` prefix put there by a relay."""
    return F.regexp_replace(strip(line), RELAY_PREFIX, "")


# ---- syslog ---------------------------------------------------------------

SYSLOG_GROUPS = 8


def syslog_captures(line: Column) -> Column:
    """Header fields, the SSH event found in the message, and the message."""
    look = rf"(?=(?:.*?{SSH_EVENT})?)"
    return _captures(line, SYSLOG_HEADER + look + SYSLOG_MESSAGE, SYSLOG_GROUPS)


def syslog_accepts(line: Column) -> Column:
    """Lines that may be syslog: neither JSON nor a web access line."""
    return ~line.startswith("{") & ~line.rlike(IPV4_LEAD + "-")


def syslog_struct(raw: str) -> Column:
    """Record of the captures in column ``raw``."""

    def ssh(i: int) -> str:
        return f"CASE WHEN get({raw}, 2) = 'sshd' THEN nullif(get({raw}, {i}), '') END"

    return F.expr(f"""named_struct(
        'timestamp', get({raw}, 0),
        'hostname', get({raw}, 1),
        'app_name', get({raw}, 2),
        'pid', try_cast(nullif(get({raw}, 3), '') AS BIGINT),
        'raw_message', get({raw}, 7),
        'ssh_action', {ssh(4)},
        'ssh_user', {ssh(5)},
        'ssh_ip', {ssh(6)})""")


# ---- web access -----------------------------------------------------------

ACCESS_GROUPS = 11


def access_captures(line: Column, strict: bool = False) -> Column:
    """Groups of an access line; referer and agent are required when ``strict``.

    Group 9 is the whole optional tail, which tells an empty referer from a
    missing one.
    """
    tail = f"({ACCESS_TAIL})" if strict else f"({ACCESS_TAIL})?"
    return _captures(line, ACCESS_REQUEST + tail, ACCESS_GROUPS)


def access_accepts(line: Column) -> Column:
    return (
        line.rlike(IPV4_LEAD) & line.contains("[") & line.contains("]") & line.contains('"')
    )


def access_time(time_local: Column) -> Column:
    """Local time of an access line, zone text dropped; null when malformed."""
    first = F.split(strip(time_local), r"\s+")[0]
    return F.try_to_timestamp(first, F.lit(ACCESS_TIME))


def access_struct(raw: str) -> Column:
    """Record of the captures in column ``raw``."""
    status = f"try_cast(get({raw}, 6) AS INT)"
    time = f"split(btrim(get({raw}, 2)), '[ ]+')[0]"
    return F.expr(f"""named_struct(
        'remote_addr', get({raw}, 0),
        'remote_user', get({raw}, 1),
        'time_local', get({raw}, 2),
        'request_method', get({raw}, 3),
        'request_uri', get({raw}, 4),
        'server_protocol', get({raw}, 5),
        'status', {status},
        'body_bytes_sent', try_cast(get({raw}, 7) AS BIGINT),
        'http_referer', CASE WHEN get({raw}, 8) != '' THEN get({raw}, 9) END,
        'http_user_agent', CASE WHEN get({raw}, 8) != '' THEN get({raw}, 10) END,
        'timestamp', try_to_timestamp({time}, '{ACCESS_TIME}'),
        'status_category', CASE
            WHEN {status} = 0 THEN NULL
            WHEN {status} BETWEEN 200 AND 299 THEN 'success'
            WHEN {status} BETWEEN 300 AND 399 THEN 'redirect'
            WHEN {status} BETWEEN 400 AND 499 THEN 'client_error'
            WHEN {status} BETWEEN 500 AND 599 THEN 'server_error'
            WHEN {status} IS NOT NULL THEN 'unknown' END)""")


# ---- network connections ---------------------------------------------------

CONN_GROUPS = 19


def conn_accepts(line: Column) -> Column:
    return line.rlike(r"^\d+\.\d+\s")


def conn_captures(line: Column) -> Column:
    return _captures(line, CONN_RECORD, CONN_GROUPS, rest="")


def conn_struct(raw: str) -> Column:
    """Record of the captures in column ``raw``.

    The last token of the line is matched but never kept.
    """

    def value(i: int, name: str) -> str:
        text = f"get({raw}, {i})"
        if name == "ts":
            return f"timestamp_micros(CAST(round(CAST({text} AS DOUBLE) * 1000000) AS BIGINT))"
        if name in CONN_INTS:
            return f"try_cast({text} AS INT)"
        return f"try_cast({text} AS BIGINT)" if name in CONN_LONGS else text

    fields = [f"'{name}', {value(i, name)}" for i, name in enumerate(CONN_FIELDS)]
    return F.expr(f"named_struct({', '.join(fields)}, 'tunnel_parents', CAST(NULL AS STRING))")


# ---- Windows events ---------------------------------------------------------

def event_accepts(line: Column) -> Column:
    return line.startswith("{") & line.endswith("}")


def event_objects(line: Column) -> Column:
    """The JSON objects of a line; null if the text is not JSON throughout.

    The line is read as the only element of an array, so that text after the
    object makes it invalid.
    """
    return F.from_json(
        F.concat(F.lit("["), line, F.lit("]")),
        "array<map<string,string>>",
        {"mode": "PERMISSIVE", "allowSingleQuotes": "false"},
    )


def event_attrs(objects: Column) -> Column:
    """Attributes of the one object of a line; the last value of a repeated key."""
    return F.when(F.size(objects) == 1, last_key_wins(F.get(objects, 0)))


def last_key_wins(attrs: Column) -> Column:
    """Keep the last entry of every key of a map that may hold a key twice."""
    keys = F.map_keys(attrs)
    entries = F.map_entries(attrs)
    deduped = F.map_from_entries(_last_of_each_key(entries))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), attrs).otherwise(deduped)


def _last_of_each_key(entries: Column) -> Column:
    keys = F.transform(entries, lambda e: e["key"])

    def is_last(entry: Column, i: Column) -> Column:
        later = F.slice(keys, i + F.lit(2), F.size(keys))
        return ~F.array_contains(later, entry["key"])

    return F.filter(entries, is_last)


def message_entries(message: Column) -> Column:
    """Key/value pairs of a multi-line event message, in line order.

    A line with an empty value opens a section whose name prefixes the keys after
    it. Header lines are first turned into section breaks, so the message is split
    into sections and each section into lines: linear in the length of the text.
    """
    clean = F.replace(message, F.lit(SEPARATOR), F.lit("\ufffd"))
    text = F.concat(F.lit("\n"), F.replace(clean, F.lit("\r"), F.lit("")))
    marked = F.regexp_replace(text, r"(?md)^([^:\n]*):[^\S\n]*$", SEPARATOR + "$1")

    def section_entries(section: Column) -> Column:
        lines = F.split(section, "\n")
        header = F.replace(strip(lines[0]), F.lit(" "), F.lit(""))
        prefix = F.when(header == "", F.lit("")).otherwise(F.concat(header, F.lit("_")))
        pairs = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x.contains(":"))

        def entry(line: Column) -> Column:
            key = F.replace(strip(F.substring_index(line, ":", 1)), F.lit(" "), F.lit("_"))
            value = strip(F.substr(line, F.instr(line, ":") + F.lit(1)))
            return F.struct(F.concat(prefix, key).alias("key"), value.alias("value"))

        return F.transform(pairs, entry)

    found = F.flatten(F.transform(F.split(marked, SEPARATOR), section_entries))
    return F.when(message.isNotNull(), found)


def distinct_entries(entries: Column) -> Column:
    """The same entries with only the last value of a repeated key."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.when(
        F.size(F.array_distinct(keys)) == F.size(keys), entries
    ).otherwise(_last_of_each_key(entries))


def merge_attrs(base: Column, override: Column) -> Column:
    """Union of two maps; entries of ``override`` replace those of ``base``."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.when(override.isNull(), base).otherwise(F.map_concat(kept, override))


# Event field names and the canonical names they take.
CANONICAL_FIELDS = {
    "CommandLine": "cmdline",
    "ParentProcessName": "parent",
    "NewProcessName": "name",
    "Image": "image",
    "TargetUserName": "user",
    "TargetFilename": "target_file",
    "LogName": "channel",
    "CallerProcessName": "process_name",
    "SubjectUserName": "subject_user",
}


def canonical_value(attrs: Column, name: str) -> Column:
    """Value under a canonical name, else under the event's own name for it."""
    sources = [old for old, new in CANONICAL_FIELDS.items() if new == name]
    return F.coalesce(attrs[name], *[attrs[old] for old in sources])


def stored_time(text: Column) -> Column:
    """Timestamp of text in the stored layout; null when it does not fit."""
    fits = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    return F.when(fits, F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")))
