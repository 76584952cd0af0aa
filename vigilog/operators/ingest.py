"""Raw lines to typed records: detection, parsing, envelope rules, detail tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions import parsers as P
from vigilog.functions.text import basename, blank_to_null, strip


@dataclass(frozen=True)
class LineParser:
    """One log format.

    ``accepts`` is a cheap test on the stripped line and ``extract`` the raw fields
    of a line; ``refine`` works on the extracted column and ``matched`` tells whether
    the line parsed. ``build`` makes the typed record from the name of the extracted
    column, and ``hostname`` names its host from the name of the record column.
    """

    log_type: str
    accepts: Callable[[Column], Column]
    extract: Callable[[Column], Column]
    matched: Callable[[Column], Column]
    build: Callable[[str], Column]
    hostname: Callable[[str], Column]
    refine: Callable[[Column], Column] | None = None


def has_groups(n: int) -> Callable[[Column], Column]:
    return lambda captures: F.coalesce(F.size(captures) == n, F.lit(False))


WINDOWS = LineParser(
    "windows",
    P.event_accepts,
    P.event_objects,
    lambda attrs: attrs.isNotNull(),
    F.col,
    lambda attrs: F.col(attrs)["hostname"],
    refine=P.event_attrs,
)
ZEEK_CONN = LineParser(
    "zeek_conn",
    P.conn_accepts,
    P.conn_captures,
    has_groups(P.CONN_GROUPS),
    P.conn_struct,
    lambda r: F.col(f"{r}.orig_h"),
)
NGINX = LineParser(
    "nginx",
    P.access_accepts,
    P.access_captures,
    has_groups(P.ACCESS_GROUPS),
    P.access_struct,
    lambda r: F.col(f"{r}.remote_addr"),
)
NGINX_STRICT = replace(NGINX, extract=lambda line: P.access_captures(line, strict=True))
LINUX = LineParser(
    "linux",
    P.syslog_accepts,
    P.syslog_captures,
    has_groups(P.SYSLOG_GROUPS),
    P.syslog_struct,
    lambda r: F.col(f"{r}.hostname"),
)


class ParserRegistry:
    """Parsers in priority order; the first that accepts and parses a line wins."""

    def __init__(self, parsers: Sequence[LineParser] = (WINDOWS, ZEEK_CONN, NGINX, LINUX)):
        self._parsers = list(parsers)

    def register(self, parser: LineParser, priority: int | None = None) -> ParserRegistry:
        """A new registry with ``parser`` at ``priority``, or last."""
        position = len(self._parsers) if priority is None else priority
        return ParserRegistry(
            [*self._parsers[:position], parser, *self._parsers[position:]]
        )

    def types(self) -> list[str]:
        return [p.log_type for p in self._parsers]

    def get(self, log_type: str) -> LineParser | None:
        return next((p for p in self._parsers if p.log_type == log_type), None)

    def __iter__(self):
        return iter(self._parsers)


DEFAULT_PARSERS = ParserRegistry()


def parse_lines(
    envelopes: DataFrame,
    parsers: ParserRegistry = DEFAULT_PARSERS,
    line: str = "line",
    strip_prefix: bool = False,
) -> DataFrame:
    """Add ``log_type``, ``hostname`` and one typed column per log type.

    ``log_type`` is null for lines no parser takes; only the column of the line's
    own type is filled.
    """
    text = P.without_relay_prefix(F.col(line)) if strip_prefix else strip(F.col(line))
    out = envelopes.withColumn("_text", text)
    unclaimed = F.length("_text") > 0
    log_type = F.lit(None).cast("string")
    raw_columns = []
    for p in parsers:
        raw = f"_raw_{p.log_type}"
        raw_columns.append(raw)
        candidate = unclaimed & p.accepts(F.col("_text"))
        out = out.withColumn(raw, F.when(candidate, p.extract(F.col("_text"))))
        if p.refine:
            out = out.withColumn(raw, p.refine(F.col(raw)))
        matched = p.matched(F.col(raw))
        unclaimed = unclaimed & ~matched
        log_type = F.coalesce(log_type, F.when(matched, F.lit(p.log_type)))
    out = P.fence(out.withColumn("log_type", log_type), "log_type", *raw_columns)

    built = [
        F.when(F.col("log_type") == p.log_type, p.build(f"_raw_{p.log_type}")).alias(p.log_type)
        for p in parsers
    ]
    typed = out.select(*envelopes.columns, "log_type", *built)
    return typed.withColumn("hostname", F.coalesce(*[p.hostname(p.log_type) for p in parsers]))


def unparsed_lines(envelopes: DataFrame, parsers: ParserRegistry = DEFAULT_PARSERS) -> DataFrame:
    """Lines no parser takes, unchanged."""
    parsed = parse_lines(envelopes, parsers)
    return parsed.where(F.col("log_type").isNull()).select(*envelopes.columns)


def event_record(
    parsed: DataFrame, attrs: str = "windows", message: str = "message"
) -> DataFrame:
    """Windows attributes with envelope metadata and the fields of the message text.

    The envelope's ``src_ip`` and ``recv_time`` replace event keys of that name,
    and message fields replace both.
    """
    meta = F.create_map(
        F.lit("recv_time"), F.col("recv_time").cast("string"),
        F.lit("src_ip"), F.col("src_ip"),
    )
    staged = (
        parsed.withColumn("_meta", meta)
        .withColumn("_entries", P.message_entries(F.col(attrs)[message]))
        .withColumn("_fields", F.map_from_entries(P.distinct_entries(F.col("_entries"))))
        .withColumn("_attrs", P.merge_attrs(F.col(attrs), F.col("_meta")))
        .withColumn(attrs, P.merge_attrs(F.col("_attrs"), F.col("_fields")))
    )
    return staged.drop("_meta", "_entries", "_fields", "_attrs")


def canonical_events(events: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Canonical columns of Windows attributes, decided row by row."""
    a = F.col(attrs)
    names = list(dict.fromkeys(P.CANONICAL_FIELDS.values()))
    out = events.select("*", *[P.canonical_value(a, n).alias(n) for n in names])
    return (
        out.withColumn("parent_name", basename(F.col("parent")))
        .withColumn("process_name", F.coalesce(basename(F.col("name")), F.col("process_name")))
        .withColumn("process_basename", basename(F.col("process_name")))
    )


def resolve_envelope(records: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Defaults applied when a parsed record is stored.

    Takes ``hostname, source_ip, src_ip, log_source, log_type, raw_line, line,
    timestamp`` (text) and gives ``hostname, ip_address, log_source, content,
    recv_time``; a timestamp that does not fit the stored layout is replaced by
    the ingest time.
    """
    ingest = F.current_timestamp() if ingest_time is None else ingest_time

    def text(name: str) -> Column:
        return blank_to_null(F.col(name))

    keep = [c for c in records.columns if c not in ENVELOPE_FIELDS]
    return records.select(
        *keep,
        F.coalesce(F.col("hostname"), F.lit("unknown")).alias("hostname"),
        F.coalesce(text("source_ip"), F.col("src_ip"), F.lit("0.0.0.0")).alias("ip_address"),
        F.coalesce(text("log_source"), text("log_type"), F.lit("unknown")).alias("log_source"),
        F.coalesce(
            text("raw_line"),
            text("line"),
            F.to_json(F.struct(*[F.col(c) for c in ENVELOPE_FIELDS])),
        ).alias("content"),
        F.coalesce(P.stored_time(F.col("timestamp")), ingest).alias("recv_time"),
    )


ENVELOPE_FIELDS = [
    "hostname", "source_ip", "src_ip", "log_source", "log_type", "raw_line", "line", "timestamp",
]


def record_timestamp() -> Column:
    """Timestamp text carried by a parsed record of ``parse_lines``."""
    return (
        F.when(F.col("log_type") == "linux", F.col("linux.timestamp"))
        .when(F.col("log_type") == "nginx", F.date_format("nginx.timestamp", P.STORED_TIME))
        .when(F.col("log_type") == "windows", F.col("windows")["timestamp"])
        .when(F.col("log_type") == "zeek_conn", F.date_format("zeek_conn.ts", P.STORED_TIME))
    )


# ---- detail tables of stored logs -------------------------------------------

def extracted(logs: DataFrame, parser: LineParser, raw: str = "_raw") -> DataFrame:
    """Stored logs with the raw fields of their content, extracted once."""
    text = strip(F.col("content"))
    own = F.col("log_source") == parser.log_type
    out = logs.withColumn(raw, F.when(own, parser.extract(text)))
    if parser.refine:
        out = out.withColumn(raw, parser.refine(F.col(raw)))
    return P.fence(out, raw)


def _details(logs: DataFrame, parser: LineParser) -> DataFrame:
    own = logs.where(F.col("log_source") == parser.log_type)
    raw = extracted(own.select("id", "log_source", "content"), parser)
    return raw.where(parser.matched(F.col("_raw"))).select(
        F.col("id").alias("log_entry_id"), "content", parser.build("_raw").alias("d")
    )


def linux_details(logs: DataFrame) -> DataFrame:
    return _details(logs, LINUX).select("log_entry_id", "d.*")


def nginx_details(logs: DataFrame) -> DataFrame:
    return _details(logs, NGINX).select("log_entry_id", "d.*")


def conn_details(logs: DataFrame) -> DataFrame:
    return _details(logs, ZEEK_CONN).select("log_entry_id", "d.*")


def windows_details(logs: DataFrame) -> DataFrame:
    """Log id, the stored JSON text and its attributes."""
    return _details(logs, WINDOWS).withColumnRenamed("d", "attrs")


def ingest_counters(
    envelopes: DataFrame, parsers: ParserRegistry = DEFAULT_PARSERS, batch_size: int = 100
) -> DataFrame:
    """Received, parsed, saved, failed lines and the number of batches they fill."""
    parsed = parse_lines(envelopes, parsers)
    counts = parsed.agg(
        F.count("*").alias("received"),
        F.count("log_type").alias("parsed"),
        F.count("log_type").alias("saved"),
        F.count_if(F.col("log_type").isNull()).alias("errors"),
    )
    return counts.withColumn(
        "batches", F.ceil(F.col("saved") / F.lit(batch_size)).cast("bigint")
    )
