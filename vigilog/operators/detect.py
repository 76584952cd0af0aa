"""Logs against rules: one pass over the logs, one array of matches per log."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import parsers as P
from vigilog.functions.text import strip
from vigilog.operators import ingest
from vigilog.rules.compiler import (
    FIELD_MAP,
    Fields,
    RuleCompiler,
    counting_of,
    plain_part,
    fields_of,
    quoted,
)
from vigilog.rules.pack import Rule

RAW_LINE_LENGTH = 500
RAW_FIELD = "'raw', lower(content)"


# SQL of the fields a stored log offers to rules, by source.
COMPAT_FIELDS = {
    "linux": {
        "program": "linux.app_name",
        "message": "linux.raw_message",
        "pid": "CAST(linux.pid AS STRING)",
    },
    "nginx": {
        "method": "nginx.request_method",
        "path": "nginx.request_uri",
        "status_code": "CAST(nginx.status AS STRING)",
        "bytes": "CAST(nginx.body_bytes_sent AS STRING)",
        "user_agent": "nginx.http_user_agent",
        "remote_addr": "nginx.remote_addr",
        "referer": "nginx.http_referer",
    },
    "windows": {
        "channel": "coalesce(windows['channel'], windows['LogName'])",
        "event_id": "coalesce(windows['event_id'], windows['EventID'])",
        "message": "windows['message']",
        "user_name": "windows['TargetUserName']",
    },
}


def _canonical(name: str) -> str:
    events_names = [old for old, new in P.CANONICAL_FIELDS.items() if new == name]
    return f"coalesce({', '.join(f'windows[{n!r}]' for n in [name, *events_names])})"


def _basename(text: str) -> str:
    return f"substring_index({text}, {quoted(chr(92))}, -1)"


_PROCESS = f"coalesce({_basename(_canonical('name'))}, {_basename(_canonical('process_name'))})"

# Further names that intent mode understands.
INTENT_FIELDS = {
    "linux": {
        "name": "linux.app_name",
        "process": "linux.app_name",
        "cmdline": "linux.raw_message",
        "user": "linux.ssh_user",
        "ssh_user": "linux.ssh_user",
        "ssh_ip": "linux.ssh_ip",
        "source_ip": "linux.ssh_ip",
        "remote_address": "linux.ssh_ip",
    },
    "nginx": {
        "request": "nginx.request_method || ' ' || nginx.request_uri || ' ' "
        "|| nginx.server_protocol",
        "status": "CAST(nginx.status AS STRING)",
        "responsecode": "CAST(nginx.status AS STRING)",
        "bytessent": "CAST(nginx.body_bytes_sent AS STRING)",
        "requestmethod": "nginx.request_method",
    },
    "windows": {
        "name": _PROCESS,
        "process": _PROCESS,
        "process_name": _PROCESS,
        "exe": _canonical("name"),
        "parent": _basename(_canonical("parent")),
        "parent_process_name": _basename(_canonical("parent")),
        "cmdline": _canonical("cmdline"),
        "command_line": _canonical("cmdline"),
        "user": _canonical("user"),
    },
}


VIEW_PARSERS = (ingest.LINUX, ingest.NGINX, ingest.WINDOWS)


def parsed_view(logs: DataFrame) -> DataFrame:
    """Stored logs with the record of their own type: ``linux``, ``nginx``, ``windows``."""
    out = logs
    text = strip(F.col("content"))
    for p in VIEW_PARSERS:
        raw = f"_raw_{p.log_type}"
        out = out.withColumn(raw, F.when(F.col("log_source") == p.log_type, p.extract(text)))
        if p.refine:
            out = out.withColumn(raw, p.refine(F.col(raw)))
    out = P.fence(out, *[f"_raw_{p.log_type}" for p in VIEW_PARSERS])

    def record(p: ingest.LineParser) -> Column:
        raw = f"_raw_{p.log_type}"
        return F.when(p.matched(F.col(raw)), p.build(raw)).alias(p.log_type)

    return out.select(*logs.columns, *[record(p) for p in VIEW_PARSERS])


def field_sql(source: str, name: str, mode: str) -> str:
    """The field's own text: its column, else the event attribute of that name."""
    values = dict(COMPAT_FIELDS[source], hostname="hostname", ip_address="ip_address")
    if mode == "intent":
        values.update(INTENT_FIELDS[source])
    found = values.get(name)
    if source == "windows":
        attribute = f"windows[{quoted(name)}]"
        return attribute if found is None else f"coalesce({found}, {attribute})"
    return "CAST(NULL AS STRING)" if found is None else found


def row_rules(rules: Sequence[Rule], mode: str) -> list[Rule]:
    """Enabled rules decided on one row; what counts is left to ``correlate``."""
    active = [r for r in rules if r.enabled and r.log_source in FIELD_MAP]
    if mode == "compat":
        return active
    plain = [r if counting_of(r) is None else plain_part(r) for r in active]
    return [r for r in plain if r is not None]


def with_fields(view: DataFrame, rules: Sequence[Rule], mode: str) -> DataFrame:
    """Add the lower-cased fields the rules read, each computed once per row.

    The fields of a source live in one struct that is null for other sources.
    """
    sources = dict.fromkeys(r.log_source for r in rules)
    return with_named_fields(view, {s: fields_of(r for r in rules if r.log_source == s) for s in sources}, mode)


def with_named_fields(view: DataFrame, names_of: dict[str, Sequence[str]], mode: str) -> DataFrame:
    """``with_fields`` for the named fields of each source."""
    columns = []
    for source, names in names_of.items():
        fields = [
            f"'f{i}', lower({field_sql(source, name, mode)})" for i, name in enumerate(names)
        ]
        struct = f"named_struct({', '.join([*fields, RAW_FIELD])})"
        columns.append(
            F.expr(f"CASE WHEN log_source = '{source}' THEN {struct} END").alias(f"_f_{source}")
        )
    return view.select("*", *columns)


def rule_sql(rule: Rule, rules: Sequence[Rule], mode: str = "intent") -> str:
    """The rule as a condition over ``with_fields(view, rules, mode)``."""
    names = fields_of(r for r in rules if r.log_source == rule.log_source)
    struct = f"_f_{rule.log_source}"
    positions = {name: f"{struct}.f{i}" for i, name in enumerate(names)}
    return RuleCompiler(rule, Fields(positions.__getitem__, f"{struct}.raw"), mode).condition()


def matching_logs(logs: DataFrame, rule: Rule, mode: str = "intent") -> DataFrame:
    """Logs that satisfy one rule."""
    kept = [c for c in logs.columns]
    view = with_fields(_with_host(parsed_view(logs)), [rule], mode)
    own = view.where(F.col("log_source") == rule.log_source)
    return own.where(rule_sql(rule, [rule], mode)).select(*kept)


def _with_host(view: DataFrame) -> DataFrame:
    for name in ("hostname", "ip_address"):
        if name not in view.columns:
            view = view.withColumn(name, F.lit(None).cast("string"))
    return view


def matched_rules(view: DataFrame, rules: Sequence[Rule], mode: str) -> DataFrame:
    """Rows with the positions of the matching rules, an empty array for none."""
    branches = []
    for source in dict.fromkeys(r.log_source for r in rules):
        hits = [
            f"CASE WHEN {rule_sql(rule, rules, mode)} THEN {i} END"
            for i, rule in enumerate(rules)
            if rule.log_source == source
        ]
        branches.append(f"WHEN '{source}' THEN array_compact(array({', '.join(hits)}))")
    by_source = F.expr(f"CASE log_source {' '.join(branches)} END")
    return with_fields(view, rules, mode).select(*view.columns, by_source.alias("_hits"))


def run_rules(
    logs: DataFrame,
    rules: Sequence[Rule],
    mode: str = "intent",
) -> DataFrame:
    """One alert row per matching (log, rule) of the same source.

    Nothing is shuffled: every log is read once, tested against the rules of its
    source, and its matches are exploded. Rule texts come from a constant array.
    ``logs`` may carry ``hostname`` and ``ip_address``; streams are accepted.
    """
    active = row_rules(rules, mode)
    view = _with_host(parsed_view(logs))
    if not active:
        return build_alerts(
            view.where(F.lit(False)).withColumn("_rule", F.lit(0)), [_NO_RULE]
        )
    found = matched_rules(view, active, mode)
    # The outer form keeps the match conditions out of the filters below it.
    exploded = found.select(*view.columns, F.explode_outer("_hits").alias("_rule"))
    return build_alerts(exploded.where(F.col("_rule").isNotNull()), active)


_NO_RULE = Rule("", "", "", "", "", "", {})


def matched_fields() -> Column:
    """JSON of the common fields present in the log."""
    return F.expr(f"""to_json(named_struct(
        'timestamp', date_format(recv_time, '{P.STORED_TIME}'),
        'hostname', hostname,
        'program', linux.app_name,
        'message', coalesce(linux.raw_message, windows['message']),
        'event_id', coalesce(windows['event_id'], windows['EventID']),
        'channel', coalesce(windows['channel'], windows['LogName']),
        'method', nginx.request_method,
        'path', nginx.request_uri,
        'status_code', nginx.status))""")


def alert_key(rule_id: Column, log_id: Column) -> Column:
    return F.concat_ws("_", rule_id, F.coalesce(log_id.cast("string"), F.lit("unknown")))


def build_alerts(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alert rows of (log, rule position) matches."""
    texts = rule_constants(
        rules,
        "id string, title string, description string, level string, "
        "falsepositives array<string>, references array<string>",
    )
    return alert_rows(matches, F.get(texts, F.col("_rule")))


def alert_rows(matches: DataFrame, rule: Column) -> DataFrame:
    """Alert rows of matches; ``rule`` is a struct of the texts of the rule that is met."""
    return matches.select(
        alert_key(rule["id"], F.col("id")).alias("alert_id"),
        rule["id"].alias("rule_id"),
        rule["title"].alias("title"),
        rule["description"].alias("description"),
        rule["level"].alias("severity"),
        F.col("id").alias("log_entry_id"),
        "server_id",
        "log_source",
        "recv_time",
        "hostname",
        "ip_address",
        F.substring("content", 1, RAW_LINE_LENGTH).alias("raw_line"),
        matched_fields().alias("matched_fields"),
        rule["falsepositives"].alias("false_positives"),
        rule["references"].alias("references"),
    )


def rule_constants(rules: Sequence[Rule], schema: str) -> Column:
    """The rules' texts as one constant array, in rule order."""
    rows = json.dumps([vars(rule) for rule in rules])
    return F.from_json(F.lit(rows), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")


def alert_metadata(alerts: DataFrame) -> Column:
    """Metadata JSON of an alert row."""
    names = [
        "alert_id", "log_source", "hostname", "ip_address", "raw_line",
        "matched_fields", "false_positives", "references",
    ]
    return F.to_json(F.struct(*[F.col(n) for n in names if n in alerts.columns]))


def metadata_fields(metadata: Column) -> Column:
    """Decoded metadata; an empty map for text that is not a JSON object."""
    decoded = F.from_json(metadata, "map<string,string>", {"allowSingleQuotes": "false"})
    return F.coalesce(decoded, F.create_map().cast("map<string,string>"))


def dedupe_alerts(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Insert-or-ignore on ``alert_id``: the earliest copy of each alert not yet stored.

    Copies are combined before the shuffle, so an alert delivered very often is
    no larger than any other when it is grouped.
    """
    rest = [c for c in new.columns if c != "alert_id"]
    first = F.min_by(F.struct(*rest), F.struct("recv_time", "log_entry_id")).alias("row")
    unique = new.groupBy("alert_id").agg(first).select("alert_id", "row.*")
    if stored is not None:
        unique = unique.join(stored.select("alert_id"), "alert_id", "left_anti")
    return unique.select(*new.columns)


def match_indicators(logs: DataFrame, address: str, indicators: DataFrame) -> DataFrame:
    """Logs whose ``address`` is on an indicator list.

    The list may be of any size: the planner broadcasts it below its size limit
    and shuffles both sides beyond it.
    """
    listed = indicators.select(F.col("address").alias(address)).distinct()
    return logs.join(listed, address, "left_semi")


def latest(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``key`` in the given order.

    A rank bounded by a constant is applied before the shuffle as well, so a large
    key sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)
