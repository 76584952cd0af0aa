"""Queries of rules and correlation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vigilog.operators import correlate, detect, rule_index
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.fixtures import Tables
from vigilog.rules import pack
from vigilog.rules.pack import Rule
from vigilog.session import shared_dir


def one_rule(source: str, selection, condition: str = "selection", **blocks) -> Rule:
    detection = {"selection": selection, **blocks, "condition": condition}
    return Rule("one", "One rule", "", "medium", "stable", source, detection)


def matches(t: Tables, rule: Rule, mode: str = "intent"):
    return detect.matching_logs(t.logs, rule, mode).select("id")


# Rule rows are tied to the logs they are run on, so the result grows with the logs.
@query(
    "load_rule_table",
    sql="""
SELECT t.rule_id, t.title, t.severity AS level, count(h.log_entry_id) AS alerts
FROM rule_text t LEFT JOIN rule_hit h USING (rule_id) GROUP BY ALL""",
)
def load_rule_table(t: Tables):
    per_rule = t.alerts.groupBy("rule_id").agg(F.count("*").alias("n"))
    path = shared_dir(t.spark, "rules")
    rows = [json.dumps(r) for r in [*pack.packaged_rows(), {"id": "no-detection"}]]
    t.spark.createDataFrame([(r,) for r in rows], "value string").write.text(f"{path}/linux")
    table = pack.read_rules(t.spark, path).withColumnRenamed("id", "rule_id")
    return table.join(per_rule, "rule_id", "left").select(
        "rule_id", "title", "level", F.coalesce("n", F.lit(0)).alias("alerts")
    )


@query(
    "rule_inventory",
    sql="""
WITH n AS (SELECT log_source, count(*) AS logs FROM log_entry GROUP BY log_source)
SELECT v.log_source, v.level, v.enabled, v.rules, n.logs FROM (SELECT
  CASE WHEN starts_with(rule_id, 'lin-') THEN 'linux' WHEN starts_with(rule_id, 'win-')
    THEN 'windows' ELSE 'nginx' END AS log_source, severity AS level,
  rule_id <> 'lin-old-rule' AS enabled, count(*) AS rules FROM rule_text GROUP BY ALL) v
JOIN n ON n.log_source = v.log_source""",
)
def rule_inventory(t: Tables):
    per_source = t.logs.groupBy("log_source").agg(F.count("*").alias("logs"))
    return pack.rule_inventory(pack.rules_frame(t.spark)).join(per_source, "log_source")


@query("match_exact", sql="SELECT log_entry_id AS id FROM windows_low WHERE e = '4625'")
def match_exact(t: Tables):
    return matches(t, one_rule("windows", {"EventID": 4625}))


@query(
    "match_wildcard",
    sql=r"SELECT log_entry_id AS id FROM nginx_low WHERE regexp_matches(p, '^/lo.*=.*object>$')",
)
def match_wildcard(t: Tables):
    return matches(t, one_rule("nginx", {"Url": "/LO*=*object>"}))


@query(
    "match_contains",
    sql="SELECT log_entry_id AS id FROM nginx_low WHERE contains(p, 'etc/passwd')",
)
def match_contains(t: Tables):
    return matches(t, one_rule("nginx", {"Url|contains": "ETC/passwd"}))


@query(
    "match_startswith",
    sql="SELECT log_entry_id AS id FROM linux_low WHERE starts_with(m, 'accepted')",
)
def match_startswith(t: Tables):
    return matches(t, one_rule("linux", {"Message|startswith": "Accepted"}))


@query(
    "match_endswith",
    sql="SELECT log_entry_id AS id FROM linux_low WHERE ends_with(m, 'cron.hourly)')",
)
def match_endswith(t: Tables):
    return matches(t, one_rule("linux", {"Message|endswith": "cron.hourly)"}))


@query(
    "match_regex",
    sql=r"""
SELECT log_entry_id AS id FROM linux_low
WHERE regexp_matches(m, 'from \d+\.\d+\.\d+\.\d*[02468] port')""",
)
def match_regex(t: Tables):
    bad = {"Message|re": "((("}
    rule = one_rule(
        "linux", [{"Message|re": r"From \d+\.\d+\.\d+\.\d*[02468] PORT"}, bad]
    )
    return matches(t, rule)


@query(
    "match_value_list",
    sql="""
SELECT log_entry_id AS id FROM nginx_low WHERE (v IN ('put', 'post') AND s IN (401, 403))
  OR contains(a, 'sqlmap')""",
)
def match_value_list(t: Tables):
    maps = [
        {"RequestMethod": ["PUT", "POST"], "StatusCode": [401, 403]},
        {"UserAgent|contains": ["sqlmap", "nikto"]},
    ]
    return matches(t, one_rule("nginx", maps))


# In compat mode the chain is column, event attribute, raw line, empty text.
@query(
    "resolve_rule_field",
    sql="""
SELECT log_entry_id AS id FROM windows_low w
WHERE starts_with(c, 'powershell')
   OR EXISTS (SELECT 1 FROM log_entry l WHERE l.id = w.log_entry_id
              AND contains(lower(l.content), '"commandline":"vssadmin'))""",
)
def resolve_rule_field(t: Tables):
    by_attribute = {"CommandLine|startswith": "powershell"}
    by_raw_line = {"NoSuchField|contains": '"CommandLine":"vssadmin'}
    intent = one_rule("windows", [by_attribute])
    compat = one_rule("windows", [by_raw_line])
    return matches(t, intent).unionByName(matches(t, compat, "compat"))


@query(
    "eval_condition",
    sql="""
SELECT log_entry_id AS id, 'a and b and not c' AS condition FROM linux_low
  WHERE p = 'sshd' AND contains(m, 'failed') AND NOT contains(m, 'user u3')
UNION ALL SELECT log_entry_id, 'a or d' FROM linux_low WHERE p = 'sshd' OR p = 'sudo'
UNION ALL SELECT log_entry_id, 'a and b' FROM linux_low WHERE p = 'sshd' AND contains(m, 'failed')
UNION ALL SELECT log_entry_id, 'd and not missing' FROM linux_low WHERE p = 'sudo'""",
)
def eval_condition(t: Tables):
    blocks = {
        "a": {"ProcessName": "sshd"},
        "b": {"Message|contains": "failed"},
        "c": {"Message|contains": "user u3"},
        "d": {"ProcessName": "sudo"},
    }
    texts = [
        "a and b and not c", "a or d", "a and b", "d and not missing", "1 of a", "(a and b)",
        "missing",
    ]
    rules = [
        Rule(c, c, "", "low", "stable", "linux", {**blocks, "condition": c}) for c in texts
    ]
    return detect.run_rules(t.logs, rules).select(
        F.col("log_entry_id").alias("id"), F.col("rule_id").alias("condition")
    )


@query(
    "eval_condition_compat",
    sql="""
SELECT log_entry_id AS id, 'd and not missing' AS condition FROM linux_low WHERE p = 'sudo'
UNION ALL SELECT log_entry_id, 'a or d' FROM linux_low WHERE p = 'sshd' OR p = 'sudo'
UNION ALL SELECT log_entry_id, 'selection' FROM linux_low WHERE contains(raw, ':')""",
)
def eval_condition_compat(t: Tables):
    blocks = {
        "selection": {"remote_ip|contains": ":"},
        "a": {"ProcessName": "sshd"},
        "b": {"Message|contains": "failed"},
        "d": {"ProcessName": "sudo"},
        "keywords": ["sudo"],
    }
    texts = ["a and b and not c", "d and not missing", "a or d", "keywords", "selection"]
    rules = [
        Rule(c, c, "", "low", "stable", "linux", {**blocks, "condition": c}) for c in texts
    ]
    return detect.run_rules(t.logs, rules, "compat").select(
        F.col("log_entry_id").alias("id"), F.col("rule_id").alias("condition")
    )


@query(
    "match_keywords",
    sql="""
SELECT log_entry_id AS id FROM linux_low
WHERE contains(raw, 'pwd=/tmp') OR contains(raw, 'cron.hourly') OR contains(raw, 'segfault at')""",
)
def match_keywords(t: Tables):
    rule = one_rule(
        "linux", {}, "keywords", keywords=["PWD=/tmp", "cron.hourly", "segfault at"]
    )
    return matches(t, rule)


@query(
    "match_in_notin",
    sql="""
SELECT log_entry_id AS id FROM windows_low WHERE b IN ('svchost.exe', 'explorer.exe')
  AND pb NOT IN ('services.exe', 'wininit.exe')""",
)
def match_in_notin(t: Tables):
    selection = {
        "name|in": ["svchost.exe", "explorer.exe"],
        "parent|not_in": ["services.exe", "wininit.exe"],
    }
    return matches(t, one_rule("windows", selection))


@query("match_gte", sql="SELECT log_entry_id AS id FROM nginx_low WHERE z >= 5000")
def match_gte(t: Tables):
    return matches(t, one_rule("nginx", {"BytesSent|gte": 5000}))


@query(
    "match_empty",
    sql="""
SELECT log_entry_id AS id FROM nginx_low
WHERE v IN ('post', 'put') AND (f IS NULL OR f IN ('', '-'))""",
)
def match_empty(t: Tables):
    selection = {"RequestMethod": ["POST", "PUT"], "Referer|empty": True}
    return matches(t, one_rule("nginx", selection))


# The indicator list is derived from the servers, so it grows with the data.
@query(
    "match_ioc_ip",
    sql="""
SELECT log_entry_id, orig_h, resp_h FROM conn_d
WHERE orig_h IN (SELECT ip_address FROM server WHERE hostname LIKE '%7')""",
)
def match_ioc_ip(t: Tables):
    listed = t.servers.where(F.col("hostname").endswith("7")).select(
        F.col("ip_address").alias("address")
    )
    return detect.match_indicators(t.conns, "orig_h", listed).select(
        "log_entry_id", "orig_h", "resp_h"
    )


@query("run_rules", sql="SELECT log_entry_id, rule_id, severity FROM alert")
def run_rules(t: Tables):
    return detect.run_rules(t.logs, t.rules).select("log_entry_id", "rule_id", "severity")


# The rules besides are indicators of this table's parts: names that no line holds.
@query("run_indexed_rules", sql="SELECT log_entry_id, rule_id, severity FROM alert")
def run_indexed_rules(t: Tables):
    name, source = F.coalesce("p_name", F.lit("None")), F.col("log_source")
    text = F.concat(F.lit("part "), name, F.lit(" "), source)
    none = F.array().cast("array<string>")
    more = (
        t.read("part")
        .select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, ("linux", "windows", "nginx")))).alias("log_source"))
        .select(
            F.concat(F.lit("part-"), F.coalesce(F.col("p_partkey").cast("string"), F.lit("None"))).alias("id"),
            F.lit("").alias("title"), F.lit("").alias("description"), F.lit("low").alias("level"),
            F.lit("stable").alias("status"), "log_source", F.lit(True).alias("enabled"),
            F.lit(False).alias("require_fields"), none.alias("falsepositives"), none.alias("references"),
            F.lit("Unknown").alias("author"),
            F.to_json(F.struct(F.struct(text.alias("Message|contains")).alias("selection"))).alias("detection"),
        )
    )
    found = rule_index.run_rules(t.logs, t.rules, table=more)
    return found.select("log_entry_id", "rule_id", "severity")


@query(
    "build_alerts",
    sql=f"""
SELECT a.alert_id, a.title, a.description, a.severity, a.log_entry_id, a.server_id, s.hostname,
  s.ip_address, a.raw_line, a.message, {sql_time("a.triggered_at")} AS recv_time
FROM alert_text a JOIN server s ON s.id = a.server_id""",
)
def build_alerts(t: Tables):
    named = t.logs.join(
        t.servers.select(F.col("id").alias("server_id"), "hostname", "ip_address"), "server_id"
    )
    return detect.run_rules(named, t.rules).select(
        "alert_id", "title", "description", "severity", "log_entry_id", "server_id", "hostname",
        "ip_address", "raw_line",
        F.get_json_object("matched_fields", "$.message").alias("message"), "recv_time",
    )


@query(
    "dedupe_alerts",
    sql=f"""
SELECT alert_id, log_entry_id, rule_id, {sql_time("triggered_at")} AS recv_time FROM alert
WHERE triggered_at >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def dedupe_alerts(t: Tables):
    found = detect.run_rules(t.logs, t.rules).select(
        "alert_id", "log_entry_id", "rule_id", "recv_time"
    )
    again = found.withColumn("recv_time", F.col("recv_time") + F.expr("INTERVAL 1 HOUR"))
    stored = found.where(F.col("recv_time") < F.lit("2024-01-10").cast("timestamp"))
    return detect.dedupe_alerts(found.unionByName(again), stored)


DAY = f"{sql_time("date_trunc('day', l.recv_time)")} AS window_start"
#: Matching rows of the packaged counting rules: rule, severity, group, counted value, log.
COUNTED = """
SELECT 'web-item-rush' AS rule_id, 'medium' AS severity, remote_addr AS source,
  NULL AS value, log_entry_id FROM nginx_low JOIN nginx_d USING (log_entry_id)
  WHERE starts_with(p, '/api/items') OR starts_with(p, '/lookup')
UNION ALL SELECT 'web-flood', 'medium', remote_addr, NULL, log_entry_id FROM nginx_d
UNION ALL SELECT 'web-heavy-client', 'high', remote_addr, NULL, log_entry_id
  FROM nginx_low JOIN nginx_d USING (log_entry_id) WHERE starts_with(p, '/api') AND z >= 5000
UNION ALL SELECT 'lin-sshd-volume', 'low', CAST(server_id AS VARCHAR), NULL, log_entry_id
  FROM linux_d JOIN log_entry l ON l.id = log_entry_id WHERE lower(app_name) = 'sshd'
UNION ALL SELECT 'lin-user-spread', 'low', ssh_user, CAST(server_id AS VARCHAR), log_entry_id
  FROM linux_d JOIN log_entry l ON l.id = log_entry_id WHERE ssh_user IS NOT NULL
UNION ALL SELECT 'web-agent-mix', 'low', CAST(server_id AS VARCHAR), http_user_agent, log_entry_id
  FROM nginx_low JOIN nginx_d USING (log_entry_id) JOIN log_entry l ON l.id = log_entry_id
  WHERE contains(p, '/')"""


THRESHOLD_SQL = f"""
SELECT rule_id, severity, source, window_start,
  CASE WHEN rule_id IN ('lin-user-spread', 'web-agent-mix') THEN d ELSE n END AS matches
FROM (SELECT rule_id, severity, c.source, {DAY}, count(*) AS n, count(DISTINCT value) AS d
  FROM ({COUNTED}) c JOIN log_entry l ON l.id = c.log_entry_id GROUP BY ALL) WHERE matches >= 3"""


# The data is thin: at most a few requests per address and day.
@query("threshold_rule", sql=THRESHOLD_SQL)
def threshold_rule(t: Tables):
    return correlate.threshold_alerts(t.logs, t.rules, timeframe="1d", least=3)


def counting_rule(source: str, selection: dict, frame: str = "1d", **aggregation) -> Rule:
    """A rule that counts by its own window and limit."""
    block = {"aggregation": {"timeframe": frame, **aggregation}} if aggregation else {}
    named = "selection and aggregation" if aggregation else "selection"
    return one_rule(source, selection, named, **block)


# The window and the limit are the rule's own.
@query(
    "threshold_rule_own_limits",
    sql=f"""
SELECT 'one' AS rule_id, 'medium' AS severity, remote_addr AS source, {DAY}, count(*) AS matches
FROM nginx_d JOIN log_entry l ON l.id = log_entry_id
WHERE request_method = 'GET' GROUP BY ALL HAVING count(*) >= 2""",
)
def threshold_rule_own_limits(t: Tables):
    rule = counting_rule("nginx", {"RequestMethod": "GET"}, **{"SourceIp|count": ">=2"})
    return correlate.threshold_alerts(t.logs, [rule])


@query(
    "count_rule",
    sql=f"""
SELECT 'one' AS rule_id, 'medium' AS severity, CAST(server_id AS VARCHAR) AS source, {DAY},
  count(*) AS matches FROM linux_d JOIN log_entry l ON l.id = log_entry_id
WHERE app_name = 'sshd' GROUP BY ALL HAVING count(*) >= 2""",
)
def count_rule(t: Tables):
    rule = counting_rule("linux", {"ProcessName": "sshd", "count|gte": 2})
    return correlate.threshold_alerts(t.logs, [rule], timeframe="1d")


# Two counts that must both be met, or many requests of one kind.
@query(
    "joined_count_rule",
    sql=f"""
WITH r AS (SELECT CAST(server_id AS VARCHAR) AS source, {DAY}, request_uri, request_method
  FROM nginx_d JOIN log_entry l ON l.id = log_entry_id)
SELECT 'one' AS rule_id, 'medium' AS severity, source, window_start, max(matches) AS matches FROM (
  SELECT source, window_start, count(*) AS matches FROM r WHERE request_method = 'GET' GROUP BY ALL
    HAVING count(*) >= 2 AND count(DISTINCT request_uri) BETWEEN 1 AND 3
  UNION ALL
  SELECT source, window_start, count(*) FROM r WHERE request_method = 'POST' GROUP BY ALL
    HAVING count(*) = 1 OR count(*) > 2) GROUP BY ALL""",
)
def joined_count_rule(t: Tables):
    rule = one_rule(
        "nginx",
        {"RequestMethod": "GET", "count|gte": [50, 2], "Url|count|gte": "<=3"},
        "selection or posts and aggregation",
        posts={"RequestMethod": "POST", "count|gte": ["=1", ">2"]},
        aggregation={"timeframe": "1d"},
    )
    return correlate.threshold_alerts(t.logs, [rule])


@query(
    "distinct_count_rule",
    sql=f"""
SELECT 'one' AS rule_id, 'medium' AS severity, CAST(server_id AS VARCHAR) AS source, {DAY},
  count(DISTINCT request_uri) AS matches FROM nginx_d JOIN log_entry l ON l.id = log_entry_id
WHERE contains(http_user_agent, 'Mozilla') GROUP BY ALL HAVING count(DISTINCT request_uri) >= 2""",
)
def distinct_count_rule(t: Tables):
    rule = counting_rule("nginx", {"UserAgent|contains": "mozilla", "Url|count|gte": 2})
    return correlate.threshold_alerts(t.logs, [rule], timeframe="1d")


@query(
    "duplicate_key_rule",
    sql=f"""
SELECT 'one' AS rule_id, 'medium' AS severity, ssh_user AS source, {DAY},
  count(DISTINCT server_id) AS matches FROM linux_d JOIN log_entry l ON l.id = log_entry_id
WHERE ssh_user IS NOT NULL GROUP BY ALL HAVING count(DISTINCT server_id) >= 2""",
)
def duplicate_key_rule(t: Tables):
    rule = counting_rule("linux", {"ssh_user|duplicate": True})
    return correlate.threshold_alerts(t.logs, [rule], timeframe="1d")


BRUTE_FORCE_SQL = f"""
SELECT log_entry_id, ssh_ip, {sql_time("recv_time")} AS recv_time, recent FROM (
  SELECT d.log_entry_id, d.ssh_ip, l.recv_time, count(*) OVER (PARTITION BY d.ssh_ip
    ORDER BY CAST(floor(epoch(l.recv_time)) AS BIGINT)
    RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent
  FROM linux_d d JOIN log_entry l ON l.id = d.log_entry_id
  WHERE contains(lower(l.content), 'failed password')) WHERE recent > 2"""


@query("brute_force_sliding", sql=BRUTE_FORCE_SQL)
def brute_force_sliding(t: Tables):
    failed = detect.parsed_view(correlate.failed_password_lines(t.logs))
    failures = failed.where("linux IS NOT NULL").select(
        F.col("id").alias("log_entry_id"), "recv_time", F.col("linux.ssh_ip").alias("ssh_ip")
    )
    return correlate.brute_force(failures, "ssh_ip", seconds=86400, limit=2)
