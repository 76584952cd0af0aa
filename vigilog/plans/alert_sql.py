"""The packaged rules written out by hand as SQL, for the side-by-side check."""

from __future__ import annotations

from vigilog.plans.fixtures import CTES, FOREIGN, _q
from vigilog.rules.pack import packaged_rows

# m: message, p: program, raw: whole line, all lower-cased.
LINUX_RULES = {
    "lin-ssh-failed":
        "p = 'sshd' AND (contains(m, 'failed password') OR contains(m, 'authentication failure'))",
    "lin-ssh-invalid-user": r"regexp_matches(m, 'invalid\s+user\s+\S+\s+from')",
    "lin-ssh-key-login": "p = 'sshd' AND starts_with(m, 'accepted publickey')",
    "lin-sudo-shell":
        "p = 'sudo' AND contains(m, 'user=root') AND (ends_with(m, '/bin/bash') "
        "OR ends_with(m, '/bin/sh') OR ends_with(m, '/bin/zsh'))",
    "lin-cron-root":
        "p IN ('cron', 'crond') AND regexp_matches(m, '^.*root.*cmd.*run-parts.*$') "
        "AND NOT contains(m, 'cron.daily')",
    "lin-session-any": "contains(m, 'started session') OR p = 'login'",
    "lin-tmp-exec":
        "contains(raw, 'pwd=/srv/jobs') OR contains(raw, 'pwd=/dev/shm') "
        "OR contains(raw, 'pwd=/var/tmp') OR contains(raw, '(deleted)') OR contains(raw, '/tmp/.') "
        "OR contains(raw, '/dev/shm/.') OR contains(raw, 'ld_preload=') "
        "OR contains(raw, 'base64 -d') OR contains(raw, 'mkfifo') OR contains(raw, 'nc -e')",
    "lin-fault-words":
        "contains(raw, 'segfault at') OR contains(raw, 'stack smashing detected') "
        "OR contains(raw, 'general protection fault') OR contains(raw, 'out of memory: kill')",
    "lin-unusual-program": "p NOT IN ('sshd', 'cron', 'systemd')",
    "lin-ssh-user-unlisted":
        "p = 'sshd' AND contains(m, 'failed') AND NOT coalesce(u IN ('u0', 'u1', 'u2'), false)",
    "lin-ioc-address": "a IN ('10.0.0.8', '10.0.0.12', '10.0.0.96')",
}

# e: event id, c: command, n: image, b: image name, pb: parent name, u: user, m: message.
WINDOWS_RULES = {
    "win-logon-failed": "e = '4625'",
    "win-logon-network":
        r"e IN ('4624', '4648') AND regexp_matches(m, 'logon type: (3|10)\b')",
    "win-encoded-command":
        "e = '4688' AND (contains(c, '-enc ') OR contains(c, '-encodedcommand') "
        "OR contains(c, 'frombase64string') OR contains(c, 'downloadstring') "
        "OR contains(c, 'iex(') OR contains(c, 'invoke-expression') OR contains(c, 'bypass') "
        "OR contains(c, 'hidden') OR contains(c, 'certutil') OR contains(c, 'bitsadmin') "
        "OR contains(c, 'mshta'))",
    "win-shadow-delete": "regexp_matches(c, '^.*vssadmin.*delete.*shadows.*$')",
    "win-console-start": "b = 'cmd.exe' AND starts_with(pb, 'win')",
    "win-host-in-temp": r"b IN ('svchost.exe', 'csrss.exe') AND contains(n, '\temp\')",
    "win-temp-image":
        r"(contains(n, '\temp\') OR contains(n, '\appdata\local\') OR contains(n, '\downloads\')) "
        "AND ends_with(n, '.exe')",
    "win-user-unlisted": "e = '4624' AND u NOT IN ('u0', 'u1', 'u2', 'u3')",
    "win-channel": "e = '4688' AND ch = 'security' AND NOT starts_with(c, 'powershell')",
    "win-any-of-maps": "b = 'cmd.exe' OR contains(c, 'vssadmin')",
}

# r: request, p: path, a: agent, s: status, f: referer, z: bytes, v: method.
NGINX_RULES = {
    "web-markup-query":
        "contains(r, '<object') OR contains(r, '%3cobject') OR contains(r, '<embed') "
        "OR contains(r, 'vbscript:') OR contains(r, 'srcdoc=') OR contains(r, 'onpointerover=') "
        "OR contains(r, '<marquee') OR contains(r, '<math') OR contains(r, 'formaction=')",
    "web-path-climb":
        "contains(p, '../') OR contains(p, '..%2f') OR contains(p, '/etc/passwd') "
        "OR contains(p, 'win.ini')",
    "web-sql-injection":
        "contains(r, ''' or ''') OR contains(r, 'union select') OR contains(r, 'sleep(') "
        "OR contains(r, 'information_schema') OR contains(r, 'drop table')",
    "web-probe-agent": "regexp_matches(a, '^(sqlmap|wfuzz)/[0-9.]+')",
    "web-login-refused": "ends_with(p, '/login') AND s IN (401, 403) AND v <> 'put'",
    "web-lookup-redirect": "contains(p, '/lookup') AND s = 302",
    "web-blind-write": "v IN ('put', 'patch') AND (f IS NULL OR f IN ('', '-'))",
    "web-large-reply": "z >= 10000",
    "web-server-error": "starts_with(CAST(s AS VARCHAR), '5')",
    "web-admin-method": "v = 'put' AND starts_with(p, '/admin/')",
}


def _union(rules: dict[str, str], view: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {_q(rule)} AS rule_id, log_entry_id FROM {view} WHERE {cond}"
        for rule, cond in rules.items()
    )


_TEXTS = ", ".join(
    f"({_q(r['id'])}, {_q(r['title'])}, {_q(r['description'])}, {_q(r['level'])})"
    for r in packaged_rows()
)

CTES["linux_low"] = """
SELECT d.log_entry_id, lower(d.raw_message) AS m, lower(d.app_name) AS p, lower(l.content) AS raw,
  lower(d.ssh_user) AS u, lower(d.ssh_ip) AS a
FROM linux_d d JOIN log_entry l ON l.id = d.log_entry_id"""
CTES["windows_low"] = r"""
SELECT log_entry_id, json_extract_string(x, '$.event_id') AS e,
  lower(json_extract_string(x, '$.CommandLine')) AS c,
  lower(json_extract_string(x, '$.NewProcessName')) AS n,
  lower(string_split(json_extract_string(x, '$.NewProcessName'), '\')[-1]) AS b,
  lower(string_split(json_extract_string(x, '$.ParentProcessName'), '\')[-1]) AS pb,
  lower(json_extract_string(x, '$.TargetUserName')) AS u,
  lower(json_extract_string(x, '$.message')) AS m,
  lower(json_extract_string(x, '$.channel')) AS ch
FROM (SELECT log_entry_id, CAST(content AS JSON) AS x FROM windows_d)"""
CTES["nginx_low"] = """
SELECT log_entry_id,
  lower(request_method || ' ' || request_uri || ' ' || server_protocol) AS r,
  lower(request_uri) AS p, lower(http_user_agent) AS a, status AS s, http_referer AS f,
  body_bytes_sent AS z, lower(request_method) AS v FROM nginx_d"""
CTES["rule_text"] = (
    f"SELECT * FROM (VALUES {_TEXTS}) AS v(rule_id, title, description, severity)"
)
CTES["rule_hit"] = "\nUNION ALL ".join(
    [
        _union(LINUX_RULES, "linux_low"),
        _union(WINDOWS_RULES, "windows_low"),
        _union(NGINX_RULES, "nginx_low"),
    ]
)
CTES["alert"] = """
SELECT h.rule_id || '_' || l.id AS alert_id, l.id AS log_entry_id, l.server_id, l.log_source,
  h.rule_id, t.severity, t.title, t.description, l.recv_time AS triggered_at,
  l.id % 3 = 0 AS resolved
FROM rule_hit h JOIN rule_text t USING (rule_id) JOIN log_entry l ON l.id = h.log_entry_id"""
CTES["foreign_alert"] = f"""
SELECT * REPLACE (CASE WHEN log_entry_id % 7 = 0 THEN server_id + {FOREIGN} ELSE server_id END
  AS server_id) FROM alert"""
CTES["alert_text"] = """
SELECT a.*, substr(l.content, 1, 500) AS raw_line,
  coalesce(d.raw_message, json_extract_string(w.content, '$.message')) AS message
FROM alert a JOIN log_entry l ON l.id = a.log_entry_id
LEFT JOIN linux_d d ON d.log_entry_id = l.id LEFT JOIN windows_d w ON w.log_entry_id = l.id"""
