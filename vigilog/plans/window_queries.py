"""Queries of order-dependent values, templates, anomaly scores and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import halfspace
from vigilog.operators import anomaly, sequence, template_tree, templates
from vigilog.plans.catalog import query, sql_time
from vigilog.plans.fixtures import Tables, _q
from vigilog.session import cut_lineage


@query(
    "inter_arrival_delta",
    sql="""
SELECT id, server_id, coalesce(round((epoch_us(recv_time) - epoch_us(lag(recv_time) OVER w))
  / 1000000.0, 6), 0.0) AS delta
FROM log_entry WINDOW w AS (PARTITION BY server_id ORDER BY recv_time, id)""",
)
def inter_arrival_delta(t: Tables):
    events = t.logs.select("id", "server_id", "recv_time")
    return sequence.inter_arrival(events, "server_id", "recv_time", "id").select(
        "id", "server_id", F.round("delta", 6).alias("delta")
    )


MASK_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(raw_message, "
    r"'\b\d{1,3}(?:\.\d{1,3}){3}\b', '<IP>', 'g'), '\b0x[0-9a-fA-F]+\b', '<HEX>', 'g'), "
    r"'\b\d+\b', '<NUM>', 'g')"
)


@query(
    "burst_and_entropy_flags",
    sql=f"""
WITH m AS (SELECT log_entry_id AS id, {MASK_SQL} AS template FROM linux_d),
ent AS (SELECT template, -sum(p * log2(p)) AS entropy FROM (
  SELECT template, count(*) / sum(count(*)) OVER (PARTITION BY template) AS p
  FROM (SELECT template, unnest(regexp_extract_all(template, '(?s).')) AS ch
        FROM (SELECT DISTINCT template FROM m)) GROUP BY template, ch) GROUP BY template),
x AS (SELECT l.id, s.hostname AS host, ent.entropy,
  (epoch_us(l.recv_time) - epoch_us(lag(l.recv_time) OVER (PARTITION BY s.hostname
    ORDER BY l.recv_time, l.id))) / 1000000.0 AS gap
  FROM log_entry l JOIN server s ON s.id = l.server_id JOIN m ON m.id = l.id
  JOIN ent USING (template))
SELECT id, host, round(coalesce(gap, 0.0), 6) AS delta, round(entropy, 6) AS entropy,
  CASE WHEN coalesce(gap < 0.01, false) OR entropy > 5.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
  coalesce(gap < 0.01, false) OR entropy > 5.5 AS anomaly FROM x""",
)
def burst_and_entropy_flags(t: Tables):
    events = anomaly.host_events(t.logs, t.servers)
    flags = anomaly.burst_and_entropy_flags(events)
    return flags.withColumn("delta", F.round("delta", 6)).withColumn(
        "entropy", F.round("entropy", 6)
    )


@query(
    "mine_templates",
    sql=f"""
SELECT CAST(len(string_split(template, ' ')) AS INTEGER) AS tokens, template, count(*) AS size
FROM (SELECT {MASK_SQL} AS template FROM linux_d) GROUP BY template""",
)
def mine_templates(t: Tables):
    return templates.masked_templates(t.linux, "raw_message")


def _merge_round(i: int) -> str:
    """One round of merging, from view ``g<i>`` of (template, size) to the next."""
    return f"""
k{i} AS (SELECT *, string_split(template, ' ') AS tk FROM g{i}),
o{i} AS (SELECT template, p, array_to_string(tk[1:p-1] || ['<*>'] || tk[p+1:], ' ') AS k
  FROM (SELECT *, unnest(generate_series(2, len(tk))) AS p FROM k{i}
        WHERE len(list_filter(tk, lambda x: x = '<*>')) + 1 <= floor(len(tk) * 0.6))
  WHERE NOT starts_with(tk[p], '<')),
c{i} AS (SELECT k, count(*) AS sharing FROM o{i} GROUP BY k HAVING count(*) > 1),
b{i} AS (SELECT o{i}.template, o{i}.k FROM o{i} JOIN c{i} USING (k)
  QUALIFY row_number() OVER (PARTITION BY o{i}.template ORDER BY c{i}.sharing DESC, o{i}.p) = 1),
g{i + 1} AS (SELECT coalesce(b{i}.k, k{i}.template) AS template, sum(k{i}.size) AS size
  FROM k{i} LEFT JOIN b{i} USING (template) GROUP BY 1)"""


# More rounds than these messages need; a round that changes nothing is harmless.
SQL_ROUNDS = 4


@query(
    "merge_templates",
    sql=f"""
WITH g0 AS (SELECT template, count(*) AS size
  FROM (SELECT {MASK_SQL} AS template FROM linux_d) GROUP BY template),
{", ".join(_merge_round(i) for i in range(SQL_ROUNDS))}
SELECT CAST(len(string_split(template, ' ')) AS INTEGER) AS tokens, template,
  CAST(size AS BIGINT) AS size FROM g{SQL_ROUNDS}""",
)
def merge_templates(t: Tables):
    return templates.merge_templates(templates.masked_templates(t.linux, "raw_message"))


# The messages of a leaf are of one kind here, so a leaf is a template: what all its messages
# share, and a wildcard elsewhere.
@query(
    "template_ids",
    sql=f"""
WITH m AS (SELECT log_entry_id, string_split(template, ' ') AS tk
  FROM (SELECT log_entry_id, {MASK_SQL} AS template FROM linux_d)),
l AS (SELECT *, len(tk) || ' ' || array_to_string(list_transform(tk[1:{template_tree.PREFIX}],
  lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf FROM m),
p AS (SELECT leaf, i, CASE WHEN min(tk[i]) = max(tk[i]) THEN min(tk[i]) ELSE '<*>' END AS token
  FROM (SELECT leaf, tk, unnest(range(1, len(tk) + 1)) AS i FROM l) GROUP BY leaf, i),
t AS (SELECT leaf, string_agg(token, ' ' ORDER BY i) AS template, count(*)::INTEGER AS tokens FROM p GROUP BY leaf),
n AS (SELECT template, count(*) AS size FROM l JOIN t USING (leaf) GROUP BY template)
SELECT log_entry_id, CAST('0x' || substr(md5(template), 1, 15) AS BIGINT) AS template_id, template, tokens, size
FROM l JOIN t USING (leaf) JOIN n USING (template)""",
)
def template_ids(t: Tables):
    found, assigned = template_tree.mined_templates(t.linux, "raw_message")
    messages = template_tree.with_templates(t.linux.select("log_entry_id", "raw_message"), "raw_message", assigned)
    return messages.drop("raw_message", "template").join(found, "template_id")


# Prose has no templates in common with SQL; the miner is compared with a sequential one.
@query("document_templates")
def document_templates(t: Tables):
    lines = t.read("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    found, assigned = template_tree.mined_templates(lines, "line")
    told = template_tree.with_templates(lines, "line", assigned).groupBy("template_id").agg(
        F.countDistinct("doc_id").alias("documents")
    )
    return found.join(told, "template_id")


# A host has few events here; the width is one that they fill, the threshold one they reach.
MODEL_WINDOW = 20
MODEL_THRESHOLD = 0.4
TOKENS_SQL = rf"""
SELECT log_entry_id, 20 AS n, [coalesce(json_extract_string(content, '$.event_id'), '0'),
  lower(string_split(json_extract_string(content, '$.NewProcessName'), '\')[-1]),
  lower(json_extract_string(content, '$.TargetUserName'))] AS tk FROM windows_d
UNION ALL
SELECT log_entry_id, 40, [md5(t), CASE WHEN len(string_split(raw_message, ':')) > 2
  THEN string_split(trim(string_split(raw_message, ':')[3], ' ' || chr(9)), '[')[1]
  ELSE 'unknown' END, t]
FROM (SELECT log_entry_id, raw_message, {MASK_SQL} AS t FROM linux_d)"""


@query(
    "hash_features",
    sql=f"""
WITH tok AS ({TOKENS_SQL}),
h AS (SELECT log_entry_id, n, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS h
  FROM (SELECT log_entry_id, n, unnest(tk) AS x FROM tok)),
s AS (SELECT log_entry_id, h % n + 1 AS slot,
  CASE WHEN (h >> 40) & 1 = 1 THEN -1 ELSE 1 END AS sign FROM h),
f AS (SELECT d.log_entry_id, d.i, CAST(coalesce(sum(s.sign), 0) AS INTEGER) AS v
  FROM (SELECT log_entry_id, unnest(range(1, n + 1)) AS i FROM tok) d
  LEFT JOIN s ON s.log_entry_id = d.log_entry_id AND s.slot = d.i GROUP BY 1, 2)
SELECT log_entry_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS features
FROM f GROUP BY log_entry_id""",
)
def hash_features(t: Tables):
    windows = t.windows.select(
        "log_entry_id",
        anomaly.hash_features(
            anomaly.windows_tokens(F.col("attrs")), anomaly.WINDOWS_BUCKETS
        ).alias("features"),
    )
    linux = t.linux.select(
        "log_entry_id",
        anomaly.hash_features(
            anomaly.linux_tokens(F.col("raw_message")), anomaly.LINUX_BUCKETS
        ).alias("features"),
    )
    told = F.transform("features", lambda x: x.cast("int").cast("string"))
    return windows.unionByName(linux).select("log_entry_id", F.array_join(told, " ").alias("features"))


TREES, HEIGHT, PADDING = halfspace.TREES, halfspace.HEIGHT, halfspace.PADDING
SQL_WINDOWS = 8  # windows a host may fill in the test tables


def _level_sql(d: int) -> str:
    """Nodes of depth ``d`` of every tree, with the ranges that reach them."""
    if d == 0:
        ranges = "list_transform(range(f), lambda x: 0.0::DOUBLE) AS lo, list_transform(range(f), lambda x: 1.0::DOUBLE) AS hi"
        source = f"SELECT f, t.tree, 0 AS node, {ranges} FROM (VALUES (21), (42)) AS v(f), range({TREES}) AS t(tree)"
    else:
        changed = "list_transform({0}, lambda x, i: CASE WHEN i = axis + 1 AND side = {1} THEN cut ELSE x END)"
        source = (
            f"SELECT f, tree, 2 * node + 1 + side AS node, {changed.format('lo', 1)} AS lo, "
            f"{changed.format('hi', 0)} AS hi FROM level{d - 1}, (VALUES (0), (1)) AS v(side)"
        )
    drawn = f"CAST('0x' || substr(md5('{halfspace.SEED}:' || tree || ':' || node), 1, 15) AS BIGINT)"
    place = f"{PADDING} + {1 - 2 * PADDING} * ((h // 1000) % 1000000) / 1000000"
    return f"""level{d} AS MATERIALIZED (
  SELECT *, lo[axis + 1] + ({place})::DOUBLE * (hi[axis + 1] - lo[axis + 1]) AS cut
  FROM (SELECT *, CAST(h % f AS INTEGER) AS axis FROM (SELECT *, {drawn} AS h FROM ({source}))))"""


def _window_sql(w: int) -> str:
    """Scores and learned events of window ``w`` from those of the window before."""
    if w == 0:
        scored = "SELECT id, log_source, flag, 0.0::DOUBLE AS score FROM ev WHERE win = 0"
    else:
        scored = f"""
SELECT e.id, e.log_source, e.flag, 1 - (CASE WHEN any_value(p.host) IS NULL THEN NULL ELSE sum(tot) END)
  / ({TREES} * {MODEL_WINDOW} * {2.0 ** (HEIGHT + 1) - 1}) AS score
FROM ev e LEFT JOIN (SELECT DISTINCT host, log_source FROM ev WHERE win = {w - 1}) p USING (host, log_source)
JOIN (SELECT id, tree, sum(mass * power(2, depth)) FILTER (depth <= coalesce(light, {HEIGHT})) AS tot
  FROM (SELECT *, min(depth) FILTER (mass < {halfspace.SIZE_LIMIT * MODEL_WINDOW}) OVER (PARTITION BY id, tree) AS light
    FROM (SELECT v.id, v.tree, v.depth, coalesce(m.mass, 0) AS mass FROM visited v
      LEFT JOIN (SELECT host, log_source, tree, node, count(*) AS mass FROM visited
        JOIN learned{w - 1} USING (id) GROUP BY ALL) m USING (host, log_source, tree, node)
      WHERE v.win = {w})) GROUP BY id, tree) t ON t.id = e.id
WHERE e.win = {w} GROUP BY e.id, e.log_source, e.flag"""
    return f"""scored{w} AS MATERIALIZED ({scored}),
learned{w} AS MATERIALIZED (SELECT id FROM scored{w} WHERE NOT flag
  AND CASE WHEN log_source = 'linux' THEN score <= {MODEL_THRESHOLD} ELSE score < {anomaly.WINDOWS_LEARN_BELOW} END)"""


SCORES_SQL = f"""
WITH tok AS MATERIALIZED ({TOKENS_SQL}),
th AS (SELECT log_entry_id, n, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS h
  FROM (SELECT log_entry_id, n, unnest(tk) AS x FROM tok)),
ts AS (SELECT log_entry_id, h % n + 1 AS slot,
  CASE WHEN (h >> 40) & 1 = 1 THEN -1 ELSE 1 END AS sign FROM th),
tf AS (SELECT d.log_entry_id, d.i, coalesce(sum(ts.sign), 0)::DOUBLE AS v
  FROM (SELECT log_entry_id, unnest(range(1, n + 1)) AS i FROM tok) d
  LEFT JOIN ts ON ts.log_entry_id = d.log_entry_id AND ts.slot = d.i GROUP BY 1, 2),
feat AS (SELECT log_entry_id AS id, list(v ORDER BY i) AS x FROM tf GROUP BY 1),
mt AS (SELECT log_entry_id AS id, {MASK_SQL} AS template FROM linux_d WHERE raw_message <> ''),
ent AS (SELECT template, -sum(p * log2(p)) AS entropy FROM (
  SELECT template, count(*) / sum(count(*)) OVER (PARTITION BY template) AS p
  FROM (SELECT template, unnest(regexp_extract_all(template, '(?s).')) AS ch
        FROM (SELECT DISTINCT template FROM mt)) GROUP BY template, ch) GROUP BY template),
base AS (SELECT l.id, lower(trim(s.hostname)) AS host, l.log_source, l.recv_time,
  coalesce(ent.entropy, 0.0) AS entropy FROM log_entry l JOIN server s ON s.id = l.server_id
  LEFT JOIN mt ON mt.id = l.id LEFT JOIN ent USING (template)
  WHERE mt.id IS NOT NULL OR l.id IN (SELECT log_entry_id FROM windows_d)),
ord AS (SELECT *, row_number() OVER w - 1 AS position,
  (epoch_us(recv_time) - epoch_us(lag(recv_time) OVER w)) / 1000000.0 AS gap
  FROM base WINDOW w AS (PARTITION BY host, log_source ORDER BY recv_time, id)),
ev AS MATERIALIZED (SELECT ord.*, position // {MODEL_WINDOW} AS win, coalesce(gap, 0.0) AS delta,
  log_source = 'linux' AND (coalesce(gap < 0.01, false) OR entropy > 5.5) AS flag,
  CASE WHEN log_source = 'linux' THEN x || [coalesce(gap, 0.0)::DOUBLE, entropy::DOUBLE]
    ELSE x || [coalesce(gap, 0.0)::DOUBLE] END AS x
  FROM ord JOIN feat USING (id)),
{", ".join(_level_sql(d) for d in range(HEIGHT))},
nodes AS MATERIALIZED ({" UNION ALL ".join(f"SELECT f, tree, node, axis, cut FROM level{d}" for d in range(HEIGHT))}),
walk0 AS (SELECT id, host, log_source, win, x, len(x) AS f, t.tree, 0 AS node FROM ev, range({TREES}) AS t(tree)),
{", ".join(
    f"walk{d + 1} AS MATERIALIZED (SELECT id, host, log_source, win, x, f, tree, "
    f"2 * node + 1 + (x[axis + 1] >= cut)::INTEGER AS node FROM walk{d} JOIN nodes USING (f, tree, node))"
    for d in range(HEIGHT))},
visited AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT id, host, log_source, win, tree, node, {d} AS depth FROM walk{d}" for d in range(HEIGHT + 1))}),
{", ".join(_window_sql(w) for w in range(SQL_WINDOWS))},
sc AS ({" UNION ALL ".join(f"SELECT id, score FROM scored{w}" for w in range(SQL_WINDOWS))})
SELECT ev.id, ev.host, ev.log_source, {sql_time("ev.recv_time")} AS recv_time, ev.delta::DOUBLE AS delta,
  ev.entropy::DOUBLE AS entropy, round(CASE WHEN flag THEN 1.0 ELSE score END, 6) AS score,
  flag OR score > {MODEL_THRESHOLD} AS anomaly
FROM ev JOIN sc USING (id)"""


@query("host_anomaly_score", sql=SCORES_SQL)
def host_anomaly_score(t: Tables):
    events = anomaly.host_events(t.logs, t.servers)
    scored = anomaly.host_anomaly_score(events, window=MODEL_WINDOW, threshold=MODEL_THRESHOLD)
    return scored.withColumn("score", F.round("score", 6))


# Two runs, the second from what the first kept, are one run.
@query("persist_host_models", sql=SCORES_SQL)
def persist_host_models(t: Tables):
    events = anomaly.host_events(t.logs, t.servers)
    cut = F.lit("2024-01-16").cast("timestamp")
    model = {"window": MODEL_WINDOW, "threshold": MODEL_THRESHOLD}
    first = anomaly.score_events(events.where(F.col("recv_time") < cut), **model)
    state = cut_lineage(t.spark, anomaly.next_state(first, MODEL_WINDOW), "host-models")
    later = anomaly.host_anomaly_score(events.where(F.col("recv_time") >= cut), state, **model)
    return anomaly.verdicts(first).unionByName(later).withColumn("score", F.round("score", 6))


@query(
    "snapshot_diff",
    sql=f"""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id AS item FROM events),
n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next_day FROM (SELECT DISTINCT day FROM d))
SELECT strftime(n.next_day, '%Y-%m-%d') AS snapshot, d.item, {_q("removed")} AS change
FROM d JOIN n ON n.day = d.day WHERE n.next_day IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM d x WHERE x.day = n.next_day AND x.item = d.item)
UNION ALL
SELECT strftime(d.day, '%Y-%m-%d'), d.item, {_q("added")}
FROM d JOIN n ON n.next_day = d.day
WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.day = n.day AND x.item = d.item)""",
)
def snapshot_diff(t: Tables):
    from vigilog.operators.snapshots import snapshot_diff as diff

    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("snapshot")
    return diff(t.read("events").select(day, F.col("user_id").alias("item")))
