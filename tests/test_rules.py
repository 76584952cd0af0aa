"""The rule compiler against a row-by-row evaluator written for this test."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vigilog.operators import detect
from vigilog.rules import pack
from vigilog.rules.compiler import log_field
from vigilog.rules.pack import Rule

LOG_SCHEMA = "id bigint, server_id bigint, recv_time timestamp, log_source string, content string"

WINDOWS_EVENTS = [
    {"event_id": 4625, "channel": "Security", "message": "An account failed to log on"},
    {"event_id": 4688, "CommandLine": "powershell -enc AAA", "TargetUserName": "Bob"},
    {"event_id": 4688, "channel": "System", "remote_ip": "fe80::1", "name": "x*y"},
    {"EventID": "4624", "LogName": "Security", "message": "ok", "size": "12.5"},
    {"note": "it's a \\ back\\slash", "channel": None},
]


def window_logs(spark):
    rows = [
        (i, 1, None, "windows", json.dumps(event)) for i, event in enumerate(WINDOWS_EVENTS)
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def expected_compat(event: dict, raw: str, detection: dict) -> bool:
    """Truth of a detection for one event, by the rules of the plain matcher."""

    def value_of(name):
        name = log_field("windows", name)
        columns = {
            "channel": event.get("channel") if event.get("channel") else event.get("LogName"),
            "event_id": event.get("event_id", event.get("EventID")),
            "message": event.get("message"),
            "user_name": event.get("TargetUserName"),
        }
        found = columns.get(name)
        found = event.get(name) if found is None else found
        return str(raw if found is None else found).lower()

    def one(text, wanted, modifier):
        wanted = str(wanted).lower()
        checks = {
            "contains": lambda: wanted in text,
            "startswith": lambda: text.startswith(wanted),
            "endswith": lambda: text.endswith(wanted),
        }
        if modifier in checks:
            return checks[modifier]()
        pattern = wanted if modifier == "re" else "^" + wanted.replace("*", ".*") + "$"
        if modifier == "re" or "*" in wanted:
            try:
                return re.search(pattern, text, re.I) is not None
            except re.error:
                return False
        return wanted == text

    def block(name):
        body = detection.get(name.strip())
        bodies = body if isinstance(body, list) else [body]

        def holds(fields):
            results = []
            for key, wanted in fields.items():
                field, _, modifier = key.partition("|")
                options = wanted if isinstance(wanted, list) else [wanted]
                results.append(any(one(value_of(field), w, modifier) for w in options))
            return bool(results) and all(results)

        return any(isinstance(b, dict) and holds(b) for b in bodies)

    text = detection["condition"]
    if text == "selection":
        return block("selection")
    if "and not" in text:
        left, *right = text.split(" and not ")
        return len(right) == 1 and block(left) and not block(right[0])
    for word, combine in (("or", any), ("and", all)):
        if word in text:
            return combine(map(block, text.split(f" {word} ")))
    return False


def random_rules(n: int) -> list[Rule]:
    rng = random.Random(7)
    fields = ["EventID", "Channel", "Message", "User", "CommandLine", "remote_ip", "name", "note"]
    modifiers = ["", "|contains", "|startswith", "|endswith", "|re", "|in", "|not_in", "|gte"]
    values = [
        4625, "4688", "security", "fail", "powershell", "*log*", "a.*on", "(((", "fe80", ":", "ok",
        "x*y", "back\\slash", "it's", "", "{", "bob", True,
    ]
    conditions = [
        "selection", "a and b", "a or b", "a and not b", "a and b and not c", "1 of a", "keywords",
        "a and not b and not c", "selection and missing", "missing or a",
    ]

    def block():
        names = rng.sample(fields, rng.choice([1, 1, 2]))
        return {
            name + rng.choice(modifiers): rng.choice(
                [rng.choice(values), rng.sample(values, rng.choice([2, 3, 10]))]
            )
            for name in names
        }

    out = []
    for i in range(n):
        detection = {name: block() for name in ("selection", "a", "b", "c")}
        if rng.random() < 0.2:
            detection["a"] = [block(), block(), "word"]
        detection["keywords"] = ["fail", "ok"]
        detection["condition"] = rng.choice(conditions)
        out.append(Rule(f"r{i}", "t", "", "low", "s", "windows", detection))
    return out


def test_compat_mode_equals_the_row_evaluator(spark):
    rules = random_rules(120)
    logs = window_logs(spark)
    got = {
        (r.log_entry_id, r.rule_id)
        for r in detect.run_rules(logs, rules, "compat").select("log_entry_id", "rule_id").collect()
    }
    want = {
        (i, rule.id)
        for i, event in enumerate(WINDOWS_EVENTS)
        for rule in rules
        if expected_compat(event, json.dumps(event), rule.detection)
    }
    assert got == want and len(want) > 50


def hits(spark, detection, mode="intent", **kw):
    detection = {"condition": "selection", **detection}
    rule = Rule("r", "t", "", "low", "s", "windows", detection, **kw)
    found = detect.matching_logs(window_logs(spark), rule, mode)
    return sorted(r.id for r in found.collect())


@pytest.mark.parametrize(
    "detection, intent, compat",
    [
        ({"selection": {"EventID|in": [4625, 4624]}}, [0, 3], [0, 3]),
        ({"selection": {"EventID|not_in": [4625]}}, [1, 2, 3], [0]),
        ({"selection": {"size|gte": 12}}, [3], []),
        ({"selection": {"channel|empty": True}}, [1, 4], []),
        ({"selection": {"nothing": "x"}}, [], []),
        ({"selection": {"nothing|contains": "POWERSHELL"}}, [1], [1]),
        ({"keywords": ["-enc", "fe80"], "condition": "keywords"}, [1, 2], []),
        ({"selection": {"message|re": r"\S+ account"}}, [0], []),
        ({"a": {"EventID": 4688}, "condition": "(a)"}, [], []),
        ({"a": {"EventID": 4688}, "condition": "1 of a"}, [], []),
        ({"selection": {"note|contains": "\\ back\\slash"}}, [4], [4]),
        ({"selection": {"note|startswith": "it's"}}, [4], [4]),
    ],
)
def test_modes(spark, detection, intent, compat):
    assert hits(spark, detection) == intent
    assert hits(spark, detection, "compat") == compat


def test_required_fields_do_not_fall_back_to_the_line(spark):
    detection = {"selection": {"remote_ip|contains": ":"}}
    assert hits(spark, detection) == [0, 1, 2, 3, 4]
    assert hits(spark, detection, require_fields=True) == [2]


def test_rule_files_and_defaults(spark, tmp_path):
    folder = tmp_path / "Windows" / "Network"
    folder.mkdir(parents=True)
    rows = [{"detection": {"selection": {"a": 1}}}, {"id": "no-detection"}]
    (folder / "some_rule.json").write_text("\n".join(map(json.dumps, rows)))
    table = pack.read_rules(spark, str(tmp_path))
    rule = pack.collect_rules(table)
    assert len(rule) == 1
    assert (rule[0].id, rule[0].title, rule[0].level, rule[0].status, rule[0].log_source) == (
        "some_rule", "Unknown", "medium", "experimental", "windows",
    )
    assert rule[0].detection == {"selection": {"a": 1}}


def test_yaml_rule_files(spark, tmp_path):
    pytest.importorskip("yaml")
    folder = tmp_path / "Nginx"
    folder.mkdir()
    (folder / "one.yml").write_text(
        "title: One\nlogsource:\n  product: x\ndetection:\n  selection:\n"
        "    Url|contains: ['/a', 1]\n  condition: selection\n"
    )
    (folder / "two.yml.disabled").write_text("detection:\n  selection: {a: b}\n")
    (folder / "three.yml").write_text("title: no detection\n")
    rules = pack.collect_rules(pack.read_yaml_rules(spark, str(tmp_path)))
    assert [(r.id, r.title, r.log_source) for r in rules] == [("one", "One", "nginx")]
    assert rules[0].detection["selection"] == {"Url|contains": ["/a", 1]}


def test_alert_rows(spark):
    detection = {"selection": {"EventID": 4625}, "condition": "selection"}
    rule = Rule("r1", "Title", "Text", "high", "s", "windows", detection,
                falsepositives=["fp"], references=["ref"])
    off = Rule("r2", "Off", "", "high", "s", "windows", detection, enabled=False)
    alert = detect.run_rules(window_logs(spark), [rule, off]).collect()
    assert len(alert) == 1
    a = alert[0]
    assert (a.alert_id, a.title, a.severity, a.false_positives, a.references) == (
        "r1_0", "Title", "high", ["fp"], ["ref"],
    )
    assert json.loads(a.matched_fields)["message"] == "An account failed to log on"
    assert detect.run_rules(window_logs(spark), [off]).count() == 0


def test_dedupe_keeps_the_earliest_copy(spark):
    rows = [("a", 1, "2024-01-02"), ("a", 1, "2024-01-01"), ("b", 2, "2024-01-01")]
    new = spark.createDataFrame(rows, "alert_id string, log_entry_id bigint, t string").select(
        "alert_id", "log_entry_id", F.col("t").cast("timestamp").alias("recv_time")
    )
    stored = spark.createDataFrame([("b",)], "alert_id string")
    got = detect.dedupe_alerts(new, stored).collect()
    assert [(r.alert_id, str(r.recv_time)[:10]) for r in got] == [("a", "2024-01-01")]


def test_unreadable_metadata_is_empty(spark):
    df = spark.createDataFrame([('{"a": "b"}',), ("oops",), (None,)], "m string")
    got = [r[0] for r in df.select(detect.metadata_fields(F.col("m"))).collect()]
    assert got == [{"a": "b"}, {}, {}]


PATTERNS = [
    "{", "a{2}", "a{,2}b", "{}", "x{y}", "[[]", "[]a]", "[^]]x", "[a&&b]+", r"\{a\}", r"a\Z", "[{]",
    "(?P<n>a)b", "}", "a{1,}", r"[\]]", "a{2,3}?", "[a-z&]{2}",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_mean_the_same_in_both_languages(spark, pattern):
    from vigilog.rules.compiler import safe_regex

    texts = ["{", "aa", "aab", "{}", "x{y}", "[", "]", "ax", "yx", "&", "{a}", "a", "ab", "}", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in df.where(F.col("t").rlike(safe_regex(pattern))).collect()]
    assert got == [t for t in texts if re.search(pattern, t)]


@pytest.mark.parametrize("pattern", ["(?P<a>f)ailed (?P=a)", "(?a)failed", "(f)?ailed(?(1)x|y)", "(?<=a+)b", "["])
def test_patterns_of_one_language_never_stop_the_pass(spark, pattern):
    from vigilog.rules.compiler import safe_regex

    spelled = safe_regex(pattern)
    df = spark.createDataFrame([("failed f",), ("b",)], "t string")
    if pattern.startswith("(?P"):
        assert [r.t for r in df.where(F.col("t").rlike(spelled)).collect()] == ["failed f"]
    else:
        assert spelled is None
    detection = {"selection": {"message|re": pattern}, "condition": "selection"}
    assert hits(spark, detection) == []


def test_gte_takes_the_lowest_number(spark):
    assert hits(spark, {"selection": {"size|gte": ["many", 100, 12]}}) == [3]
    assert hits(spark, {"selection": {"size|gte": "many"}}) == []


COUNTING = [
    {"selection": {"count|gte": 1}},
    {"selection": {"message|contains": "a", "count|gte": 1}},
    {"selection": {"remote_address|count|gte": 1}},
    {"selection": {"remote_address|duplicate": True}},
    {"selection": {"message|contains": "a"}, "aggregation": {"SourceIp|count": ">0"}},
]


@pytest.mark.parametrize("detection", COUNTING)
def test_counting_rules_alert_on_no_single_row(spark, detection):
    rule = Rule("c", "Counts", "", "low", "s", "windows", {**detection, "condition": "selection"})
    assert detect.run_rules(window_logs(spark), [rule]).count() == 0


@pytest.mark.parametrize(
    "detection, expected",
    [
        ({"selection": {"x|count|gte": 2}}, (None, "x", 2)),
        ({"selection": {"count|gte": 20}}, (None, None, 20)),
        ({"selection": {"x|duplicate": True}}, ("x", "server", 2)),
        ({"aggregation": {"x|count": ">5"}}, ("x", None, 6)),
        ({"aggregation": {"x|count": ">=5"}}, ("x", None, 5)),
        ({"aggregation": {"x|count": 5}}, ("x", None, 6)),
        ({"aggregation": {"x|count": "some"}}, ("x", None, 2**63 - 1)),
    ],
)
def test_what_a_rule_counts(detection, expected):
    from vigilog.rules.compiler import counting_of

    got = counting_of(Rule("c", "", "", "", "", "linux", detection))
    assert (got.group, got.distinct, got.least) == expected
    assert counting_of(Rule("c", "", "", "", "", "linux", {"selection": {"x|gte": 5}})) is None


def test_rule_tables_have_no_limit(spark):
    rows = [
        {"id": f"r{i}", "log_source": "windows", "detection": {"selection": {"EventID": 100_000 + i}}}
        for i in range(6000)
    ]
    table = pack.rules_frame(spark, rows)
    assert len(pack.collect_rules(table)) == 6000
