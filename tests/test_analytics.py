"""Tokens, diagnostics, team state, recaps, catalogue and the JSONL source."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.operators import diagnosis, model, recap, team, tokens
from skein.sources import catalog, jsonl


def line(kind, content=None, **root):
    message = {"role": kind, "content": content} | {k: root.pop(k) for k in ("usage", "model") if k in root}
    return {"type": kind, "message": message, **root}


@pytest.fixture
def lines(spark):
    def make(values, session="s"):
        rows = [(session, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
        return jsonl.from_raw(spark.createDataFrame(rows, "session_id string, line_index long, raw string"))

    return make


def usage(i, c=0, r=0, o=9):
    return {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": c, "cache_read_input_tokens": r}


def one(df):
    return df.collect()[0]


def test_exact_tokens(lines):
    say = lambda u, **k: line("assistant", [{"type": "text", "text": "x"}], usage=u, **k)
    assert one(tokens.last_usage(lines([say(usage(5)), say(usage(1000, 200, 300))]))).total == 1500
    assert one(tokens.last_usage(lines([say(usage(800)), say(usage(500), isSidechain=True)]))).total == 800
    assert one(tokens.last_usage(lines([say(usage(600)), "not json"]))).total == 600
    assert tokens.last_usage(lines([line("user", "x")])).count() == 0
    row = one(tokens.estimate(lines([say(usage(50000, 10000, 5000))])))
    assert (row.total, row.method, row.confidence, row.context_pct) == (65000, "exact", "high", 32.5)


def test_heuristic_tokens(lines):
    assert one(tokens.heuristic(lines([{"type": "progress"}]))).tokens == 21000
    thinking = line("assistant", [{"type": "thinking", "thinking": "t" * 10000}, {"type": "text", "text": "short"}])
    assert one(tokens.heuristic(lines([thinking]))).tokens < 21100
    assert one(tokens.estimate(lines([line("user", "x" * 37)]))).total == 21010


def test_windows(spark):
    of = lambda m: one(spark.range(1).select(tokens.window_of(F.lit(m)).alias("w"))).w
    assert of(tokens.MODEL_WINDOWS[0][0]) == 1_000_000 and of(tokens.MODEL_WINDOWS[0][0] + "-x") == 1_000_000 and of("other") == 200_000


def test_tail_estimate(lines):
    say = lambda n: line("assistant", [{"type": "text", "text": "x"}], usage=usage(n))
    assert one(tokens.tail_estimate(lines([say(1), say(7)]))).total == 7
    assert tokens.tail_estimate(lines([say(7), line("user", "y" * 60000)])).count() == 0


@pytest.mark.parametrize("text", ["plain", "é", "😀", 'a"b\\c', "\n\r\t\x08\x0c", "\x01\x1f\x7f", " ", ""])
def test_json_sizes(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(scalar.json_size(F.col("t")).alias("n"))
    assert one(df).n == len(json.dumps(text))


def test_block_sizes_from_fields(messages):
    block = {"type": "tool_use", "id": "t", "name": "Bash", "input": '{"a":"é"}'}
    row = one(model.from_table(messages([{"line_index": 0, "type": "assistant", "blocks": [block, {"type": "text", "text": "é\n"}]}])))
    want = [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"a": "é"}}, {"type": "text", "text": "é\n"}]
    assert [b.size for b in row.blocks] == [len(json.dumps(b, separators=(",", ":"))) for b in want]


def test_model_of_dirty_rows(spark, messages):
    rows = [{"line_index": 0, "type": None, "blocks": None}, {"line_index": 0, "type": None, "blocks": None}, {"line_index": None, "type": "user"}, {"session_id": None, "line_index": 1}]
    df = messages(rows).withColumn("chunk", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("_r", F.lit(2))
    out = model.from_table(df).collect()
    assert [(r.type, r.blocks, r.content_kind) for r in out] == [("unknown", [], "none")]
    assert model.from_table(messages([])).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    values = [line("user", "héllo"), line("assistant", [{"type": "text", "text": "😀", "extra": 1.0}], isSidechain=False), {"type": "x", "n": 1e20}]
    raw = [json.dumps(v, ensure_ascii=False) for v in values]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.jsonl").write_bytes("\r\n".join([raw[0], "", "broken {", "123", "[1]", raw[1], raw[2], ""]).encode())
    read = jsonl.read_sessions(spark, str(tmp_path / "p"))
    rows = {r.line_index: r for r in read.collect()}
    assert sorted(rows) == [0, 2, 3, 4, 5, 6]
    assert (rows[2].parse_error, rows[2].type, rows[3].parse_error, rows[3].type) == (True, "unknown", False, "unknown")
    assert rows[0].byte_size == len(raw[0].encode()) and rows[0].canonical_size == len(json.dumps(values[0], separators=(",", ":")))
    back = {r.line_index: r.value for r in jsonl.rendered(read).collect()}
    assert json.loads(back[5]) == values[1] and back[2] == "broken {" and back[3] == "123"
    out = jsonl.write_version(read, str(tmp_path / "out"), "1")
    assert [r.value for r in spark.read.text(out).collect()][0] == jsonl.canonical(values[0])
    with pytest.raises(Exception):
        jsonl.write_version(read, str(tmp_path / "out"), "1")
    files = catalog.from_files(spark, str(tmp_path / "p"), "P").collect()
    assert [(f.session_id, f.lines) for f in files] == [("abc", 7)] and catalog.from_files(spark, str(tmp_path / "p"), "zz").count() == 0


def test_diagnosis(lines):
    note = "<system-reminder>a</system-reminder>"
    df = lines([{"type": "progress"}, line("assistant", [{"type": "thinking", "thinking": 'q"', "signature": "é"}]), line("user", [{"type": "tool_result", "content": note + note}])])
    row = one(diagnosis.diagnose(df))
    assert (row.messages, row.thinking_bytes, row.signature_bytes, row.progress, row.reminders, row.tool_result_bytes) == (3, 5, 2, 1, 2, 72)
    assert [x.rank for x in row.largest] == [1, 2, 3]


def test_health_and_breaker(spark):
    files = spark.createDataFrame([("a.jsonl", 60 << 20), ("b.jsonl", 1), ("c.bak", 200 << 20), (None, 5), ("d.jsonl", None)], "path string, size long")
    assert {r.name: (r.status, r.sessions) for r in diagnosis.health(files).collect()} == {"large-sessions": ("warning", 1), "backups": ("warning", 1), "disk-usage": ("ok", 3)}
    events = spark.createDataFrame([("k", t, i) for i, t in enumerate((0, 100, 200, 300, 900))], "key string, at long, event_id long")
    assert [(r.recent, r.allowed, r.prescription) for r in diagnosis.breaker_windows(events).orderBy("at").collect()] == [
        (1, True, "gentle"), (2, True, "standard"), (3, True, "aggressive"), (4, False, "aggressive"), (1, True, "gentle"),
    ]


def test_catalogue(spark, lines):
    rows = [("p/a1", "p", "a1", 5, None, None), ("p/a1", "p", "a1", 7, 3, 2), ("p/a2", "p", "a2", 1, 9, 1), (None, "p", "z", 1, 1, 1)]
    files = catalog.from_table(spark.createDataFrame(rows, "path string, project string, session_id string, size long, mtime long, lines long"))
    assert {r.path: (r.size, r.mtime) for r in files.collect()} == {"p/a1": (7, 3), "p/a2": (1, 9)}
    assert one(catalog.resolve(files, "a")).session_id == "a1" and one(catalog.resolve(files, "a2")).session_id == "a2" and one(catalog.newest(files)).path == "p/a2"
    found = catalog.tail_contains(lines(["one needle", "two", "three"]), "needle", 2)
    assert one(found).found is False


def test_team_state(lines, spark):
    call = lambda tool, use, /, **i: {"type": "tool_use", "name": tool, "id": use, "input": i}
    note = "<task-notification> <task-id>abc1</task-id><status>failed</status><summary>sum</summary><result> why </result>"
    df = lines([
        line("assistant", [call("TeamCreate", "1", name="core", teammates=[{"agentId": "m1", "role": "dev"}, {"agent_id": "m2", "name": "Bo"}]), {"type": "text", "text": "first"}]),
        line("assistant", [call("Task", "k1", description="look", subagent_type="scout"), call("Task", "k2", prompt="p" * 100)]),
        line("user", [{"type": "tool_result", "tool_use_id": "k1", "content": "agent_id: abc1 done"}, {"type": "tool_result", "tool_use_id": "k2", "content": "plain"}]),
        line("assistant", [call("TaskUpdate", "u0", taskId="9", status="blocked"), call("TaskCreate", "c", taskId="7", subject="do", owner="m1"), call("TaskUpdate", "u", taskId="7", status="completed", subject="")]),
        {"type": "queue-operation", "content": note}, line("user", "unrelated"),
    ])
    row = one(team.team_state(df))
    assert (row.team_name, row.messages, row.last_line) == ("core", 6, 4)
    assert [(t.agent_id, t.name, t.role) for t in row.teammates] == [("m1", "m1", "dev"), ("m2", "Bo", "")]
    assert {a.agent_id: (a.status, a.description) for a in row.subagents} == {"abc1": ("failed", "look"), "k2": ("completed", "p" * 80)}
    assert {t.task_id: (t.subject, t.status, t.owner) for t in row.tasks} == {"7": ("do", "completed", "m1"), "9": ("", "blocked", "")}
    configs = spark.createDataFrame([("old", "L0", "S0", 9, []), ("core", "L1", "S1", 1, [("m1", "n", "lead", "big", "/w"), ("m3", None, "qa", "", "")])], "name string, leadAgentId string, leadSessionId string, createdAt long, members array<struct<agentId:string,name:string,agentType:string,model:string,cwd:string>>")
    row = one(team.team_state(df, configs))
    assert (row.lead_agent_id, row.config_source) == ("L1", "both")
    assert {t.agent_id: (t.role, t.model, t.status) for t in row.teammates} == {"m1": ("dev", "big", "running"), "m2": ("", "", "running"), "m3": ("qa", "", "config")}
    assert team.team_state(lines([line("user", "hi")])).count() == 0


def test_recovery_lines(lines):
    df = lines([line("assistant", [{"type": "tool_use", "name": "TeamCreate", "id": "1", "input": {"name": "core"}}], uuid="u9")])
    rows = team.recovery_lines(df, team.team_state(df)).orderBy("line_index").collect()
    assert [r.line_index for r in rows] == [1, 2] and rows[0].parent_uuid == "u9" and rows[1].parent_uuid == rows[0].uuid and "core" in rows[0].text


def test_recap(lines):
    words = ["parser one", "parser two", "parser three", "socket four", "socket five", "alpha beta", "ALPHA beta", "<b>x</b> **bold** text"]
    df = lines([line("user", w) for w in words] + [line("assistant", [{"type": "text", "text": "all  done now"}])])
    found = recap.topics(recap.user_turns(df))
    assert found.count() == 7
    assert [(r.theme, r.topics) for r in recap.themes(found).orderBy("rank").collect()] == [("parser", 3), ("socket", 2)]
    text = one(recap.recap(df)).recap
    assert "8 exchanges | 7 topics" in text and "Themes: parser (3), socket (2)" in text and "- bold text\n" in text and text.endswith("Last: all done now\n")
    assert recap.recap(lines([{"type": "progress"}])).count() == 0


def test_settings_merge(spark):
    have = spark.createDataFrame([("Stop", None, "a")], "event string, matcher string, command string")
    want = spark.createDataFrame([("Stop", "", "b"), ("Start", "x", "c")], "event string, matcher string, command string")
    once = jsonl.merge_settings(have, want)
    assert once.count() == 2 and jsonl.merge_settings(once, want).count() == 2
