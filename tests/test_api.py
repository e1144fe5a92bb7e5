"""The calls a user makes, over a folder of transcript files."""

import json

import pytest

from skein import __main__ as command
from skein import api


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "projects" / "-srv-one"
    place.mkdir(parents=True)
    say = lambda kind, text, **more: json.dumps({"type": kind, "message": {"role": kind, "content": text}} | more)
    team = json.dumps({"type": "assistant", "uuid": "u", "message": {"content": [{"type": "tool_use", "id": "1", "name": "TeamCreate", "input": {"name": "core"}}]}})
    (place / "abc.jsonl").write_text("\n".join([say("user", "hello there"), '{"type":"progress"}', '{"type":"progress"}', team, say("assistant", "done")]) + "\n")
    (place / "xyz.jsonl").write_text(say("user", "needle in here") + "\n")
    return str(tmp_path / "projects")


def test_calls(spark, folder, tmp_path):
    assert {r.session_id: r.prescription for r in api.list_sessions(spark, folder).collect()} == {"abc": "gentle", "xyz": "gentle"}
    assert api.current_session(spark, folder, text="needle").collect()[0].session_id == "xyz"
    assert api.diagnose(spark, folder, "ab").collect()[0].messages == 5
    row = {r.session_id: r for r in api.treat(spark, folder, "gentle", write_to=str(tmp_path / "out")).collect()}["abc"]
    assert (row.messages_before, row.messages_after, row.saved_bytes) == (5, 4, 19)
    assert sum(1 for _ in spark.read.text(str(tmp_path / "out")).collect()) == 5
    assert api.treat(spark, folder, "gentle", protect_team=True).count() == 2
    assert api.run_strategy(spark, folder, "progress-collapse").collect()[0].line_index == 1
    assert "core" in api.checkpoints(spark, folder).collect()[0].report
    recaps = api.recaps(spark, folder)
    api.write_texts(recaps, "recap", str(tmp_path / "recaps"))
    assert recaps.count() == 2 and api.doctor(spark, folder).count() == 4 and api.formulary(spark).count() == 13
    assert {r.prescription for r in api.what_if(spark, folder, "abc").collect()} == {"gentle", "standard", "aggressive"}


def test_command_line(spark, capsys):
    command.main(["formulary"])
    assert "progress-collapse" in capsys.readouterr().out


def test_tool_server(spark, folder):
    import io

    from skein import server

    asks = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nothing"}]
    asks += [{"id": 10 + i, "method": "tools/call", "params": p} for i, p in enumerate([
        {"name": "list_sessions"}, {"name": "diagnose", "arguments": {"session": "ab"}}, {"name": "estimate_tokens"}, {"name": "treat_session", "arguments": {"session": "abc", "prescription": "gentle"}}, {"name": "list_strategies"},
        {"name": "diagnose", "arguments": {"session": "zz"}}, {"name": "none"},
    ])]
    out = io.StringIO()
    server.serve(spark, folder, io.StringIO("".join(json.dumps(a) + "\n" for a in asks) + "{broken\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert len(got) == 11 and len(got[2]["result"]["tools"]) == 5 and got[3]["error"]["code"] == -32601 and got[16]["error"]["code"] == -32602 and got[None]["error"]["code"] == -32700
    text = lambda i: json.loads(got[i]["result"]["content"][0]["text"])
    assert len(text(10)) == 2 and text(11)[0]["messages"] == 5 and text(13)[0]["session_id"] == "abc" and len(text(14)) == 13 and got[15]["result"]["isError"]


def test_reload_writes_session_and_report(spark, folder, tmp_path):
    assert api.reload(spark, folder, "abc", str(tmp_path / "re"), "gentle").collect()[0].result.endswith("MB saved")
    lines = [r.value for r in spark.read.text(str(tmp_path / "re" / "sessions")).collect()]
    assert sum("Team state to go on with" in v for v in lines) == 1
    assert "core" in "".join(r.value for r in spark.read.text(str(tmp_path / "re" / "reports")).collect())
