"""Growing transcripts: appended lines, tiers, the breaker, recovery, teams, documents."""

import json
import os

import pytest

from skein import api
from skein.operators import executor, model, team
from skein.sources import catalog, documents, jsonl, transcripts
from skein.streaming import guard, recovery


def line(text, **more):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}, **more}) + "\n"


def write(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as file:
        file.write(text)


def test_appended_lines_are_seen(spark, tmp_path):
    file, got = str(tmp_path / "logs" / "abc.jsonl"), []

    def run():
        rows = transcripts.stream(spark, str(tmp_path / "logs"), 4).writeStream.option("checkpointLocation", str(tmp_path / "ck"))
        rows.foreachBatch(lambda df, _: got.extend((r.session_id, r.start, r.raw) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
        seen = sorted(got)
        got.clear()
        return seen

    write(file, '{"a":1}\n\n{"b":2}\n{"c')
    assert run() == [("abc", 0, '{"a":1}'), ("abc", 9, '{"b":2}')]
    write(file, '":3}\n')
    assert run() == [("abc", 17, '{"c":3}')] and run() == []
    write(str(tmp_path / "logs" / "new.jsonl"), '{"d":"é"}\n')
    assert run() == [("new", 0, '{"d":"é"}')]


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    write(str(tmp_path / "logs" / "abc.jsonl"), "".join(f"line {i}\n" if i % 5 else "\n" for i in range(4000)))
    write(str(tmp_path / "logs" / "b.jsonl"), "x\r\n y \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = {(r.session_id, r.line_index): r.raw for r in jsonl.raw_lines(spark, str(tmp_path / "logs")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {("abc", i): f"line {i}" for i in range(4000) if i % 5} | {("b", 0): "x", ("b", 1): "y"}


def test_breaker_keeps_its_state(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    breaker = recovery.Breaker(spark, str(tmp_path / "r"), most=3, seconds=300)
    look = lambda now: {r.key: (r.recent, r.allowed, r.prescription) for r in recovery.Breaker(spark, str(tmp_path / "r")).state(keys, now).collect()}
    assert look(0)["a"] == (0, True, "gentle")
    for n, now in enumerate((10, 20, 30)):
        breaker.record(spark.createDataFrame([("a", float(now), "x", 9, 5)], recovery.RECOVERIES))
        assert look(now)["a"] == (n + 1, n < 2, ["standard", "aggressive", None][n])
    write(str(tmp_path / "r" / "bad.json"), "{broken\n")
    assert look(40) == {"a": (3, False, None), "b": (0, True, "gentle")}
    assert look(311)["a"] == (2, True, "aggressive") and look(400)["a"] == (0, True, "gentle")
    breaker.reset(keys.where("key = 'a'"), 50.0)
    assert look(60)["a"] == (0, True, "gentle")


def test_watch_prunes_recovers_and_trips(spark, tmp_path):
    logs, state = str(tmp_path / "logs"), str(tmp_path / "state")
    file = f"{logs}/p/abc.jsonl"
    now = [1000.0]

    def run():
        guard.watch(spark, logs, state, str(tmp_path / "ck"), hard=4000, soft=2000, danger=8000, prescription="gentle", available_now=True, clock=lambda: now[0], name="watch_test").awaitTermination()
        return {(r.session_id, r.tier, r.action, r.prescription) for r in spark.read.json(f"{state}/events").collect()} if os.path.exists(f"{state}/events") else set()

    seen = set()
    create = {"type": "assistant", "uuid": "u1", "message": {"content": [{"type": "tool_use", "id": "1", "name": "TeamCreate", "input": {"name": "core"}}]}}
    write(file, line("short") + json.dumps(create) + "\n")
    assert run() == seen
    assert ["Agent Team Checkpoint: core" in r.report for r in spark.read.json(f"{state}/reports").collect()] == [True]
    write(file, "".join(json.dumps({"type": "progress", "n": i}) + "\n" for i in range(80)))
    seen |= {("abc", "soft", "pruned", "gentle")}
    assert run() == seen
    version = next(d for d in os.listdir(f"{state}/versions") if d.startswith("version="))
    lines = [r.value for r in spark.read.text(f"{state}/versions/{version}").collect()]
    assert sum("progress" in v for v in lines) == 1 and sum("TeamCreate" in v for v in lines) == 1 and sum("Team state to go on with" in v for v in lines) == 1
    assert spark.read.json(f"{state}/reports").count() == 1  # the team hasn't changed
    write(file, line("x" * 8000))
    seen |= {("abc", "hard", "pruned", "gentle")}
    assert run() == seen  # large, but without the mark
    for step, outcome in (("gentle", "too large"), ("standard", "too large"), ("aggressive", "too large"), (None, "halted")):
        now[0] += 1
        write(file, line("Conversation too long"))
        seen |= {("abc", "overflow", outcome, step)}
        assert run() == seen
    assert spark.read.json(f"{state}/recoveries").count() == 3


def test_teams_are_spared_and_told(spark, messages):
    say = lambda i, **more: {"line_index": i, "type": "user", "uuid": f"u{i}", "blocks": [{"type": "text", "text": "hello"}], **more}
    create = {"type": "tool_use", "id": "c", "name": "TeamCreate", "input": json.dumps({"name": "core", "teammates": [{"agentId": "a1"}]})}
    rows = [{"session_id": s, **r} for s in ("team", "none") for r in (say(0), {"line_index": 1, "type": "progress"}, {"line_index": 2, "type": "progress"}, say(5))]
    rows += [{"session_id": "team", "line_index": 3, "type": "assistant", "uuid": "u3", "blocks": [create]}, {"session_id": "none", "line_index": 3, "type": "assistant", "blocks": [{"type": "text", "text": "the agent id is unknown"}]}]
    out = team.team_protected(model.from_table(messages(rows)), lambda m: executor.run_prescription(m, "gentle")[0]).orderBy("session_id", "line_index").collect()
    assert [r.line_index for r in out if r.session_id == "none"] == [0, 2, 3, 5]
    told = [r for r in out if r.session_id == "team"]
    assert [r.line_index for r in told] == [0, 2, 3, 5, 6, 7] and [r.type for r in told[-2:]] == ["user", "assistant"]
    assert "core" in told[-2].blocks[0].text and "a1" in told[-2].blocks[0].text


def test_doctor_and_init(spark, tmp_path):
    folder, settings = str(tmp_path / "projects"), str(tmp_path / "settings.json")
    write(f"{folder}/-srv-one/abc.jsonl", line("hi"))
    write(f"{folder}/-srv-one/abc.20300101.bak", "y" * 3000)
    write(settings, json.dumps({"hasTrustDialogAccepted": True, "/p": {"hasTrustDialogAccepted": True}, "hooks": {"Stop": [{"matcher": "", "hooks": [{"command": "other"}]}]}}))
    checks = {r.name: r for r in api.doctor(spark, folder, settings).collect()}
    assert (checks["backups"].bytes, checks["backups"].sessions) == (3000, 1) and checks["trust-dialog"].status == "warning" and checks["trust-dialog"].sessions == 2
    assert {r.name: r.status for r in api.doctor(spark, folder, settings, windows=True, fix=True).collect()}["trust-dialog"] == "fixed"
    assert documents.flagged(documents.read(settings)) == [] and documents.flagged(documents.read(settings + ".bak")) == ["top-level", "/p"]
    assert len(api.init(settings)) == 5 and api.init(settings) == [] and len(documents.read(settings)["hooks"]["Stop"]) == 2
    write(settings, "{broken", "w")
    assert documents.read(settings) is None and {r.name: r.status for r in api.doctor(spark, folder, settings).collect()}["trust-dialog"] == "warning"
    with pytest.raises(ValueError):
        api.init(settings)
    for wanted in ("current", "ab", f"{folder}/-srv-one/abc.jsonl"):
        assert [r.session_id for r in api.resolve(spark, folder, wanted, "/srv/one").collect()] == ["abc"]
    assert [r.project for r in catalog.usual_project(catalog.from_files(spark, folder)).collect()] == ["-srv-one"]
