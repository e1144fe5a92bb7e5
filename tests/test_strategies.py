"""The rewrite operators on lines of transcripts, and what rewriting saves to the byte."""

import json

import pytest

from skein.operators import executor, strategies
from skein.plans.prescriptions import PRESCRIPTIONS, STRATEGIES
from skein.sources import jsonl

PROGRESS = {"type": "progress", "data": {"type": "hook_progress"}}


def assistant(blocks, **root):
    return {"type": "assistant", "message": {"role": "assistant", "content": blocks}, **root}


def result(text, use="t1", **more):
    return {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": use, "content": text, **more}]}}


def use(name, path=None, id="t1", **given):
    return {"type": "tool_use", "id": id, "name": name, "input": ({"file_path": path} if path else {}) | given}


@pytest.fixture
def lines(spark):
    def make(values, session="s"):
        rows = [(session, i, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))) for i, v in enumerate(values)]
        return jsonl.from_raw(spark.createDataFrame(rows, "session_id string, line_index long, raw string"))

    return make


def act(lines, name, config=None):
    rows = STRATEGIES[name].function(lines, config or {}).collect()
    return {r.line_index for r in rows if r.action == "remove"}, {r.line_index: r for r in rows if r.action == "replace"}


def after(lines, name, config=None):
    done = executor.apply_actions(lines, STRATEGIES[name].function(lines, config or {}))
    sizes = {r.line_index: r.byte_size for r in done.collect()}
    texts = {r.line_index: r.value for r in jsonl.rendered(done).collect()}
    return sizes, texts


def test_progress_runs_keep_their_last(lines):
    user = {"type": "user", "message": {"role": "user", "content": "x"}}
    assert act(lines([PROGRESS, PROGRESS, PROGRESS, user, PROGRESS]), "progress-collapse") == ({0, 1}, {})
    assert act(lines([user, PROGRESS, user]), "progress-collapse") == (set(), {})


def test_snapshots(lines):
    snap = lambda i, update=False: {"type": "file-history-snapshot", "messageId": i, "isSnapshotUpdate": update}
    assert act(lines([snap("a"), snap("a"), snap("a")]), "file-history-dedup")[0] == {0, 1}
    assert act(lines([snap("a"), snap("b")]), "file-history-dedup")[0] == set()
    assert act(lines([snap("a", True), snap("b", True), snap("c", True)]), "file-history-dedup")[0] == {0, 1}


def test_metadata_and_cost_fields_go(lines):
    value = assistant([{"type": "text", "text": "hi"}], costUSD=0.5, duration=3)
    value["message"] |= {"usage": {"input_tokens": 1}, "stop_reason": "end"}
    sizes, texts = after(lines([value]), "metadata-strip")
    left = json.loads(texts[0])
    assert not {"costUSD", "duration"} & set(left) and not {"usage", "stop_reason"} & set(left["message"])
    assert sizes[0] == len(texts[0])


@pytest.mark.parametrize("mode,kinds", [("remove", ["text"]), ("truncate", ["thinking", "text"]), ("signature-only", ["thinking", "text"])])
def test_thinking(lines, mode, kinds):
    value = assistant([{"type": "thinking", "thinking": "é" * 500, "signature": "s" * 150}, {"type": "text", "text": "ok"}])
    sizes, texts = after(lines([value]), "thinking-blocks", {"thinking_mode": mode})
    blocks = json.loads(texts[0])["message"]["content"]
    assert [b["type"] for b in blocks] == kinds and not any("signature" in b for b in blocks)
    assert sizes[0] == len(texts[0])
    if mode == "truncate":
        assert blocks[0]["thinking"] == "é" * 200 + "...[truncated]"


def test_long_outputs_keep_their_ends(lines):
    text = "\n".join(f"line {i}" for i in range(200))
    sizes, texts = after(lines([result(text), result("x" * 9000)]), "tool-output-trim")
    first, second = (json.loads(texts[i])["message"]["content"][0]["content"] for i in (0, 1))
    assert first.startswith("line 0\n") and first.endswith("line 199") and "[100 lines trimmed" in first and first.count("line ") == 100
    assert second.startswith("x" * 4096 + "\n... [808 bytes trimmed") and sizes[1] == len(texts[1])


def test_growth_through_escapes_is_no_saving(lines):
    raw = json.dumps(result("é" * 100 + "\n" * 101), separators=(",", ":"), ensure_ascii=False)
    assert act(lines([raw]), "tool-output-trim", {"tool_output_max_lines": 100})[1] == {}


def test_stale_reads_by_line_and_window(lines):
    long = "y" * 501
    rows = [assistant([use("Read", "/a", "r1"), use("Read", "/b", "r2")]), result(long, "r1"), result(long, "r2"), result("y" * 500, "r1"), PROGRESS, result(long, "r1"), assistant([use("Edit", "/a", "e")])]
    _, replaced = act(lines(rows), "stale-reads")
    assert set(replaced) == {1, 2}
    assert "stale read" in replaced[1].new_blocks[0].content_str


def test_reminders(lines):
    tag = "<system-reminder>mind</system-reminder>"
    rows = [assistant([{"type": "text", "text": f"a{tag}{tag}"}]), assistant([{"type": "text", "text": f"b\n\n\n\n{tag}c"}, {"type": "text", "text": f"{tag} d"}])]
    _, texts = after(lines(rows), "system-reminder-dedup")
    assert json.loads(texts[0])["message"]["content"][0]["text"] == "a"
    assert [b["text"] for b in json.loads(texts[1])["message"]["content"]] == ["b\n\nc", "d"]


def test_http_runs(lines):
    call, answer = assistant([use("WebFetch")]), result("page")
    assert act(lines([call, answer, PROGRESS, call, answer]), "http-spam")[0] == {2}
    assert act(lines([call, PROGRESS, call]), "http-spam")[0] == set()
    assert act(lines([call, PROGRESS, answer, PROGRESS, call]), "http-spam")[0] == set()


def test_retries(lines):
    call, failed = assistant([use("Bash", command="x")]), result("no", is_error=True)
    assert act(lines([call, failed, call, failed, call, failed, call]), "error-retry-collapse")[0] == {1, 2, 3, 4}
    assert act(lines([call, failed, call]), "error-retry-collapse")[0] == set()
    other = assistant([use("Bash", command="z")])
    assert act(lines([call, failed, call, failed, other]), "error-retry-collapse")[0] == set()


def test_polls(lines):
    queue = lambda op: {"type": "queue-operation", "operation": op}
    assert act(lines([queue("check"), queue("poll"), queue("check"), queue("add")]), "background-poll-collapse")[0] == {0, 1}
    poll = lambda block: assistant([use("TaskOutput", block=block)])
    assert act(lines([poll(False), PROGRESS, poll(False), poll(False)]), "background-poll-collapse")[0] == {1, 2}
    assert act(lines([poll(0), poll(None), poll("false"), poll(0)]), "background-poll-collapse")[0] == set()


def test_document_copies(lines):
    text = "w" * 1024
    rows = [assistant([{"type": "text", "text": text}]), assistant([{"type": "text", "text": text}, {"type": "text", "text": text}]), assistant([{"type": "text", "text": "w" * 1023}]), assistant([{"type": "text", "text": "w" * 1023}])]
    _, replaced = act(lines(rows), "document-dedup")
    assert set(replaced) == {1} and [b.text[:10] for b in replaced[1].new_blocks] == ["[duplicate", "w" * 10]


def test_mega_blocks(lines):
    rows = [assistant([{"type": "text", "text": "q" * 32769}]), assistant([{"type": "text", "text": "q" * 32768}]), {"type": "summary", "message": {"content": [{"type": "text", "text": "q" * 40000}]}}]
    _, replaced = act(lines(rows), "mega-block-trim")
    assert set(replaced) == set()  # the marker is longer than the single byte that goes
    _, replaced = act(lines([assistant([{"type": "text", "text": "q" * 40000}]), rows[2]]), "mega-block-trim")
    assert set(replaced) == {0}


def test_constant_envelope(lines):
    user = lambda v: {"type": "user", "cwd": "/w", "version": v, "message": {"role": "user", "content": "x"}}
    sizes, texts = after(lines([user("1"), user("1"), {**user("2"), "slug": "once"}]), "envelope-strip")
    assert [set(json.loads(texts[i])) & {"cwd", "version", "slug"} for i in range(3)] == [{"cwd", "version"}, {"version"}, {"version"}]
    assert sizes[1] == len(texts[1])


def test_chunks_make_no_difference(lines):
    values = [PROGRESS, PROGRESS, assistant([use("WebFetch")]), result("a"), PROGRESS, assistant([use("WebFetch")]), PROGRESS, PROGRESS] * 6
    whole = lines(values)
    cut = whole.withColumn("chunk", (whole["line_index"] / 3).cast("long"))
    for name in STRATEGIES:
        assert act(whole, name) == act(cut, name), name


def test_executor(spark, lines):
    base = lines([PROGRESS, assistant([{"type": "text", "text": "abc"}]), assistant([{"type": "text", "text": "def"}])])
    removal = strategies._removed(base.where("line_index < 2"), "r")
    from pyspark.sql import functions as F

    new = F.transform("blocks", lambda b: strategies.with_block(b, text=F.lit("z")))
    first = strategies._replaced(base.where("line_index > 0").withColumn("_n", new), F.lit(10), F.lit("one"), F.col("_n"), order=F.lit(1))
    second = strategies._replaced(base.where("line_index > 0").withColumn("_n", new), F.lit(5), F.lit("two"), F.col("_n"), order=F.lit(2))
    out = executor.apply_actions(base, removal.unionByName(first).unionByName(second)).collect()
    assert [(r.line_index, r.byte_size, r.blocks[0].text) for r in out] == [(2, 5, "z")]


def test_prescriptions(lines):
    assert [len(PRESCRIPTIONS[n]) for n in ("gentle", "standard", "aggressive")] == [3, 7, 13]
    base = lines([PROGRESS, PROGRESS, assistant([{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "x"}])])
    out, reports = executor.run_strategies(base, ["progress-collapse", "no-such-thing", "thinking-blocks"])
    saved = sum(r.saved_bytes for report in reports for r in report.collect())
    total = lambda df: sum(r.byte_size for r in df.collect())
    assert len(reports) == 2 and total(base) - total(out) == saved
    again, _ = executor.run_strategies(out, ["progress-collapse"])
    assert total(again) == total(out)


def test_empty_input(spark, lines):
    none = jsonl.from_raw(spark.createDataFrame([], "session_id string, line_index long, raw string"))
    for name in STRATEGIES:
        assert act(none, name) == (set(), {}), name
