"""Conversations and runs: against brute force on small sessions, and on dirty rows."""

import heapq
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import conversations, registry, runs


def text(t):
    return {"type": "text", "text": t}


def use(i):
    return {"type": "tool_use", "id": i, "name": "n"}


def result(i):
    return {"type": "tool_result", "tool_use_id": i}


def defects(df, chunk=4096):
    return {tuple(r) for r in conversations.session_defects(df, chunk).collect()}


def session(name, *turns):
    """Turns as (type, blocks, more)."""
    return [{"session_id": name, "line_index": i * 2, "type": t[0], "blocks": t[1], "uuid": f"{name}{i}", **(t[2] if len(t) > 2 else {})} for i, t in enumerate(turns)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_defects(messages, chunk):
    rows = (
        session("good", ("user", [text("q")]), ("assistant", [text("a"), use("t")]), ("user", [result("t")]), ("assistant", [text("b")]))
        + session("empty", ("user", [text(" \n")]), ("assistant", [{"type": "thinking", "thinking": "x"}]), ("system", [text("z")]))
        + session("none", ("progress", None)) + session("side", ("user", [text("q")], {"is_sidechain": True}))
        + session("twice", ("user", [text("q")]), ("user", [text("r")]), ("assistant", [text("a")])) + session("end", ("assistant", [text("a")]), ("user", [text("q")]))
        + session("hollow", ("user", [text("q")]), ("assistant", None), ("assistant", [use("z")]), ("user", [result("z")]))
        + session("lost", ("assistant", [use("t")])) + session("early", ("user", [result("t")]), ("assistant", [use("t")])) + session("same", ("assistant", [use("t"), result("t")]))
        + session("parent", ("assistant", [text("a")], {"parent_uuid": "nowhere"})) + session("ok_parent", ("assistant", [text("a")]), ("assistant", [text("a")], {"parent_uuid": "ok_parent0"}))
        + session("nulls", ("user", [text("q")], {"is_sidechain": None}), ("assistant", [{"type": None}, text("a")]), (None, None))
    )
    assert defects(messages(rows + rows[:5]), chunk) == {
        ("empty", "empty"), ("none", "empty"), ("side", "empty"), ("twice", "no_reply"), ("end", "no_reply"), ("lost", "broken"), ("early", "broken"), ("same", "broken"), ("parent", "broken"),
    }


def test_sound_conversations(messages):
    rows = session("good", ("user", [text("q")]), ("assistant", [text("a")])) + session("bad", ("user", [text("q")]))
    df = messages(rows).withColumn("chunk", F.lit("clash")).withColumn("key", F.lit(1))
    assert [(r.session_id, r.speaker, r.text) for r in conversations.conversations(df).orderBy("key").collect()] == [("good", "user", "q"), ("good", "assistant", "a")]
    assert conversations.conversations(messages([])).count() == 0 and defects(messages([])) == set()


def kahn(parent, time):
    """Order and leftovers of one session by a heap: free lines by what they waited for, their depth, their own time and number."""
    own = [(t, i) for i, t in enumerate(time)]
    free, order = [(own[i], 0, own[i], i) for i in range(len(parent)) if parent[i] is None], []
    heapq.heapify(free)
    while free:
        peak, depth, _, i = heapq.heappop(free)
        order.append(i)
        for child in range(len(parent)):
            if parent[child] == i:
                heapq.heappush(free, (max(peak, own[child]), depth + 1, own[child], child))
    return order, sorted(set(range(len(parent))) - set(order))


@pytest.mark.parametrize("chunk", [5, 1, 4096])
def test_kahn_order_with_late_parents_cycles_and_times(spark, chunk):
    import datetime as dt

    random.seed(11)
    data, want = [], {}
    for s in range(25):
        n = random.randint(1, 25)
        parent = [None if random.random() < 0.25 else random.randrange(n) for _ in range(n)]
        time = [random.choice([1, 1, 2, 3, 9, None]) if s % 2 else 5 for _ in range(n)]
        filled = [next((t for t in reversed(time[: i + 1]) if t is not None), -1) for i in range(n)]
        want[f"s{s}"] = kahn(parent, filled)
        data += [(f"s{s}", i, f"u{i}", None if p is None else f"u{p}", None if time[i] is None else dt.datetime(2030, 1, 1, 0, 0, time[i])) for i, p in enumerate(parent)]
    got = {}
    lines = spark.createDataFrame(data, "session_id string, line_index long, uuid string, parent_uuid string, ts timestamp_ntz")
    for r in conversations.reply_order(lines, chunk).collect():
        got.setdefault(r.session_id, ([], []))[r.cyclic].append((r.key, r.line_index))
    assert {s: ([i for _, i in sorted(a)], sorted(i for _, i in b)) for s, (a, b) in got.items()} == want


def test_long_reversed_chains_take_few_rounds(spark):
    n = 200
    lines = spark.createDataFrame([("s", i, f"u{i}", f"u{i + 1}" if i < n - 1 else None, None) for i in range(n)], "session_id string, line_index long, uuid string, parent_uuid string, ts timestamp_ntz")
    status, before = spark.sparkContext.statusTracker(), max(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [0])
    rows = conversations.reply_order(lines, 1).collect()
    assert max(status.getJobIdsForGroup(None)) - before < 120
    assert [r.line_index for r in sorted(rows, key=lambda r: r.key)] == list(range(n - 1, -1, -1)) and not any(r.cyclic for r in rows)


@pytest.mark.parametrize("chunk", [4096, 4, 1])
def test_runs(messages, chunk):
    random.seed(3)
    rows = [{"session_id": f"s{s}", "line_index": i * 3, "type": random.choice("ab"), "name": random.choice(["x 1", "X", "x-2", None, "9", ""])} for s in range(4) for i in range(60)]
    expected, run = set(), []
    key = lambda r: (r["session_id"], r["type"], None if r["name"] is None else "".join(c for c in r["name"].lower() if c.isalpha()))
    for r in [*rows, {"session_id": "", "type": "", "name": ""}]:
        if run and key(r) != key(run[0]):
            if len(run) >= 3:
                expected.add((run[0]["session_id"], run[0]["line_index"], run[-1]["line_index"]))
            run = []
        run.append(r)
    df = messages(rows + rows[::7]).withColumn("chunk", F.lit(0))
    assert {tuple(r) for r in runs.repeated_runs(df, 3, chunk).collect()} == expected
    assert sum(r.events for r in runs.collapse_runs(df, chunk).collect()) == len(rows)


def test_run_durations(messages):
    import datetime as dt

    at = lambda s: dt.datetime(2030, 1, 1, 0, 0, s)
    rows = [{"line_index": i, "type": "a", "name": "n", "ts": t} for i, t in enumerate([at(1), None, at(9)])] + [{"line_index": 5, "type": "b", "ts": None}]
    assert {(r.first_line, r.events, r.duration_us) for r in runs.collapse_runs(messages(rows)).collect()} == {(0, 3, 8_000_000), (5, 1, None)}
    assert runs.collapse_runs(messages([])).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, data, name):
    import collections

    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    df = registry.queries()[name](spark, data)
    names = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({registry.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(str, (tuple(r) for r in df.select(*names).collect()))) == collections.Counter(map(str, want))
