"""Schema drift between files, nested records, streaming guard, and every query against its SQL."""

import json

import duckdb
import pytest

from skein.functions.jsontext import parse
from skein.operators import drift, flatten
from skein.plans import catalog
from skein.streaming import guard, recovery

CALLS = "path string, line_index long, name string, call_id string, input string, extra string"
FILES = "path string, project string, mtime timestamp"


def changes(spark, calls, files):
    rows = [(p, 0, n, f"{p}{n}{i}", v if isinstance(v, str) or v is None else json.dumps(v), "x") for i, (p, n, v) in enumerate(calls)]
    values = drift.field_values(spark.createDataFrame(rows + rows[:1], CALLS))
    import datetime as dt

    known = spark.createDataFrame([(p, pr, dt.datetime(2030, 1, d)) for p, pr, d in files] * 2, FILES)
    return {(r.path, r.name, r.change, r.old_field, r.new_field) for r in drift.schema_changes(values, known).collect()}


def test_changes(spark):
    calls = [("f1", "A", {"id": "1", "n": 5, "gone": True, "o": {"x": 7}, "l": [1, 2], "z": None}), ("f1", "A", {"id": "2", "n": 6}), ("f1", "A", "{cut"), ("f1", "A", None),
             ("f2", "A", {"Id": 1, "n": "5", "t": [{"k": 8}, {"k": None}], "l": []}), ("f3", "B", {"q": 1}), ("f9", "A", {"w": 1})]
    assert changes(spark, calls, [("f1", "p", 1), ("f2", "p", 2), ("f3", "p", 3)]) == {
        ("f2", "A", "renamed", "id", "Id"), ("f2", "A", "retyped", "id", "Id"), ("f2", "A", "retyped", "n", "n"),
        ("f2", "A", "removed", "gone", ""), ("f2", "A", "removed", "o.x", ""), ("f2", "A", "added", "", "t[].k"),
    }


def test_lattice_and_union(spark):
    rows = [("f1", 0, "A", "c1", '{"id":"x1","n":1,"b":true}', ""), ("f2", 0, "A", "c2", '{"ID":"x1","n":"q","b":false}', ""), ("f2", 1, "A", "c3", "{}", "")]
    import datetime as dt

    files = spark.createDataFrame([("f1", "p", dt.datetime(2030, 1, 1)), ("f2", "p", dt.datetime(2030, 1, 2))], FILES)
    out = drift.unified_calls(spark.createDataFrame(rows, CALLS), files)
    types = dict(out.dtypes)
    assert types["n"] == "string" and types["b"] == "boolean" and len([c for c in out.columns if c.lower() == "id"]) == 1
    assert {r.call_id: (r[3:6]) for r in out.collect()}.keys() == {"c1", "c2", "c3"}
    empty = spark.createDataFrame([], CALLS)
    assert drift.schema_changes(drift.field_values(empty), files).count() == 0 and drift.unified_calls(empty, files).count() == 0


def test_numbers_keep_their_digits(spark):
    import datetime as dt
    from decimal import Decimal

    inputs = [
        {"a": 9007199254740993, "b": 1, "c": 9007199254740993, "d": 1e300, "e": 3, "f": True, "w": {"x": 1}}, {"a": 2, "b": 0.5, "c": 0.25, "d": 9007199254740993, "e": 10**30, "f": False}, {"a": -1, "e": "x", "w": {"x": None}},
    ]
    rows = [("f1", i, "A", f"c{i}", json.dumps(v), "") for i, v in enumerate(inputs)]
    files = spark.createDataFrame([("f1", "p", dt.datetime(2030, 1, 1))], FILES)
    out = drift.unified_calls(spark.createDataFrame(rows, CALLS), files)
    assert {k: v for k, v in out.dtypes if k in "abcdef"} == {"a": "bigint", "b": "double", "c": "decimal(38,18)", "d": "string", "e": "string", "f": "boolean"}
    got = {r.call_id: r for r in out.collect()}
    assert got["c0"].a == 9007199254740993 and got["c0"].c == Decimal(9007199254740993) and got["c1"].d == "9007199254740993" and got["c1"].e == str(10**30) and got["c1"].b == 0.5
    as_map = drift.unified_calls(spark.createDataFrame(rows, CALLS), files, most_fields=2)
    assert {r.call_id: r.fields for r in as_map.collect()}["c2"] == {"a": "-1", "e": "x"}


def test_any_number_of_fields_gets_typed_columns(spark):
    inputs = [{f"f{i:05d}": i for i in range(k, min(k + 100, 5001))} for k in range(0, 5001, 100)] + [{"ID": 1, "Id": "x", "path": 2, "Path": True}]
    rows = [("f1", i, "A", f"c{i}", json.dumps(v), "") for i, v in enumerate(inputs)]
    out = drift.unified_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([("f1", "p", None)], FILES))
    types = dict(out.dtypes)
    assert "fields" not in types and [types.get(f"f{i:05d}") for i in range(5001)] == ["bigint"] * 5001
    assert {k: types[k] for k in list(types)[3:] if k[0] != "f"} == {"ID": "bigint", "input.Id": "string", "input.input.Path": "boolean", "input.path": "bigint"}
    last = out.where("call_id = 'c50'").select("f04999", "f05000").collect()
    assert [tuple(r) for r in last] == [(None, 5000)]


def test_calls_keep_their_rows_however_fields_are_placed(spark):
    inputs = [("c1", {"a": 1}), ("c1", {"a": 2, "b": "x"}), (None, {"a": 3}), ("c2", {}), ("c1", {"a": 1})]
    rows = [("f1", i, "A", c, json.dumps(v), "") for i, (c, v) in enumerate(inputs)]
    files = spark.createDataFrame([("f1", "p", None)], FILES)
    for most in (0, 1, 2, 5000):
        got = drift.unified_calls(spark.createDataFrame(rows, CALLS), files, most_fields=most).collect()
        assert sorted((r.call_id or "", sorted(r.fields.items())) for r in got) == [("", [("a", "3")]), ("c1", [("a", "1")]), ("c1", [("a", "2"), ("b", "x")]), ("c2", [])]
    wide = drift.unified_calls(spark.createDataFrame(rows, CALLS), files).collect()
    assert {(r.call_id, r.a, r.b) for r in wide} == {(None, 3, None), ("c1", 1, None), ("c1", 2, "x"), ("c2", None, None)} and len(wide) == 4


def test_files_are_numbered_across_days(spark):
    import datetime as dt

    files = spark.createDataFrame([(f"f{i}", "p", dt.datetime(2030, 1, 1 + i // 3, i) if i else None) for i in range(12)], FILES)
    known = spark.createDataFrame([(f"f{i}", "A") for i in range(12)], "path string, name string")
    assert {r.path: r.no for r in drift._sequence(known, files).collect()} == {f"f{i}": i + 1 for i in range(12)}


def test_strict_json():
    assert parse('{"a":NaN}') is None and parse("[1.0,1]") == ["1.0", "1"] and parse(None) is None and parse("") is None and parse('{"a":1,"a":2}') == {"a": "2"}


def test_nested_records(spark):
    message = {"content": [{"input": json.dumps({"x": [1, {"y": [[{"z": 1}]]}]})}, "s", [{"d": 1}]], "usage": {"it": [{"n": 1}]}}
    raws = [json.dumps({"message": message}), json.dumps({"message": json.dumps({"content": [{"a": "[{}]"}]})}), "no json", "[1]", json.dumps({"message": "text"}), json.dumps({"message": None}), None, "", json.dumps({"message": [{"a": 1}]})]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(raws)] * 2 + [(None, raws[0], "")], "line_id long, raw string, node_path string")
    got = {tuple(r) for r in flatten.element_paths(df).collect()}
    assert got == {
        (0, "content[0]", ""), (0, "content[0].input.x[1]", "content[0]"), (0, "content[0].input.x[1].y[0][0]", "content[0].input.x[1]"), (0, "content[2][0]", ""),
        (0, "usage.it[0]", ""), (1, "content[0]", ""), (8, "[0]", ""),
    }
    nodes = flatten.flat_nodes(df)
    assert {(r.line_id, r.node_path, r.parent_path) for r in nodes.where("parent_path is not null").collect()} == got
    child = flatten.child_table(df, "content[].input.x[].y[][]").collect()
    assert [(r.line_id, r.ordinal, r.z) for r in child] == [(0, 0, "1")]
    assert flatten.merged_schema(df).count() > 0 and flatten.flat_nodes(df.limit(0)).count() == 0


def test_levels_of_deep_records(spark):
    deep: object = {"end": [{}]}
    for i in range(60):
        deep = {"k.x": deep} if i % 3 else [0, deep]
    many = [{"a": [{"b": [{"input": json.dumps({"c": [{}, 1, {}]})}]}]}] * 3
    df = spark.createDataFrame([(1, json.dumps({"message": {"content": deep}})), (2, json.dumps({"message": {"content": many}}))], "line_id long, raw string")
    want = {(line, p, up, t, i) for line, message in ((1, {"content": deep}), (2, {"content": many})) for p, up, t, i, _ in flatten.nodes(message)}
    for most in (64, 5):
        assert {tuple(r) for r in flatten.element_rows(df, most, 3).collect()} == want
    assert flatten.element_rows(df.limit(0)).count() == 0


def test_lines_and_scalar_elements(spark):
    message = {"content": ["s", {"n": 1, "tags": ["a", "b"], "#": [[1, None], [], [2.0]]}, 7, None, True]}
    raws = [
        json.dumps({"type": "user", "cwd": "/x", "extra": {"a": 1}, "message": message, "todos": [{"id": 1}, "t"]}), json.dumps({"uuid": "u", "message": "plain"}), json.dumps({"uuid": "v"}), "no json", "[1,{\"a\":2}]", '"text"',
        json.dumps({"message": ["m", {"a": 1}]}), json.dumps({"message": json.dumps({"role": "r"})}), None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)] * 2, "line_id long, raw string")
    rows = flatten.flat_rows(df).collect()
    assert {(r.line_id, r.node_path): (r.parent_path, r.table_path, r.ordinal, r.fields) for r in rows} == {
        (0, "$"): (None, "$", None, {"type": "user", "cwd": "/x", "extra.a": "1"}), (0, "$.todos[0]"): ("$", "$.todos[]", 0, {"id": "1"}), (0, "$.todos[1]"): ("$", "$.todos[]", 1, {"#value": "t"}), (0, ""): ("$", "", None, {}),
        (0, "content[0]"): ("", "content[]", 0, {"#value": "s"}), (0, "content[1]"): ("", "content[]", 1, {"n": "1", "tags": '["a","b"]'}), (0, "content[2]"): ("", "content[]", 2, {"#value": "7"}), (0, "content[4]"): ("", "content[]", 4, {"#value": "true"}),
        (0, "content[1].#[0][0]"): ("content[1]", "content[].#[][]", 0, {"#value": "1"}), (0, "content[1].#[2][0]"): ("content[1]", "content[].#[][]", 0, {"#value": "2.0"}),
        (1, "$"): (None, "$", None, {"uuid": "u", "message": "plain"}), (2, "$"): (None, "$", None, {"uuid": "v"}), (4, "$"): (None, "$", None, {}), (4, "$[0]"): ("$", "$[]", 0, {"#value": "1"}), (4, "$[1]"): ("$", "$[]", 1, {"a": "2"}),
        (5, "$"): (None, "$", None, {"#value": "text"}), (6, "$"): (None, "$", None, {}), (6, ""): ("$", "", None, {}), (6, "[0]"): ("", "[]", 0, {"#value": "m"}), (6, "[1]"): ("", "[]", 1, {"a": "1"}), (7, "$"): (None, "$", None, {}), (7, ""): ("$", "", None, {"role": "r"}),
    } and len(rows) == 22


def test_tables_laid_out_by_the_merged_schema(spark, tmp_path):
    raws = ['{"type":"a","message":{"content":[{"x":1},{"y":"s"},"t"]}}', '{"cwd":"/c","message":{}}', '{"message":[[{}]]}']
    df = spark.createDataFrame(list(enumerate(raws)), "line_id long, raw string")
    df.write.parquet(str(tmp_path / "transcript_lines.parquet"))
    got = {(r.table_path, r.line_id, r.node_path): (r.parent_path, r.ordinal, r.columns) for r in catalog.queries()["p6_tables"](spark, str(tmp_path)).collect()}
    assert got == {
        ("$", 0, "$"): (None, None, '{"cwd":null,"type":"a"}'), ("$", 1, "$"): (None, None, '{"cwd":"/c","type":null}'), ("$", 2, "$"): (None, None, '{"cwd":null,"type":null}'),
        ("", 0, ""): ("$", None, "{}"), ("", 1, ""): ("$", None, "{}"), ("", 2, ""): ("$", None, "{}"), ("[][]", 2, "[0][0]"): ("", 0, "{}"),
        ("content[]", 0, "content[0]"): ("", 0, '{"#value":null,"x":"1","y":null}'), ("content[]", 0, "content[1]"): ("", 1, '{"#value":null,"x":null,"y":"s"}'), ("content[]", 0, "content[2]"): ("", 2, '{"#value":"t","x":null,"y":null}'),
    }
    fields = {(r.table_path, r.field) for r in flatten.merged_schema(df).collect()}
    assert fields == {("$", "cwd"), ("$", "type"), ("content[]", "#value"), ("content[]", "x"), ("content[]", "y")}


def test_tail_reaches_as_far_as_the_reference(spark, messages, tmp_path):
    usage = (1, 2, 3, 4)
    rows = [{"line_index": 0, "type": "assistant", "message_id": "m", "model": "x", "usage": usage, "byte_size": 100}] + [{"line_index": i, "type": "user", "byte_size": 2000} for i in range(1, 20)]
    messages(rows).write.parquet(str(tmp_path / "messages.parquet"))
    assert catalog.queries()["tail_tokens"](spark, str(tmp_path)).count() == 0
    assert [r.session_id for r in catalog.queries()["tail_tokens_50k"](spark, str(tmp_path)).collect()] == ["s"]


def test_deep_nesting(spark):
    deep = '{"message":' + '{"a":[' * 200 + "1" + "]}" * 200 + "}"
    df = spark.createDataFrame([(1, deep)], "line_id long, raw string")
    assert flatten.element_paths(df).count() == 199


def test_guard_stream(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    schema = "session_id string, byte_size long"
    rises = []
    for batch in ([("a", 50), ("b", 5)], [("a", 20)], [("a", 40), ("b", 200)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        guard.start_guard(stream, state, str(tmp_path / "ck"), hard=100, soft=60, on_tier=lambda e, n: rises.extend((r.session_id, r.tier) for r in e.collect()), available_now=True).awaitTermination()
    assert sorted(rises) == [("a", "hard"), ("a", "soft"), ("b", "hard")]


def test_ladder(spark, tmp_path):
    past = spark.createDataFrame([("a", 10.0), ("a", 290.0), ("b", 290.0), ("b", 291.0), ("b", 299.0)], "key string, at double")
    breaker = recovery.Breaker(spark, str(tmp_path / "recoveries"))
    breaker.record(past.selectExpr("key", "at", "'gentle' as prescription", "1 as bytes_before", "1 as bytes_after"))
    assert {r.key: (r.recent, r.allowed, r.prescription) for r in breaker.state(past, 311.0).collect()} == {"a": (1, True, "standard"), "b": (3, False, None)}


def test_overflow_mark(spark, tmp_path):
    mark = "x Conversation too long y"
    texts = {"a": f"one\n{mark}\n", "b": "fine\n", "early": mark + "\nline" * 20, "small": mark, "far": mark + "\n" + "z" * 200_000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame([(n, str(tmp_path / n), 1 if n == "small" else 100) for n in texts], "session_id string, path string, bytes long")
    assert [r.session_id for r in recovery.overflowed(files, 50).collect()] == ["a"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, data, name):
    compare(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


def compare(spark, data, query, sql):
    import collections
    import os

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    df = query(spark, data)
    names = sorted(df.columns)
    flat = lambda rows: collections.Counter(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    got = flat(df.select(*names).collect())
    want = flat(con.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({sql})").fetchall())
    assert got == want
