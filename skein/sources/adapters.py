"""Other tables in the form of session lines, so that every operator runs on them as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lines import chunk_of, numbered
from skein.operators.model import BLOCK, block_size, list_size

FRAME_BYTES = 100


def _block(**fields: Column) -> Column:
    types = [part.split(":", 1) for part in ("type:string", "text:string", "thinking:string", "signature:string", "id:string", "name:string", "input:string", "tool_use_id:string", "content_str:string")]
    base = [fields.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in types]
    base += [F.lit(None).cast("array<struct<type:string,text:string>>").alias("content_list"), fields.get("is_error", F.lit(None)).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("raw")]
    whole = F.struct(*base)
    names = [n for n, _ in types] + ["content_list", "is_error", "raw"]
    return F.struct(*[whole[n].alias(n) for n in names], block_size(whole).alias("size"))


def _line(df: DataFrame, block: Column | None, kind: Column, envelope: Column | None = None, more: list[str] | None = None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    blocks = F.array(block) if block is not None else F.expr("array()").cast(f"array<{BLOCK}>")
    out = df.withColumn("blocks", blocks).withColumn("content_size", list_size(F.col("blocks")).cast("long"))
    return out.select(
        "session_id", chunk_of(F.col("line_index")).alias("chunk"), "line_index", (F.col("content_size") + FRAME_BYTES).alias("byte_size"), (F.col("content_size") + FRAME_BYTES).alias("canonical_size"),
        "content_size", F.lit(False).alias("parse_error"), kind.alias("type"), null("string").alias("uuid"), F.lit(False).alias("is_sidechain"), null("string").alias("message_id"),
        F.lit(False).alias("is_snapshot_update"), null("string").alias("operation"), null("string").alias("root_content"), null("string").alias("model"), F.lit("list").alias("content_kind"), "blocks",
        (envelope if envelope is not None else F.expr("map()").cast("map<string,string>")).alias("envelope"), F.expr("map()").cast("map<string,string>").alias("inner"), *(more or []),
    )


def documents_as(documents: DataFrame, kind: str, text: Column | None = None, signed: int = 0) -> DataFrame:
    """Documents as lines of a session for each source, in order of doc_id, with one block of that kind.

    With `signed`, the block has a signature: so many first characters of the text.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    rows = rows.select(F.col("source").alias("session_id"), F.col("doc_id").alias("line_index"), (F.col("text") if text is None else text).alias("t")).distinct()
    field = {"thinking": "thinking", "tool_result": "content_str"}.get(kind, "text")
    return _line(rows, _block(type=F.lit(kind), **{field: F.col("t")}, **({"signature": F.substring("t", 1, signed)} if signed else {})), F.lit("assistant" if kind == "thinking" else "user"))


def _events(events: DataFrame) -> DataFrame:
    """Events numbered by user in order of time: session_id, line_index, event_type, k (of the properties)."""
    day = F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date"))
    rows = events.select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    rows = numbered(rows, ["user_id"], day, ["ts", "event_id"], "line_index")
    return rows.select(F.col("user_id").cast("string").alias("session_id"), "line_index", "event_type", "k")


def events_as_calls(events: DataFrame) -> DataFrame:
    """Events as lines of a session for each user, in order of time; an error is a failed result, all else a call.

    The calls' inputs are equal but for the order of their keys.
    """
    error = F.col("event_type") == "error"
    same = F.when(F.col("k").cast("int") % 2 == 0, '{"a": 1, "b": [2]}').otherwise('{"b":[2],"a":1}')
    call = _block(type=F.when(error, "tool_result").otherwise("tool_use"), name=F.when(~error, F.col("event_type")), input=F.when(~error, same), is_error=F.when(error, F.lit(True)))
    return _line(_events(events), call, F.lit("assistant"))


def events_as_files(events: DataFrame, chars: int = 600) -> DataFrame:
    """Events as lines of a session for each user: views read the file `k`, purchases edit it, clicks are results of reads of their kind, the remainder of `k` by three."""
    kind = F.col("event_type")
    call = (F.col("k").cast("int") % 3).cast("string")
    used = F.when(kind == "view", "Read").when(kind == "purchase", "Edit")
    block = _block(
        type=F.when(used.isNotNull(), "tool_use").when(kind == "click", "tool_result").otherwise("text"), name=used, id=F.when(used.isNotNull(), call),
        input=F.when(used.isNotNull(), F.to_json(F.struct(F.col("k").alias("file_path")))), tool_use_id=F.when(kind == "click", call), content_str=F.when(kind == "click", F.repeat(F.lit("x"), F.lit(chars))),
    )
    return _line(_events(events), block, F.lit("assistant"))


def _valid(calls: DataFrame) -> DataFrame:
    rows = calls.where(F.col("path").isNotNull() & F.col("line_index").isNotNull() & F.try_parse_json("input").isNotNull())
    return rows.select("path", "line_index", "call_id", "name", "input").distinct()


def _call_lines(calls: DataFrame) -> DataFrame:
    """Calls (path, line_index, call_id, name, input) as lines of a session for each file, in order of call_id within a line."""
    block = _block(type=F.lit("tool_use"), name=F.col("name"), id=F.col("call_id"), input=F.col("input"))
    rows = calls.groupBy(F.col("path").alias("session_id"), "line_index").agg(F.sort_array(F.collect_list(F.struct("call_id", block.alias("b")))).alias("all"))
    lines = _line(rows.withColumn("own", F.transform("all", lambda x: x["b"])), None, F.lit("assistant"), more=["own"])
    return lines.withColumn("blocks", F.col("own")).drop("own")


def calls_as_lines(calls: DataFrame) -> DataFrame:
    """Team calls with a valid input as lines of a session for each file."""
    return _call_lines(_valid(calls))


def calls_as_agents(calls: DataFrame) -> DataFrame:
    """Task calls as agents: a created task starts the agent of its taskId anew, an update stops it."""
    task = F.get_json_object("input", "$.taskId")
    start = F.to_json(F.struct(task.alias("resume"), F.get_json_object("input", "$.subject").alias("description"), F.lit("worker").alias("subagent_type")))
    rows = _valid(calls).where(F.col("name").isin("TaskCreate", "TaskUpdate"))
    name = F.when(F.col("name") == "TaskCreate", "Task").otherwise("TaskStop")
    return _call_lines(rows.select("path", "line_index", "call_id", name.alias("name"), F.when(F.col("name") == "TaskCreate", start).otherwise(F.to_json(F.struct(task.alias("task_id")))).alias("input")))


def tasks_from_calls(calls: DataFrame) -> DataFrame:
    """Task events of the tool-call table, for `team.merge_tasks`: path, task_id, at, created, and the task's fields."""
    rows = _valid(calls).where(F.col("name").isin("TaskCreate", "TaskUpdate"))
    field = lambda *names: F.coalesce(*[F.get_json_object("input", f"$.{n}") for n in names])
    return rows.select(
        "path", F.coalesce(field("taskId", "id"), F.lit("")).alias("task_id"), F.struct("line_index", "call_id").alias("at"), (F.col("name") == "TaskCreate").alias("created"),
        field("subject", "title").alias("subject"), field("status").alias("status"), field("owner").alias("owner"), field("description").alias("description"),
    )
