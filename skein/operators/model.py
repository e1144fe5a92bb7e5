"""The message model: one row per line of a session, shredded, with the sizes rewriting needs.

session_id, line_index and chunk place a line; byte_size is its size as tracked, canonical_size
its size as compact ASCII JSON, content_size that part of it which message.content takes. `envelope`
holds root fields and `inner` fields of message as JSON text (null where absent), so that dropping
one is arithmetic. Blocks keep their own canonical size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import json_size, object_size, raw_json_size
from skein.operators.lines import once
from skein.session import CHUNK_LINES

BLOCK = (
    "struct<type:string,text:string,thinking:string,signature:string,id:string,name:string,input:string,tool_use_id:string,"
    "content_str:string,content_list:array<struct<type:string,text:string>>,is_error:boolean,raw:string,size:bigint>"
)
ENVELOPE = ("cwd", "version", "gitBranch", "slug", "userType", "isSidechain", "costUSD", "duration", "apiDuration")
INNER = ("usage", "stop_reason", "stop_sequence")
FIELDS = [
    "byte_size", "canonical_size", "content_size", "parse_error", "type", "uuid", "is_sidechain", "role", "message_id",
    "is_snapshot_update", "operation", "root_content", "model", "usage", "content_kind", "blocks", "envelope", "inner", "ts",
]
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def block_size(b: Column) -> Column:
    """Canonical size of a block from its fields."""
    nested = F.when(b["content_list"].isNotNull(), raw_json_size(F.to_json(b["content_list"])))
    return object_size([
        ("type", json_size(b["type"])), ("text", json_size(b["text"])), ("thinking", json_size(b["thinking"])),
        ("signature", json_size(b["signature"])), ("id", json_size(b["id"])), ("name", json_size(b["name"])),
        ("input", raw_json_size(b["input"])), ("tool_use_id", json_size(b["tool_use_id"])),
        ("content", F.coalesce(json_size(b["content_str"]), nested)), ("is_error", F.when(b["is_error"], 4).otherwise(F.when(b["is_error"].isNotNull(), 5))),
    ])


def list_size(blocks: Column) -> Column:
    """Canonical size of a content list."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["size"]) + F.greatest(F.size(blocks) - 1, F.lit(0)) + 2


def with_block(b: Column, **changes: Column) -> Column:
    """A copy of a block with fields changed and its size made right."""
    names = [f.split(":")[0] for f in ("type", "text", "thinking", "signature", "id", "name", "input", "tool_use_id", "content_str", "content_list", "is_error", "raw")]
    fields = {n: changes.get(n, b[n]) for n in names}
    new = F.struct(*[v.alias(n) for n, v in fields.items()])
    delta = F.lit(0).cast("long")
    for name in changes:
        json_name = "content" if name in ("content_str", "content_list") else name
        size = (lambda c, n=name: raw_json_size(F.to_json(c)) if n == "content_list" else json_size(c))
        part = lambda c: F.coalesce(size(c) + len(json_name) + 4, F.lit(0))  # noqa: B023, E731
        delta = delta + part(changes[name]) - part(b[name])
    return F.struct(*[new[n].alias(n) for n in fields], (b["size"] + delta).alias("size"))


def from_table(df: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The model from a shredded table without raw lines (as the `messages` table).

    Repeated lines count once. Null blocks become none; the canonical size is the tracked size.
    """
    def block(b):
        null = F.lit(None)
        fields = {n: b[n] for n in ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content_str", "is_error")}
        fields |= {"signature": null.cast("string"), "content_list": null.cast("array<struct<type:string,text:string>>"), "raw": null.cast("string")}
        order = ("type", "text", "thinking", "signature", "id", "name", "input", "tool_use_id", "content_str", "content_list", "is_error", "raw")
        base = F.struct(*[fields[n].alias(n) for n in order])
        return F.struct(*[base[n].alias(n) for n in order], block_size(base).alias("size"))

    columns = ["byte_size", "parse_error", "type", "uuid", "is_sidechain", "role", "message_id", "is_snapshot_update", "operation", "root_content", "model", "usage", "blocks", "ts"]
    rows = once(df, ["session_id", "line_index"], columns, chunk_lines)
    blocks = F.coalesce(F.transform("blocks", block), F.expr("array()").cast(f"array<{BLOCK}>"))
    envelope = F.create_map(F.lit("isSidechain"), F.col("is_sidechain").cast("string"))
    inner = F.create_map(F.lit("usage"), F.to_json("usage"))
    filled = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    rows = rows.withColumn("content_kind", F.when(F.col("blocks").isNull(), "none").otherwise("list")).withColumn("blocks", blocks)
    return rows.select(
        "session_id", "chunk", "line_index", "byte_size", F.col("byte_size").alias("canonical_size"),
        F.when(F.col("content_kind") == "list", list_size(F.col("blocks"))).otherwise(0).cast("long").alias("content_size"),
        F.coalesce("parse_error", F.lit(False)).alias("parse_error"), F.coalesce("type", F.lit("unknown")).alias("type"), "uuid", "is_sidechain", "role",
        "message_id", "is_snapshot_update", "operation", "root_content", "model", F.col("usage").cast(USAGE).alias("usage"), "content_kind", "blocks",
        filled(envelope).alias("envelope"), filled(inner).alias("inner"), F.col("ts").cast("timestamp").alias("ts"),
    )
