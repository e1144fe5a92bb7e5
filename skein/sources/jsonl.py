"""Transcript files of JSON lines: read into the message model, written back as new versions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.lines import chunk_of
from skein.operators.model import BLOCK, ENVELOPE, INNER, USAGE

MODEL = (
    "session_id string, chunk long, line_index long, byte_size long, canonical_size long, content_size long, parse_error boolean, type string, uuid string, is_sidechain boolean, role string, "
    f"message_id string, is_snapshot_update boolean, operation string, root_content string, model string, usage {USAGE}, content_kind string, blocks array<{BLOCK}>, "
    "envelope map<string,string>, inner map<string,string>, ts timestamp, raw string"
)


def canonical(value) -> str:
    """Compact JSON with everything outside ASCII escaped; its length is the canonical size."""
    return json.dumps(value, separators=(",", ":"))


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def shred_block(block: dict) -> dict:
    """A content block in the model's form."""
    content = block.get("content")
    listed = [{"type": _text(x.get("type")), "text": _text(x.get("text"))} for x in content if isinstance(x, dict)] if isinstance(content, list) else None
    fields = {n: _text(block.get(n)) for n in ("type", "text", "thinking", "signature", "id", "name", "tool_use_id")}
    fields["input"] = canonical(block["input"]) if "input" in block else None
    fields |= {"content_str": _text(content), "content_list": listed, "is_error": bool(block["is_error"]) if block.get("is_error") is not None else None}
    return fields | {"raw": canonical(block), "size": len(canonical(block))}


def shred_line(raw: str) -> dict:
    """A line in the model's form; what is no JSON object is kept as a line of type unknown."""
    value = _loads(raw)
    row = dict.fromkeys(("uuid", "is_sidechain", "role", "message_id", "is_snapshot_update", "operation", "root_content", "model", "usage"))
    row |= {"byte_size": len(raw.encode("utf-8", "surrogatepass")), "parse_error": value is None and raw.strip() != "null", "type": "unknown", "content_kind": "none", "blocks": [], "envelope": {}, "inner": {}, "content_size": 0, "ts": None, "raw": raw}
    row["canonical_size"] = len(canonical(value)) if value is not None else row["byte_size"]
    if not isinstance(value, dict):
        return row
    message = value.get("message") if isinstance(value.get("message"), dict) else {}
    content = message.get("content")
    if isinstance(content, list):
        blocks, kind = [shred_block(b) for b in content if isinstance(b, dict)], "list"
    elif isinstance(content, str):
        blocks, kind = [shred_block({"type": "text", "text": content})], "string"
    else:
        blocks, kind = [], "none"
    usage = message.get("usage") if isinstance(message.get("usage"), dict) and message.get("usage") else None
    whole = lambda n: usage.get(n) if isinstance(usage.get(n), int) else 0
    row |= {
        "type": str(value["type"]) if value.get("type") is not None else "unknown", "uuid": _text(value.get("uuid")), "is_sidechain": bool(value["isSidechain"]) if "isSidechain" in value else None,
        "role": _text(message.get("role")), "message_id": _text(value.get("messageId")), "is_snapshot_update": bool(value.get("isSnapshotUpdate")), "operation": _text(value.get("operation")),
        "root_content": _text(value.get("content")), "model": _text(message.get("model")), "blocks": blocks, "content_kind": kind, "content_size": len(canonical(content)) if kind != "none" else 0,
        "usage": {n: whole(n) for n in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")} if usage else None,
        "envelope": {k: canonical(value[k]) for k in ENVELOPE if k in value}, "inner": {k: canonical(message[k]) for k in INNER if k in message},
        "ts": pd.to_datetime(_text(value.get("timestamp")), errors="coerce", utc=True),
    }
    return row


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.strip().split(" ")[0] for part in _split(MODEL)]
    for pdf in batches:
        rows = [shred_line(raw) | {"session_id": s, "chunk": c, "line_index": i} for s, c, i, raw in zip(pdf["session_id"], pdf["chunk"], pdf["line_index"], pdf["raw"])]
        out = pd.DataFrame(rows, columns=names)
        out["ts"] = pd.to_datetime(out["ts"], utc=True)
        yield out


def _split(schema: str) -> list[str]:
    parts, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id, line_index, raw of the *.jsonl files below a path; blank lines count, but give no row.

    Files are read in splits. A line's number is its place in its split, as the scan numbers rows of
    a partition one by one, after the lines of the file's splits before, of which there is one row each.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    meta = F.col("_metadata")
    rows = text.select("value", meta["file_path"].alias("file"), meta["file_name"].alias("name"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = rows.join(splits, ["file", "split"])
    raw = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    session = F.regexp_extract("name", r"^(.*)\.jsonl$", 1)
    return lines.select(session.alias("session_id"), (F.col("before") + F.col("at") - F.col("first")).cast("long").alias("line_index"), raw.alias("raw")).where(F.length("raw") > 0)


def from_raw(lines: DataFrame) -> DataFrame:
    """The message model of raw lines (session_id, line_index, raw)."""
    rows = lines.select("session_id", chunk_of(F.col("line_index")).alias("chunk"), "line_index", "raw").where(F.col("raw").isNotNull())
    return rows.repartition("session_id", "chunk").mapInPandas(_shred, MODEL)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The message model of the transcript files below a path."""
    return from_raw(raw_lines(spark, path))


def render_line(raw: str, kind: str, blocks, envelope: dict, inner: dict, changed: bool) -> str:
    """A line's JSON text: as it came if nothing changed in it, else with the model's content and fields."""
    value = _loads(raw)
    if not isinstance(value, dict):
        return raw
    message = value.get("message") if isinstance(value.get("message"), dict) else None
    for key in [k for k in ENVELOPE if k in value and k not in envelope]:
        del value[key]
    for key in [k for k in INNER if message and k in message and k not in inner]:
        del message[key]
    if changed and message is not None:
        out = []
        for b in blocks:
            block = _loads(b["raw"])
            if b["signature"] is None:
                block.pop("signature", None)
            for name in ("text", "thinking"):
                if b[name] is not None:
                    block[name] = b[name]
            if b["content_str"] is not None:
                block["content"] = b["content_str"]
            elif b["content_list"] is not None and isinstance(block.get("content"), list):
                texts = iter(b["content_list"])
                block["content"] = [{**x, "text": t["text"]} if isinstance(x, dict) and (t := next(texts))["text"] is not None else x for x in block["content"]]
            out.append(block)
        message["content"] = out
    return canonical(value)


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for r in pdf.itertuples(index=False):
            old, blocks = shred_line(r.raw), [dict(b) for b in r.blocks]
            same = [(b["text"], b["thinking"], b["signature"], b["content_str"], b["size"]) for b in blocks] == [(b["text"], b["thinking"], b["signature"], b["content_str"], b["size"]) for b in old["blocks"]]
            texts.append(render_line(r.raw, r.content_kind, blocks, dict(r.envelope), dict(r.inner), not same))
        yield pd.DataFrame({"session_id": pdf["session_id"], "line_index": pdf["line_index"], "value": texts})


def rendered(lines: DataFrame) -> DataFrame:
    """session_id, line_index, value: the lines of a model read from files, as JSON text."""
    return lines.select("session_id", "line_index", "raw", "content_kind", "blocks", "envelope", "inner").mapInPandas(_render, "session_id string, line_index long, value string")


def write_version(lines: DataFrame, path: str, version: str) -> str:
    """Writes every session's lines in order to a new folder and returns it; nothing is overwritten.

    The version before stays as the backup. One session's chunks are written in line order.
    """
    target = f"{path.rstrip('/')}/version={version}"
    ordered = rendered(lines).repartitionByRange("session_id", "line_index").sortWithinPartitions("session_id", "line_index")
    ordered.select("value", "session_id").write.mode("errorifexists").partitionBy("session_id").text(target)
    return target


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Team configurations (*/config.json below a path); files that are no JSON are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "config.json").text(path, wholetext=True)
    schema = "name string, leadAgentId string, leadSessionId string, createdAt long, members array<struct<agentId:string,name:string,agentType:string,model:string,cwd:string>>"
    return files.select(F.from_json("value", schema).alias("c"), F.col("_metadata.file_path").alias("path")).where("c.name is not null or c.members is not null").select("c.*", "path")


def merge_settings(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Settings entries with the wanted ones that are missing: keyed by event and matcher; idempotent."""
    key = lambda df: df.withColumn("_m", F.coalesce("matcher", F.lit("")))
    missing = key(wanted).join(key(existing).select("event", "_m"), ["event", "_m"], "left_anti").select(*wanted.columns)
    return existing.unionByName(missing)


__all__ = ["canonical", "from_raw", "merge_settings", "raw_lines", "read_configs", "read_sessions", "rendered", "write_version"]
