"""A tool server: the calls of skein.api over standard input and output, as JSON-RPC 2.0 lines of the Model Context Protocol.

    python -m skein.server FOLDER

Each request is one line, each answer one line; answers of tools are tables in JSON text.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from skein import api

#: Rows of a table that one answer holds.
ROWS = 200
VERSION = "2024-11-05"


def tools(spark: SparkSession, folder: str) -> dict[str, tuple[str, dict, Callable[..., DataFrame]]]:
    """Name -> (description, properties of the arguments, function)."""
    text = {"type": "string"}
    session = {"session": {**text, "description": "id, the beginning of one, a .jsonl path, or current"}}

    def one(session: str = "current") -> str:
        found = api.resolve(spark, folder, session).select("session_id").collect()
        if not found:
            raise ValueError(f"no session {session}")
        return found[0].session_id

    return {
        "diagnose": ("Sizes, types, largest lines and token estimate of a session", session, lambda session="current": api.diagnose(spark, folder, one(session))),
        "estimate_tokens": ("Tokens of a session and the share of its context window", session, lambda session="current": api.estimate_tokens(spark, folder, one(session))),
        "list_sessions": ("All sessions, largest first", {"project": text}, lambda project=None: api.list_sessions(spark, folder, project)),
        "treat_session": (
            "Runs a prescription on a session; without write_to nothing is written", {**session, "prescription": {"enum": ["gentle", "standard", "aggressive"]}, "write_to": text, "version": text},
            lambda session="current", prescription="standard", write_to=None, version="1": api.treat(spark, folder, prescription, one(session), protect_team=True, write_to=write_to, version=version),
        ),
        "list_strategies": ("The operators, their tiers and prescriptions", {}, lambda: api.formulary(spark)),
    }


def answer(request: dict, known: dict) -> dict | None:
    """The answer to one request; None for notifications."""
    if "id" not in request:
        return None
    reply = lambda **body: {"jsonrpc": "2.0", "id": request["id"], **body}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply(result={"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "skein", "version": "1"}})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p, _) in known.items()]})
    if method != "tools/call":
        return reply(error={"code": -32601, "message": f"unknown method {method}"})
    name = params.get("name")
    if name not in known:
        return reply(error={"code": -32602, "message": f"unknown tool {name}"})
    try:
        rows = known[name][2](**(params.get("arguments") or {})).limit(ROWS).collect()
        body, failed = json.dumps([r.asDict(recursive=True) for r in rows], default=str), False
    except Exception as error:  # noqa: BLE001 - a tool's failure is its answer
        body, failed = str(error)[:2000], True
    return reply(result={"content": [{"type": "text", "text": body}], "isError": failed})


def serve(spark: SparkSession, folder: str, source: IO[str], sink: IO[str]) -> None:
    """Answers the requests of `source` until it ends."""
    known = tools(spark, folder)
    for line in source:
        try:
            request = json.loads(line)
        except ValueError:
            out: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            out = answer(request, known) if isinstance(request, dict) else None
        if out is not None:
            sink.write(json.dumps(out) + "\n")
            sink.flush()


if __name__ == "__main__":
    serve(SparkSession.builder.appName("skein-server").getOrCreate(), sys.argv[1], sys.stdin, sys.stdout)
