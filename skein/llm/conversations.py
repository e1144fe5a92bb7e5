"""Conversations rebuilt from message rows: reply order, cycles, role alternation, completeness.

The reply graph of a session (every line points to the line it answers) is sorted topologically with
Kahn's algorithm, of the lines that are free the earliest next. Lines that never become free lie on
a cycle or hang below one.

Kahn's algorithm runs inside chunks of bounded size. It gives every line the latest line it has to
wait for (its peak) and its depth among replies, as far as these lie in the chunk, and the line of
another chunk that its first ancestor answers, if any. These few lines of other chunks, the portals,
point to each other in the same way; their pointers are doubled, so the number of rounds is the
logarithm of the longest chain of chunks, and what points on after that lies on a cycle. Sorting by
(peak, depth, own time and number) is Kahn's order: a line in its natural place is its own peak, and
one that had to wait follows what it waited for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lines import nearest, once
from skein.session import CHUNK_LINES, cut


def _kahn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kahn's algorithm over whole chunks: adds peak_time, peak_line, depth, above (an ancestor's line in another chunk, if `leads`) and cyclic.

    Chunks are independent of each other, so those of a batch are sorted in one go.
    """
    chunk = pd.factorize(pd.MultiIndex.from_arrays([pdf["session_id"], pdf["chunk"]]))[0].tolist()
    lines, peak_time = pdf["line_index"].tolist(), pdf["time"].tolist()
    up, answers = pdf["up"].tolist(), pdf["answers"].tolist()
    inside = {place: i for i, place in enumerate(zip(chunk, lines))}
    parents = [inside.get((c, u), -1) if a else -1 for c, u, a in zip(chunk, up, answers)]
    children: dict[int, list[int]] = {}
    for i, parent in enumerate(parents):
        if parent >= 0:
            children.setdefault(parent, []).append(i)
    peak_line, depth, above, leads = list(lines), [0] * len(lines), list(up), list(answers)
    cyclic = [True] * len(lines)
    free = [i for i, parent in enumerate(parents) if parent < 0]
    for i in free:  # grows as lines become free
        cyclic[i] = False
        for child in children.get(i, ()):
            if (peak_time[i], peak_line[i]) > (peak_time[child], peak_line[child]):
                peak_time[child], peak_line[child] = peak_time[i], peak_line[i]
            depth[child], above[child], leads[child] = depth[i] + 1, above[i], leads[i]
            free.append(child)
    return pdf.assign(peak_time=peak_time, peak_line=peak_line, depth=depth, above=above, leads=[x and not c for x, c in zip(leads, cyclic)], cyclic=cyclic)


def _kahn_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by session and chunk: chunks are whole but for the last of a batch, which is kept for the next."""
    held = None
    for pdf in batches:
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (rows["session_id"] == rows["session_id"].iloc[-1]) & (rows["chunk"] == rows["chunk"].iloc[-1]) if len(rows) else None
        if last is None or last.all():
            held = rows
            continue
        yield _kahn(rows[~last])
        held = rows[last]
    if held is not None and len(held):
        yield _kahn(held)


def _doubled(portals: DataFrame) -> DataFrame:
    """Portals (session_id, line_index, peak, depth, above, cyclic) with all that lies above them taken in."""
    while True:
        up = portals.select("session_id", F.col("line_index").alias("above"), F.col("peak").alias("p"), F.col("depth").alias("d"), F.col("above").alias("a"), F.col("cyclic").alias("c"))
        next_ = portals.join(up, ["session_id", "above"], "left")
        known = F.col("p").isNotNull()
        # a pointer that has gone further than there are lines in the session goes round and round
        portals = cut(next_.select(
            "session_id", "line_index", F.when(known, F.greatest("peak", "p")).otherwise(F.col("peak")).alias("peak"), F.when(known, F.col("depth") + F.col("d") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(known, F.col("a")).alias("above"), (F.col("cyclic") | F.coalesce("c", F.lit(False))).alias("cyclic"), "most",
        ))
        on = portals.where(F.col("above").isNotNull() & ~F.col("cyclic") & (F.col("depth") <= F.col("most")))
        if on.isEmpty():
            return portals.select("session_id", "line_index", "peak", "depth", (F.col("cyclic") | F.col("above").isNotNull()).alias("cyclic"))


def _released(nodes: DataFrame) -> DataFrame:
    """Adds `key` and `cyclic` to nodes(session_id, chunk, line_index, time, parent_line, ...)."""
    rows = nodes.withColumn("up", F.coalesce("parent_line", F.lit(0))).withColumn("answers", F.col("parent_line").isNotNull()).drop("parent_line")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", peak_time bigint, peak_line bigint, depth bigint, above bigint, leads boolean, cyclic boolean"
    sorted_ = rows.repartition("session_id", "chunk").sortWithinPartitions("session_id", "chunk")
    done = cut(sorted_.mapInPandas(_kahn_batches, schema)).withColumn("peak", F.struct("peak_time", "peak_line"))
    done = done.withColumn("above", F.when(F.col("leads"), F.col("above"))).withColumn("parent_line", F.when(F.col("answers"), F.col("up")))
    wanted = done.where("above is not null").select("session_id", F.col("above").alias("line_index")).distinct()
    most = done.groupBy("session_id").agg(F.count(F.lit(1)).alias("most"))
    portals = cut(done.join(wanted, ["session_id", "line_index"]).join(most, "session_id").select("session_id", "line_index", "peak", "depth", "above", "cyclic", "most"))
    if not portals.isEmpty():
        far = _doubled(portals).select("session_id", F.col("line_index").alias("above"), F.col("peak").alias("p"), F.col("depth").alias("d"), F.col("cyclic").alias("c"))
        done = done.join(far, ["session_id", "above"], "left")
        done = done.withColumn("cyclic", F.col("cyclic") | F.coalesce("c", F.lit(False)))
        done = done.withColumn("peak", F.greatest("peak", "p")).withColumn("depth", F.col("depth") + F.coalesce(F.col("d") + 1, F.lit(0)))
    key = F.struct(F.col("peak.peak_time").alias("peak_time"), F.col("peak.peak_line").alias("peak_line"), "depth", "time", F.col("line_index").alias("line"))
    return done.select(*nodes.drop("chunk", "time").columns, F.when(~F.col("cyclic"), key).alias("key"), "cyclic")


def _name(session: str, uuid: str) -> Column:
    """A line's name in 128 bits; null without uuid."""
    return F.when(F.col(uuid).isNotNull(), F.struct(F.xxhash64(session, uuid).alias("a"), F.xxhash64(F.lit(1), session, uuid).alias("b")))


def _nodes(rows: DataFrame) -> DataFrame:
    """Lines (session_id, chunk, line_index, time, name, parent, ...) with parent_line and parent_missing instead of the names."""
    named = rows.where("name is not null").groupBy(F.col("name").alias("parent")).agg(F.min("line_index").alias("parent_line"))
    out = rows.drop("name").join(named, "parent", "left")
    return out.withColumn("parent_missing", F.col("parent").isNotNull() & F.col("parent_line").isNull()).drop("parent")


def _timed(rows: DataFrame) -> DataFrame:
    """`time` in microseconds; a line without one has that of the line before it."""
    rows = nearest(rows.withColumn("at", F.col("ts")), {"seen": F.col("ts")}, ["line_index"])
    time = F.unix_micros(F.coalesce("at", "seen").cast("timestamp"))
    return rows.withColumn("time", F.coalesce(time, F.lit(-(1 << 62)))).drop("at", "ts", "seen")


def reply_order(lines: DataFrame, chunk_lines: int = CHUNK_LINES, by_time: bool = True) -> DataFrame:
    """Kahn's order of every session's reply graph.

    Input: session_id, line_index, uuid, parent_uuid, ts, one row per line or repeated rows. Output,
    one row per line: session_id, line_index, parent_line, parent_missing, key, cyclic. Sorting a
    session by `key` gives its order; `key` is null where `cyclic`.

    Of lines that are free the earliest is next; a line without time has that of the line before
    it, and equal times go by line number (all do unless `by_time`). A null parent_uuid is a root;
    one that names no line of the session is a root too, with parent_missing set. Should a uuid name
    several lines of a session, the first is meant. Lines without uuid can't be answered but keep
    their place. Empty tables give no rows.
    """
    src = lines.select("session_id", "line_index", _name("session_id", "uuid").alias("name"), _name("session_id", "parent_uuid").alias("parent"), *(["ts"] if by_time else []))
    rows = once(src, ["session_id", "line_index"], ["name", "parent", *(["ts"] if by_time else [])], chunk_lines)
    rows = _timed(rows) if by_time else rows.withColumn("time", F.lit(0).cast("long"))
    return _released(_nodes(rows))


def _filled(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _spoken(lines: DataFrame) -> list[Column]:
    """Columns of a line: turn, speaker, has_text, has_content, uses, results, text; null where it is no turn."""
    blocks = F.coalesce(F.col("blocks"), F.expr("array()").cast(lines.schema["blocks"].dataType))
    turn = F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False)) & ~F.coalesce("is_sidechain", F.lit(False))
    kinds = lambda kind: F.filter(blocks, lambda b: b["type"] == kind)
    has_text = F.exists(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False)) & _filled(b["text"]))
    tools = F.exists(blocks, lambda b: F.coalesce(b["type"].isin("tool_use", "tool_result"), F.lit(False)))
    text = F.array_join(F.transform(kinds("text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return [
        turn.alias("turn"), F.when(turn, F.col("type")).alias("speaker"), (turn & has_text).alias("has_text"), (turn & (has_text | tools)).alias("has_content"),
        F.when(turn, F.transform(kinds("tool_use"), lambda b: b["id"])).alias("uses"), F.when(turn, F.transform(kinds("tool_result"), lambda b: b["tool_use_id"])).alias("results"),
        F.when(turn, text).alias("text"),
    ]


def conversation_turns(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The turns of every session with what they hold: session_id, chunk, line_index, speaker, has_text, has_content, uses, results (tool ids), text.

    Input: the columns of `messages`. Turns are lines of type user or assistant off side branches
    (a null is_sidechain is on the main one); `type` says who speaks, whatever the role column
    has. Blocks that are null count as none, text that is blank as no text; thinking alone is no
    content.
    """
    src = lines.select("session_id", "line_index", *_spoken(lines)).where("turn")
    return once(src, ["session_id", "line_index"], ["speaker", "has_text", "has_content", "uses", "results", "text"], chunk_lines)


def _no_reply(turns: DataFrame) -> DataFrame:
    """Sessions in which a user's text isn't answered before the next one or the end.

    Only two kinds of turns matter: U, a user's text, and A, an assistant turn with content; every
    U must be followed by an A. Each chunk is reduced to its first and last kind and to whether
    two U follow each other inside, then the chunks of a session are taken in order.
    """
    asks = (F.col("speaker") == "user") & F.col("has_text")
    answers = (F.col("speaker") == "assistant") & F.col("has_content")
    kinds = turns.where(asks | answers).select("session_id", "chunk", F.struct("line_index", asks.alias("u")).alias("e"))

    def unanswered(run: Column) -> Column:
        pairs = F.zip_with(F.slice(run, 1, F.size(run) - 1), F.slice(run, 2, F.size(run) - 1), lambda a, b: a["last"] & b["first"])
        return F.exists(pairs, lambda x: x)

    by_chunk = kinds.groupBy("session_id", "chunk").agg(F.sort_array(F.collect_list("e")).alias("run"))
    run = F.transform("run", lambda e: F.struct(e["u"].alias("first"), e["u"].alias("last")))
    by_chunk = by_chunk.select(
        "session_id", unanswered(run).alias("bad"),
        F.struct("chunk", F.col("run")[0]["u"].alias("first"), F.element_at("run", -1)["u"].alias("last")).alias("c"),
    )
    whole = by_chunk.groupBy("session_id").agg(F.max("bad").alias("bad"), F.sort_array(F.collect_list("c")).alias("run"))
    return whole.where(F.col("bad") | unanswered(F.col("run")) | F.element_at("run", -1)["last"]).select("session_id")


def session_defects(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One row for each defect of a session: session_id, defect.

    `empty`: no turn has content. `no_reply`: a user's text has no assistant turn with content
    before the next user's text or the end. `broken`: a tool_use without result in a later turn, a
    tool_result without use in an earlier turn (a null id is no match), a parent_uuid that names
    no line, or turns on a reply cycle. Turns follow each other by line_index.
    """
    names = [_name("session_id", "uuid").alias("name"), _name("session_id", "parent_uuid").alias("parent")]
    src = lines.select("session_id", "line_index", *names, *_spoken(lines)[:-1])
    kept = ["turn", "speaker", "has_text", "has_content", "uses", "results"]
    rows = cut(once(src, ["session_id", "line_index"], ["name", "parent", *kept], chunk_lines))
    order = _released(_nodes(rows.select("session_id", "chunk", "line_index", F.lit(0).cast("long").alias("time"), "name", "parent", "turn")))
    astray = order.where(F.col("turn") & (F.col("parent_missing") | F.col("cyclic"))).select("session_id")
    return _defects(rows.where("turn"), rows.select("session_id"), astray)


def _defects(turns: DataFrame, sessions: DataFrame, astray: DataFrame) -> DataFrame:
    """The defects of sessions, given their turns and those with turns astray in the reply graph."""
    filled = turns.where("has_content").select("session_id").distinct()
    empty = sessions.distinct().join(filled, "session_id", "left_anti")
    use = F.transform("uses", lambda i: F.struct(i.alias("id"), F.lit(True).alias("use")))
    result = F.transform("results", lambda i: F.struct(i.alias("id"), F.lit(False).alias("use")))
    tools = turns.select("session_id", "line_index", F.explode(F.concat(use, result)).alias("t"))
    tools = tools.select("session_id", "line_index", "t.*").groupBy("session_id", "id").agg(
        F.max(F.when(F.col("use"), F.col("line_index"))).alias("last_use"), F.min(F.when(F.col("use"), F.col("line_index"))).alias("first_use"),
        F.max(F.when(~F.col("use"), F.col("line_index"))).alias("last_result"), F.min(F.when(~F.col("use"), F.col("line_index"))).alias("first_result"),
    )
    matched = (F.col("last_result") > F.col("last_use")) & (F.col("first_use") < F.col("first_result"))
    lost = tools.where(F.col("id").isNull() | ~F.coalesce(matched, F.lit(False))).select("session_id")
    broken = lost.unionByName(astray).distinct()
    parts = (("empty", empty), ("no_reply", _no_reply(turns)), ("broken", broken))
    out = None
    for name, part in parts:
        part = part.select("session_id", F.lit(name).alias("defect"))
        out = part if out is None else out.unionByName(part)
    return out


def conversations(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The turns of the sessions without defect, sorted by (session_id, key), Kahn's order by time.

    Columns: session_id, key, line_index, speaker, text, uses, results. Neighbouring turns of one
    speaker stay separate rows, so a conversation is never gathered into one cell.
    """
    turns = cut(conversation_turns(lines, chunk_lines))
    order = cut(reply_order(lines, chunk_lines))
    at = turns.select("session_id", "line_index")
    astray = order.where(F.col("parent_missing") | F.col("cyclic")).join(at, ["session_id", "line_index"], "left_semi").select("session_id")
    unsound = _defects(turns, order.select("session_id"), astray).select("session_id").distinct()
    sound = turns.where("has_content").join(unsound, "session_id", "left_anti").join(order.select("session_id", "line_index", "key"), ["session_id", "line_index"])
    return sound.select("session_id", "key", "line_index", "speaker", "text", "uses", "results").orderBy("session_id", "key")
