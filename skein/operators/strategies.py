"""The thirteen rewrite operators: message model in, actions out.

An action removes a line or replaces its content: session_id, line_index, ord, action, reason,
original_bytes, pruned_bytes, and for replacements the new blocks, envelope and inner fields. All
are built from aggregates, joins and array functions; neighbours are looked up across chunks (see
`lines.nearest`), so sessions of any length spread over tasks. A replacement is only made where it
makes the line smaller. Null types count as 'unknown'; rows without blocks give no block actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import ends_of, preview, text_of, truthy
from skein.operators.lines import CHUNK_KEY, nearest, positioned, settled
from skein.operators.model import BLOCK, list_size, with_block
from skein.session import cut

#: Name put into the markers that rewriting leaves behind.
MARKER = "skein"
KEY = ["session_id", "line_index"]

# Tool names and fields the operators look for.
HTTP_TOOLS = ["WebFetch", "WebSearch", "webfetch", "websearch"]
READ_TOOLS = ["Read", "read"]
EDIT_TOOLS = ["Edit", "edit", "Write", "write"]
POLL_TOOLS = ["TaskOutput", "taskoutput"]
COST_FIELDS = ["costUSD", "duration", "apiDuration"]
ENVELOPE_FIELDS = ["cwd", "version", "gitBranch", "slug", "userType", "isSidechain"]
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"


def _removed(lines: DataFrame, reason: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return lines.select(
        *KEY, F.lit(0).cast("long").alias("ord"), F.lit("remove").alias("action"), F.lit(reason).alias("reason"),
        F.col("byte_size").alias("original_bytes"), F.lit(0).cast("long").alias("pruned_bytes"),
        none(f"array<{BLOCK}>").alias("new_blocks"), none("map<string,string>").alias("new_envelope"), none("map<string,string>").alias("new_inner"),
    )


def _replaced(lines: DataFrame, size: Column, reason: Column, blocks: Column | None = None, envelope: Column | None = None, inner: Column | None = None, order: Column | None = None) -> DataFrame:
    out = lines.select(
        *KEY, (order if order is not None else F.lit(0)).cast("long").alias("ord"), F.lit("replace").alias("action"), reason.alias("reason"),
        F.col("byte_size").alias("original_bytes"), size.cast("long").alias("pruned_bytes"),
        (blocks if blocks is not None else F.col("blocks")).alias("new_blocks"),
        (envelope if envelope is not None else F.col("envelope")).alias("new_envelope"), (inner if inner is not None else F.col("inner")).alias("new_inner"),
    )
    return out.where(F.col("original_bytes") > F.col("pruned_bytes"))


def _resized(blocks: Column) -> Column:
    """Canonical size of a line once its content is `blocks`."""
    return F.col("canonical_size") - F.col("content_size") + list_size(blocks)


def _rows(lines: DataFrame, *columns: str | Column) -> DataFrame:
    return lines.select("session_id", "chunk", "line_index", "byte_size", *columns)


def _used(block: Column, names: list[str]) -> Column:
    return (block["type"] == "tool_use") & truthy(block["name"].isin(names))


def progress_collapse(lines: DataFrame, config: dict) -> DataFrame:
    """Of each run of progress lines only the last stays."""
    rows = nearest(_rows(lines, "type"), {"next": F.struct("type")}, ["line_index"], after=True)
    return _removed(rows.where((F.col("type") == "progress") & truthy(F.col("next.type") == "progress")), "progress-collapse")


def file_history_dedup(lines: DataFrame, config: dict) -> DataFrame:
    """Of snapshots with one message id the last stays, and of each run of snapshot updates the last."""
    snapshot = F.col("type") == "file-history-snapshot"
    rows = _rows(lines, "message_id", snapshot.alias("snap"), (snapshot & truthy(F.col("is_snapshot_update"))).alias("update"))
    named = rows.where("snap and message_id <> ''")
    newest = named.groupBy("session_id", "message_id").agg(F.max("line_index").alias("last"))
    older = named.join(newest, ["session_id", "message_id"]).where("line_index < last").select(*KEY, "byte_size")
    runs = nearest(rows, {"next": F.struct("update")}, ["line_index"], after=True).where(F.col("update") & truthy(F.col("next.update")))
    first = _removed(older, "file-history-dedup")
    return first.unionByName(_removed(runs.select(*KEY, "byte_size").join(older, KEY, "left_anti"), "file-history-update-run"))


def _dropped(fields: Column, names: list[str] | Column) -> tuple[Column, Column]:
    """(map without the fields, bytes that they take in a compact object)."""
    hit = (lambda k: k.isin(names)) if isinstance(names, list) else (lambda k: F.array_contains(names, k))
    entries = F.filter(F.map_entries(fields), lambda e: hit(e["key"]))
    saved = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + F.length(e["key"]) + F.octet_length(e["value"]) + 4)
    return F.map_filter(fields, lambda k, v: ~hit(k)), saved


def metadata_strip(lines: DataFrame, config: dict) -> DataFrame:
    """Drops token usage and stop fields of the message and cost fields of the line."""
    inner, saved = _dropped(F.col("inner"), ["usage", "stop_reason", "stop_sequence"])
    envelope, saved_root = _dropped(F.col("envelope"), COST_FIELDS)
    hit = lines.withColumn("_s", saved + saved_root).where("_s > 0")
    return _replaced(hit, F.col("canonical_size") - F.col("_s"), F.lit("metadata-strip"), envelope=envelope, inner=inner)


def thinking_blocks(lines: DataFrame, config: dict) -> DataFrame:
    """Removes, shortens or unsigns the thinking of assistant lines (config thinking_mode)."""
    mode = config.get("thinking_mode", "remove")
    null = F.lit(None).cast("string")
    rows = lines.where((F.col("type") == "assistant") & (F.size("blocks") > 0))
    thinks = lambda b: b["type"] == "thinking"
    signed = lambda b: b["signature"].isNotNull()
    unsigned = lambda b: with_block(b, signature=null)
    if mode == "truncate":
        short = lambda b: F.when(F.length(b["thinking"]) > 200, F.concat(F.substring(b["thinking"], 1, 200), F.lit("...[truncated]"))).otherwise(b["thinking"])
        new = F.transform("blocks", lambda b: F.when(thinks(b), with_block(b, signature=null, thinking=short(b))).otherwise(unsigned(b)))
        changed = F.exists("blocks", lambda b: thinks(b) | signed(b))
    elif mode == "signature-only":
        new = F.transform("blocks", unsigned)
        # each thinking block settles anew whether anything has changed so far
        changed = F.aggregate("blocks", F.lit(False), lambda seen, b: F.when(thinks(b), signed(b)).otherwise(seen | signed(b)))
    else:
        new = F.transform(F.filter("blocks", lambda b: ~thinks(b)), unsigned)
        changed = F.exists("blocks", lambda b: thinks(b) | signed(b))
    rows = settled(rows.where(changed), "_new", new)
    return _replaced(rows, _resized(F.col("_new")), F.lit(f"thinking-blocks ({mode})"), F.col("_new"))


def tool_output_trim(lines: DataFrame, config: dict) -> DataFrame:
    """Shortens tool results that have too many lines or bytes to their two ends."""
    most_bytes, most_lines = config.get("tool_output_max_bytes", 8192), config.get("tool_output_max_lines", 100)
    result = lambda b: b["type"] == "tool_result"
    # more line ends than allowed: counted without cutting the text up
    long = lambda b: result(b) & ((F.octet_length(b["content_str"]) > most_bytes) | (F.length(b["content_str"]) - F.length(F.replace(b["content_str"], F.lit("\n"), F.lit(""))) >= most_lines))
    listed = lambda b: result(b) & b["content_list"].isNotNull() & (F.octet_length(F.to_json(b["content_list"])) > most_bytes)
    rows = lines.where(F.exists("blocks", lambda b: truthy(long(b)) | truthy(listed(b))))
    rows = settled(rows, "_new", trimmed_outputs(F.col("blocks"), most_bytes, most_lines))
    return _replaced(rows, _resized(F.col("_new")), F.lit("tool-output-trim"), F.col("_new"))


def trimmed_outputs(blocks: Column, most_bytes: int, most_lines: int) -> Column:
    """Tool results within the limits; other blocks as they are.

    Each step goes through an array of its own, so that a text is cut up once and a size taken once.
    """
    keep = most_lines // 2
    cut_up = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.when(b["type"] == "tool_result", F.split(b["content_str"], "\n")).alias("parts"), F.octet_length(b["content_str"]).alias("size")))

    def ends(x: Column) -> Column:
        count, text = F.size(x["parts"]), x["b"]["content_str"]
        tail = F.slice(x["parts"], -keep, keep) if keep else x["parts"]
        gap = F.concat(F.lit("\n... ["), (count - most_lines).cast("string"), F.lit(f" lines trimmed by {MARKER}] ...\n"))
        mark = F.concat(F.lit("\n... ["), (x["size"] - most_bytes).cast("string"), F.lit(f" bytes trimmed by {MARKER}] ...\n"))
        by_lines = F.array_join(F.concat(F.slice(x["parts"], 1, keep), F.array(gap), tail), "\n")
        text = F.when(x["parts"].isNull(), F.lit(None)).when(count > most_lines, by_lines).when(x["size"] > most_bytes, ends_of(text, most_bytes // 2, mark))
        too_long = (x["b"]["type"] == "tool_result") & x["b"]["content_list"].isNotNull() & (F.octet_length(F.to_json(x["b"]["content_list"])) > most_bytes)
        return F.struct(x["b"].alias("b"), text.alias("text"), truthy(too_long).alias("nested"))

    short = lambda t: F.when(
        (t["type"] == "text") & (F.octet_length(t["text"]) > most_bytes),
        F.struct(t["type"].alias("type"), ends_of(t["text"], most_bytes // 2, F.lit(f"\n...[trimmed by {MARKER}]...\n")).alias("text")),
    ).otherwise(t)
    renew = lambda x: F.when(x["text"].isNotNull(), with_block(x["b"], content_str=x["text"])).when(x["nested"], with_block(x["b"], content_list=F.transform(x["b"]["content_list"], short))).otherwise(x["b"])
    return F.transform(F.transform(cut_up, ends), renew)


def file_events(lines: DataFrame) -> DataFrame:
    """Reads and edits of files, in order: session_id, line_index, block_no, path, edit."""
    events = lines.where(F.exists("blocks", lambda b: _used(b, READ_TOOLS + EDIT_TOOLS)))
    events = events.select(*KEY, F.posexplode("blocks").alias("block_no", "b")).where(_used(F.col("b"), READ_TOOLS + EDIT_TOOLS))
    path = F.get_json_object("b.input", "$.file_path")
    return events.select(*KEY, "block_no", path.alias("path"), F.col("b.name").isin(EDIT_TOOLS).alias("edit")).where("path <> ''")


def stale_reads_of(lines: DataFrame) -> DataFrame:
    """Lines with a read of a file that is edited later: session_id, line_index."""
    events = file_events(lines)
    at = F.struct("line_index", "block_no")
    edits = events.where("edit").groupBy("session_id", "path").agg(F.max(at).alias("last"))
    reads = events.where("not edit").select("session_id", "path", "line_index", at.alias("at"))
    return reads.join(edits, ["session_id", "path"]).where("at < last").select(*KEY).distinct()


def read_results(lines: DataFrame, ahead: int = 4) -> DataFrame:
    """Reads with their results among the next `ahead` lines: one row per read block and result."""
    rows = positioned(lines.select("session_id", "chunk", "line_index", "blocks"))
    blocks = rows.select("session_id", "line_index", "pos", F.posexplode("blocks").alias("block_no", "b"))
    reads = blocks.where(_used(F.col("b"), READ_TOOLS) & (F.col("b.id") != "")).select(
        "session_id", F.col("line_index").alias("read_line"), F.col("pos").alias("read_pos"), F.col("block_no").alias("read_block"), F.col("b.id").alias("id")
    )
    results = blocks.where((F.col("b.type") == "tool_result") & F.col("b.tool_use_id").isNotNull()).select(
        "session_id", "line_index", "pos", "block_no", F.col("b.tool_use_id").alias("id"), F.col("b.content_str").alias("content_str")
    )
    near = (F.col("pos") > F.col("read_pos")) & (F.col("pos") <= F.col("read_pos") + ahead)
    return results.join(reads, ["session_id", "id"]).where(near)


def stale_reads(lines: DataFrame, config: dict) -> DataFrame:
    """Results of reads of files that are edited later become a note.

    A line with one stale read is stale with all its reads. Several stale results in one line each
    make an action from the line as it was; the last one counts when they are applied.
    """
    stale = stale_reads_of(lines).withColumnRenamed("line_index", "read_line")
    hits = read_results(lines).where(F.length("content_str") > 500).join(stale, ["session_id", "read_line"], "left_semi")
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("read_pos", "read_block", "block_no"))  # among the few of one line
    rows = lines.join(hits.select(*KEY, "id", order.alias("_ord")), KEY)
    first = F.array_position(F.transform("blocks", lambda b: truthy((b["type"] == "tool_result") & (b["tool_use_id"] == F.col("id")))), F.lit(True)) - 1
    note = F.lit(f"[stale read - file was later edited, trimmed by {MARKER}]")
    new = F.transform("blocks", lambda b, i: F.when(i == first, with_block(b, content_str=note)).otherwise(b))
    rows = settled(rows, "_new", new)
    return _replaced(rows, _resized(F.col("_new")), F.lit("stale-read (file later edited)"), F.col("_new"), order=F.col("_ord"))


def _reminder_text(b: Column) -> Column:
    return F.when(b["type"].isin("text", "tool_result"), F.coalesce(F.nullif(b["text"], F.lit("")), b["content_str"]))


def reminder_copies(lines: DataFrame) -> DataFrame:
    """Every reminder: session_id, line_index, block_no, match_no, reminder, again (not the first of its text)."""
    blocks = lines.select(*KEY, F.posexplode("blocks").alias("block_no", "b"))
    blocks = blocks.withColumn("text", _reminder_text(F.col("b"))).where(F.contains("text", F.lit("<system-reminder>")))
    found = blocks.select(*KEY, "block_no", F.posexplode(F.regexp_extract_all("text", F.lit(REMINDER), F.lit(0))).alias("match_no", "reminder"))
    found = found.withColumn("hash", F.md5("reminder")).withColumn("at", F.struct("line_index", "block_no", "match_no"))
    first = found.groupBy("session_id", "hash").agg(F.min("at").alias("first"))
    return found.join(first, ["session_id", "hash"]).select(*KEY, "block_no", "match_no", "reminder", (F.col("at") != F.col("first")).alias("again"))


def reminder_dedup(lines: DataFrame, config: dict) -> DataFrame:
    """Takes repeated reminders out of texts and tool results.

    A block loses every copy of a reminder that it or an earlier block had before. Once a line has
    changed, its later blocks with reminders get their blank lines tidied as well.
    """
    copies = reminder_copies(lines)
    per_block = copies.groupBy(*KEY, "block_no").agg(F.collect_set(F.when(F.col("again"), F.col("reminder"))).alias("gone"))
    per_line = per_block.groupBy(*KEY).agg(F.collect_list(F.struct("block_no", "gone")).alias("hit"))
    per_line = per_line.where(F.exists("hit", lambda h: F.size(h["gone"]) > 0))
    rows = lines.join(per_line, KEY)
    since = F.array_min(F.transform(F.filter("hit", lambda h: F.size(h["gone"]) > 0), lambda h: h["block_no"]))

    def tidy(b: Column, i: Column) -> Column:
        mine = F.filter("hit", lambda h: h["block_no"] == i)
        text = F.aggregate(F.flatten(F.transform(mine, lambda h: h["gone"])), _reminder_text(b), lambda t, r: F.replace(t, r, F.lit("")))
        text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
        new = F.when(b["type"] == "text", with_block(b, text=text)).when(b["content_str"].isNotNull(), with_block(b, content_str=text)).otherwise(b)
        return F.when((F.size(mine) > 0) & (i >= since), new).otherwise(b)

    rows = settled(rows, "_new", F.transform("blocks", tidy))
    return _replaced(rows, _resized(F.col("_new")), F.lit("system-reminder-dedup"), F.col("_new"))


def _inside_runs(rows: DataFrame, least: int) -> DataFrame:
    """Rows strictly inside runs of at least `least`: a run begins at a row that `opens` and goes on while rows `belong`.

    `rows` has session_id, chunk, line_index, opens, belongs; whatever opens also belongs. A run is
    known by the last row before it that doesn't belong. Its rows are counted by chunk.
    """
    before = nearest(rows, {"gap": F.when(~F.col("belongs"), F.col("line_index"))}, ["line_index"]).where("belongs")
    before = before.withColumn("at", F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy("line_index")))
    before = cut(before.withColumn("gap", F.coalesce("gap", F.lit(-1).cast("long"))))
    parts = before.groupBy("session_id", "gap", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("opens"), F.struct("line_index", "at"))).alias("open"), F.max("line_index").alias("stop"), F.max("at").alias("last")
    )
    runs = parts.groupBy("session_id", "gap").agg(F.min_by(F.struct("chunk", "open", "last"), F.when(F.col("open").isNotNull(), F.col("chunk"))).alias("o"), F.max("stop").alias("stop"), F.collect_list(F.struct("chunk", "n")).alias("parts"))
    later = F.aggregate(F.filter("parts", lambda p: p["chunk"] > F.col("o.chunk")), F.lit(0).cast("long"), lambda n, p: n + p["n"])
    runs = runs.where(later + F.col("o.last") - F.col("o.open.at") + 1 >= least).select("session_id", "gap", F.col("o.open.line_index").alias("start"), "stop")
    return before.join(runs, ["session_id", "gap"]).where((F.col("line_index") > F.col("start")) & (F.col("line_index") < F.col("stop")))


def http_spam(lines: DataFrame, config: dict) -> DataFrame:
    """Removes progress lines inside runs of more than three web calls, their results and progress."""
    calls = F.exists("blocks", lambda b: _used(b, HTTP_TOOLS))
    tools = F.exists("blocks", lambda b: truthy(b["type"].isin("tool_use", "tool_result")))
    named = F.exists("blocks", lambda b: truthy(b["type"].isin("tool_use", "tool_result")) & truthy(b["name"].isin(HTTP_TOOLS)))
    # flags only, written once: each look at neighbours reads them twice
    rows = cut(_rows(lines, (F.col("type") == "progress").alias("progress"), calls.alias("opens"), tools.alias("tools"), named.alias("named")))
    belongs = F.col("progress") | F.col("named") | (F.col("tools") & truthy(F.col("prev.opens"))) | F.col("opens")
    rows = cut(nearest(rows, {"prev": F.struct("opens")}, ["line_index"]).select("session_id", "chunk", "line_index", "byte_size", "progress", "opens", belongs.alias("belongs")))
    return _removed(_inside_runs(rows, 4).where("progress"), "http-spam")


def sorted_json(text: Column) -> Column:
    """An input with its keys in order, to compare; what can't be parsed is compared as it stands."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text, F.lit(""))


def error_retry_collapse(lines: DataFrame, config: dict) -> DataFrame:
    """Of a call repeated after errors, keeps the first try and the last error with its retry."""
    events = lines.select("session_id", "chunk", "line_index", "byte_size", F.posexplode("blocks").alias("block_no", "b"))
    failed = truthy((F.col("b.type") == "tool_result") & F.col("b.is_error"))
    events = events.where((F.col("b.type") == "tool_use") | failed).select(
        "session_id", "chunk", "line_index", "byte_size", "block_no", failed.alias("err"),
        F.when(~failed, F.struct(F.coalesce("b.name", F.lit("")).alias("name"), F.md5(sorted_json(F.col("b.input"))).alias("hash"))).alias("call"),
    )
    order = ["line_index", "block_no"]
    me = F.struct("line_index", "byte_size", "err", "call")
    # narrow rows, written between the looks at neighbours, each of which reads them twice
    events = cut(nearest(cut(events), {"n1": me}, order, after=True))
    events = nearest(events, {"n2": F.struct("n1")}, order, after=True)
    n2 = F.col("n2.n1")
    link = truthy(~F.col("err") & F.col("n1.err") & ~n2["err"] & (n2["call"] == F.col("call")))
    events = events.select(*[c for c in events.columns if c not in ("n1", "n2")], link.alias("link"))
    # what stands between is looked up before errors are left out
    events = nearest(cut(events), {"p1": F.struct("line_index", "byte_size"), "prev_link": F.when(~F.col("err"), F.col("link"))}, order)
    middle = events.where(~F.col("err") & F.col("link") & truthy(F.col("prev_link")))
    lines_of = middle.select("session_id", "line_index", "byte_size").unionByName(middle.select("session_id", F.col("p1.line_index").alias("line_index"), F.col("p1.byte_size").alias("byte_size")))
    return _removed(lines_of, "error-retry-collapse")


def background_poll_collapse(lines: DataFrame, config: dict) -> DataFrame:
    """Of runs of queue polls the last stays; of runs of unblocked task polls the two ends."""
    poll = truthy((F.col("type") == "queue-operation") & F.col("operation").isin("check", "poll"))
    unblocked = lambda b: _used(b, POLL_TOOLS) & truthy(F.get_json_object(b["input"], "$.block") == "false") & ~truthy(b["input"].rlike(r'"block"\s*:\s*"'))
    opens = F.exists("blocks", unblocked)
    rows = cut(_rows(lines, poll.alias("poll"), opens.alias("opens"), (opens | (F.col("type") == "progress")).alias("belongs")))
    near = nearest(rows, {"next": F.struct("poll")}, ["line_index"], after=True)
    queue = _removed(near.where(F.col("poll") & truthy(F.col("next.poll"))), "queue-poll")
    inside = _inside_runs(rows.drop("poll"), 3)
    return queue.unionByName(_removed(inside, "task-poll"))


def document_copies(lines: DataFrame, least: int = 1024) -> DataFrame:
    """Large blocks with their text's hash: session_id, line_index, block_no, bytes, hash, first, again."""
    blocks = lines.where(F.col("canonical_size") >= least).select(*KEY, F.posexplode("blocks").alias("block_no", "b"))
    blocks = settled(blocks, "text", text_of(F.col("b"))).where(F.octet_length("text") >= least)
    blocks = cut(blocks.select(*KEY, "block_no", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("hash"), F.struct("line_index", "block_no").alias("at")))
    first = blocks.groupBy("session_id", "hash").agg(F.min("at").alias("first"))
    return blocks.join(first, ["session_id", "hash"]).withColumn("again", F.col("at") != F.col("first"))


def document_dedup(lines: DataFrame, config: dict) -> DataFrame:
    """Later copies of a large block become a note; one block of a line at most, the first that saves."""
    copies = document_copies(lines, config.get("document_dedup_min_bytes", 1024)).where("again")
    rows = lines.join(copies.select(*KEY, "block_no", "bytes", "hash", "first"), KEY)

    def noted(b: Column, i: Column) -> Column:
        head = preview(text_of(b))
        text = F.concat(F.lit(f"[duplicate content removed by {MARKER} - first seen earlier: "), head, F.lit("...]"))
        null = lambda name: b[name].isNull()
        plain = with_block(b, text=text, signature=F.lit(None).cast("string"))
        short = F.concat(F.lit(f"[duplicate content removed by {MARKER}: "), preview(b["content_str"]), F.lit("...]"))
        new = F.when(b["type"] == "text", plain).when((b["type"] == "tool_result") & ~null("content_str"), with_block(b, content_str=short)).otherwise(b)
        return F.when(i == F.col("block_no"), new).otherwise(b)

    reason = F.concat(F.lit("document-dedup ("), F.col("bytes").cast("string"), F.lit(" bytes, hash="), F.substring("hash", 1, 8), F.lit(")"))
    rows = settled(rows, "_new", F.transform("blocks", noted)).withColumn("_size", _resized(F.col("_new"))).where("byte_size > _size")
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct("byte_size", "envelope", "inner", "_new", "_size", reason.alias("_reason")), F.struct("first", "block_no")).alias("r")).select(*KEY, "r.*")
    return _replaced(best, F.col("_size"), F.col("_reason"), F.col("_new"))


def mega_trimmed(b: Column, most: int) -> Column:
    """A block within the limit, or as it is."""
    text = text_of(b)
    size = F.octet_length(text)
    mark = F.concat(F.lit("\n\n... ["), (size - most).cast("string"), F.lit(f" bytes trimmed by {MARKER}] ...\n\n"))
    new = ends_of(text, most // 2, mark)
    kind = F.coalesce(b["type"], F.lit("text"))
    fit = F.when(kind == "thinking", with_block(b, thinking=new)).when(kind == "text", with_block(b, text=new)).when((kind == "tool_result") & b["content_str"].isNotNull(), with_block(b, content_str=new)).otherwise(b)
    return F.when((b["size"] > most) & (size > most), fit).otherwise(b)


def mega_block_trim(lines: DataFrame, config: dict) -> DataFrame:
    """Shortens any block above the limit to its two ends."""
    most = config.get("mega_block_max_bytes", 32768)
    rows = lines.where(~F.col("type").isin("summary", "queue-operation"))
    rows = rows.where(F.exists("blocks", lambda b: (b["size"] > most) & (F.octet_length(text_of(b)) > most)))
    rows = settled(rows, "_new", F.transform("blocks", lambda b: mega_trimmed(b, most)))
    return _replaced(rows, _resized(F.col("_new")), F.lit("mega-block-trim"), F.col("_new"))


def constant_fields(lines: DataFrame) -> DataFrame:
    """Envelope fields with one value in all lines that have them: session_id, fields (names)."""
    cells = lines.select("session_id", F.explode("envelope").alias("k", "v")).where(F.col("k").isin(ENVELOPE_FIELDS))
    one = cells.groupBy("session_id", "k").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a = z")
    return one.groupBy("session_id").agg(F.sort_array(F.collect_list("k")).alias("fields"))


def envelope_strip(lines: DataFrame, config: dict) -> DataFrame:
    """Drops constant envelope fields from all lines but a session's first."""
    first = lines.groupBy("session_id").agg(F.min("line_index").alias("first"))
    rows = lines.join(constant_fields(lines).join(first, "session_id"), "session_id").where("line_index > first")
    envelope, saved = _dropped(F.col("envelope"), F.col("fields"))
    rows = rows.withColumn("_s", saved).where("_s > 0")
    return _replaced(rows, F.col("canonical_size") - F.col("_s"), F.lit("envelope-strip"), envelope=envelope)
