"""Agent-team state out of session lines: teammates, subagents, tasks, and their merge with configuration.

Everything is grouped by the thing it describes, not folded line by line: the last event of a key is
an aggregate (max_by over the order of events), so a session of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import truthy
from skein.operators.lines import CHUNK_KEY, chunk_of, numbered
from skein.session import cut

# Tools, words and forms that mark team lines.
TEAM_TOOLS = [
    "TeamCreate", "TeamDelete", "TeamMessage", "SendMessage", "SpawnTeammate", "TeamStatus", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "Task", "TaskOutput", "TaskStop",
]
TEAM_WORDS = (
    r"(?id)team.?name|agent.?id|teammate|team.?lead|SendMessage|TeamCreate|TaskCreate|TaskUpdate|"
    r"agent.?team|spawn.+teammate|team.+config|subagent_type|run_in_background|resume.*agent"
)
NOTE = r"(?s)<task-notification>\s*<task-id>([^<]+)</task-id>\s*<status>([^<]+)</status>\s*<summary>([^<]*)</summary>\s*<result>(.*?)</result>"
AGENT_ID = r"(?i)agent[_-]?id[:\s]+([a-f0-9-]+)"


def is_team_line(types: Column, root_content: Column, content_kind: Column, blocks: Column) -> Column:
    """Whether a line belongs to the coordination of a team."""
    notes = lambda text: truthy(F.contains(text, F.lit("<task-notification>")))
    words = lambda text: truthy(text.rlike(TEAM_WORDS))
    whole = F.get(blocks, F.lit(0))["text"]
    result = lambda b: words(b["content_str"]) | truthy(F.exists(b["content_list"], lambda x: words(x["text"])))
    listed = F.exists(
        blocks,
        lambda b: (truthy(b["type"] == "tool_use") & truthy(b["name"].isin(TEAM_TOOLS)))
        | (truthy(b["type"] == "tool_result") & result(b)) | (truthy(b["type"] == "text") & words(b["text"])),
    )
    spoken = F.when(content_kind == "string", notes(whole) | words(whole)).otherwise(listed)
    return F.when(types == "queue-operation", notes(root_content)).otherwise(truthy(spoken))


def team_lines(lines: DataFrame) -> DataFrame:
    """The lines of team coordination."""
    return lines.where(is_team_line(F.col("type"), F.col("root_content"), F.col("content_kind"), F.col("blocks")))


def _calls(lines: DataFrame) -> DataFrame:
    """Team tool calls: session_id, at (order), name, id, input."""
    rows = team_lines(lines).where(F.col("type") != "queue-operation")
    rows = rows.select("session_id", "line_index", F.posexplode("blocks").alias("block_no", "b")).where((F.col("b.type") == "tool_use") & F.col("b.name").isin(TEAM_TOOLS))
    return rows.select("session_id", F.struct("line_index", "block_no").alias("at"), F.col("b.name").alias("name"), F.nullif(F.col("b.id"), F.lit("")).alias("id"), F.col("b.input").alias("input"))


def _field(*names: str, of: str = "input") -> Column:
    """The first of the named fields that is present."""
    return F.coalesce(*[F.get_json_object(of, f"$.{n}") for n in names])


def merge_tasks(events: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks from create and update events in order: keys, subject, status, owner, description.

    `events` has the keys (a task's identity), at, created (boolean), subject, status, owner,
    description. A create starts the task anew with status pending; what updates after it fill in
    overwrites, blanks don't. A task that is only updated has the status unknown until one is given.
    """
    start = events.groupBy(*keys).agg(F.max(F.when(F.col("created"), F.col("at"))).alias("start"))
    rows = events.join(start, keys).where(F.col("start").isNull() | (F.col("at") >= F.col("start")))
    filled = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at"))).alias(c)
    out = rows.groupBy(*keys).agg(
        filled("subject"), F.max_by("status", F.when(~F.col("created") & (F.coalesce("status", F.lit("")) != ""), F.col("at"))).alias("status"),
        filled("owner"), F.max_by("description", F.when(F.col("created"), F.col("at"))).alias("description"), F.max("created").alias("_c"),
    )
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    status = F.coalesce(F.col("status"), F.when(F.col("_c"), "pending").otherwise("unknown")).alias("status")
    return out.select(*keys, blank("subject"), status, blank("owner"), blank("description"))


def tasks(lines: DataFrame) -> DataFrame:
    """The shared tasks of each session: session_id, task_id, subject, status, owner, description.

    A task that is created without an id is a task of its own, named after the call; updates without
    an id share the task with the empty one.
    """
    calls = _calls(lines).where(F.col("name").isin("TaskCreate", "TaskUpdate"))
    events = calls.select(
        "session_id", F.coalesce(_field("taskId", "id"), F.when(F.col("name") == "TaskCreate", F.col("id")), F.lit("")).alias("task_id"), "at", (F.col("name") == "TaskCreate").alias("created"),
        F.when(F.col("name") == "TaskCreate", _field("subject", "title")).otherwise(_field("subject")).alias("subject"),
        _field("status").alias("status"), _field("owner").alias("owner"), _field("description").alias("description"),
    )
    return merge_tasks(events, ["session_id", "task_id"])


def teammates(lines: DataFrame) -> DataFrame:
    """The members that teams were created with: session_id, agent_id, name, role, status; the last mention counts."""
    calls = _calls(lines).where(F.col("name") == "TeamCreate")
    listed = F.from_json(F.get_json_object("input", "$.teammates"), "array<struct<agentId:string,agent_id:string,name:string,role:string,description:string>>")
    rows = calls.select("session_id", "at", F.posexplode(listed).alias("no", "t"))
    agent = F.coalesce("t.agentId", "t.agent_id")
    rows = rows.select("session_id", F.struct("at", "no").alias("at"), agent.alias("agent_id"), F.coalesce("t.name", agent).alias("name"), F.coalesce("t.role", "t.description", F.lit("")).alias("role"))
    last = rows.where("agent_id <> ''").groupBy("session_id", "agent_id").agg(F.max_by(F.struct("name", "role"), "at").alias("r"))
    return last.select("session_id", "agent_id", "r.name", "r.role", F.lit("running").alias("status"))


def notifications(lines: DataFrame) -> DataFrame:
    """Task notifications in string content, of all lines: session_id, agent_id, at, status, summary, result."""
    text = F.when(F.col("type") == "queue-operation", F.col("root_content")).when(F.col("content_kind") == "string", F.get("blocks", F.lit(0))["text"])
    rows = lines.select("session_id", "line_index", text.alias("text")).where(F.contains("text", F.lit("<task-notification>")))
    group = lambda g: F.regexp_extract_all("text", F.lit(NOTE), F.lit(g))
    rows = rows.select("session_id", "line_index", F.posexplode(F.arrays_zip(*[group(g).alias(n) for g, n in enumerate(("i", "s", "m", "r"), 1)])).alias("no", "n"))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return rows.select(
        "session_id", trim("n.i").alias("agent_id"), F.struct("line_index", "no").alias("at"), trim("n.s").alias("status"), trim("n.m").alias("summary"), F.substring(trim("n.r"), 1, 300).alias("result")
    )


def _numbered_agents(task: DataFrame) -> DataFrame:
    """Calls that name no agent and have no id get the key task-N, N being how many agents the session knows before them."""
    firsts = task.where("key is not null").groupBy("session_id", "key").agg(F.min("at").alias("at"))
    known = firsts.unionByName(task.where("key is null").select("session_id", "key", "at"))
    known = numbered(known, ["session_id"], chunk_of(F.col("at.line_index")), ["at"]).where("key is null").select("session_id", "at", F.concat(F.lit("task-"), "no").alias("given"))
    return task.join(known, ["session_id", "at"], "left").withColumn("key", F.coalesce("key", "given")).drop("given")


def subagents(lines: DataFrame) -> DataFrame:
    """Spawned agents: session_id, agent_id, subagent_type, description, status, result.

    An agent is known by what it resumes or by its call; a result in a team line completes it, and
    an agent id in the result's text becomes its id. A stop after the call stops it unless a later
    result completes it. Notifications have the last word on status and result, and add agents
    nothing else mentions.
    """
    calls = _calls(lines)
    task = calls.where(F.col("name") == "Task").select(
        "session_id", "at", "id", F.coalesce(F.nullif(_field("resume"), F.lit("")), "id").alias("key"), F.coalesce(_field("subagent_type"), F.lit("")).alias("subagent_type"),
        F.coalesce(F.nullif(_field("description"), F.lit("")), F.substring(_field("prompt"), 1, 80), F.lit("")).alias("description"),
    )
    task = _numbered_agents(task)
    last = task.groupBy("session_id", "key").agg(F.max_by(F.struct("at", "subagent_type", "description"), "at").alias("t"))
    last = last.select("session_id", "key", F.col("t.at").alias("called"), "t.subagent_type", "t.description")
    nested = F.array_join(F.transform(F.filter("b.content_list", lambda x: x["type"] == "text"), lambda x: x["text"]), "")
    results = team_lines(lines).where(F.col("type") != "queue-operation").select("session_id", "line_index", F.posexplode("blocks").alias("block_no", "b")).where(F.col("b.type") == "tool_result")
    results = results.select("session_id", F.struct("line_index", "block_no").alias("at"), F.col("b.tool_use_id").alias("id"), F.coalesce("b.content_str", nested, F.lit("")).alias("text"))
    met = results.join(task.select("session_id", "id", "key", F.col("at").alias("from_call")), ["session_id", "id"]).where("at > from_call")
    met = met.groupBy("session_id", "key").agg(F.max("at").alias("done"), F.max_by("text", "at").alias("text"))
    stops = calls.where(F.col("name") == "TaskStop").select("session_id", _field("task_id").alias("key"), "at").groupBy("session_id", "key").agg(F.max("at").alias("stopped"))
    state = last.join(met, ["session_id", "key"], "left").join(stops, ["session_id", "key"], "left")
    found = F.nullif(F.regexp_extract("text", AGENT_ID, 1), F.lit(""))
    finished = F.col("done").isNotNull() & (F.col("done") > F.col("called"))
    halted = F.col("stopped").isNotNull() & (F.col("stopped") > F.col("called"))
    status = F.when(halted & (~finished | (F.col("stopped") > F.col("done"))), "stopped").when(finished, "completed").otherwise("running")
    state = state.select(
        "session_id", F.coalesce(found, "key").alias("agent_id"), "called", "subagent_type", "description", status.alias("status"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("result")
    )
    state = state.groupBy("session_id", "agent_id").agg(F.max_by(F.struct("subagent_type", "description", "status", "result"), "called").alias("s"))
    noted = notifications(lines).groupBy("session_id", "agent_id").agg(
        F.max_by(F.struct("status", "result"), "at").alias("n"), F.min_by("summary", F.when(F.col("summary") != "", F.col("at"))).alias("summary")
    )
    out = state.join(noted, ["session_id", "agent_id"], "full_outer")
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    return out.select(
        "session_id", "agent_id", blank("s.subagent_type").alias("subagent_type"), blank(F.nullif("s.description", F.lit("")), "summary").alias("description"),
        blank("n.status", "s.status").alias("status"), blank("n.result", "s.result").alias("result"),
    )


def lead_summary(lines: DataFrame, keep: int = 3, chars: int = 300) -> DataFrame:
    """The last texts of assistant team lines, joined: session_id, lead_summary."""
    rows = team_lines(lines).where(F.col("type") == "assistant").select("session_id", "chunk", "line_index", F.posexplode("blocks").alias("block_no", "b")).where(F.col("b.type") == "text")
    back = [F.col("line_index").desc(), F.col("block_no").desc()]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(*back))).where(F.col("r") <= keep)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(*back))).where(F.col("r") <= keep)
    texts = F.sort_array(F.collect_list(F.struct("line_index", "block_no", F.substring(F.coalesce("b.text", F.lit("")), 1, chars).alias("t"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(texts, lambda x: x["t"]), " [...] ").alias("lead_summary"))


def team_state(lines: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """One row a session with any team line: name, members, agents, tasks, message count, summary.

    `configs` (name, leadAgentId, leadSessionId, createdAt, members array of agentId, name,
    agentType, model, cwd) has the last word: the configuration of the same name, else the newest.
    Its members fill in known ones and add the others with status config.
    """
    marked = team_lines(lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("line_index").alias("last_line"))
    notes = notifications(lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("notes"))
    calls = _calls(lines)
    created = F.when(F.col("name") == "TeamCreate", _field("name"))
    typed = (F.col("name") == "Task") & (F.coalesce(_field("subagent_type"), F.lit("")) != "")
    names = calls.groupBy("session_id").agg(F.coalesce(F.max_by(created, F.when(created.isNotNull(), F.col("at"))), F.when(F.max(typed), "agents"), F.lit("")).alias("team_name"))
    group = lambda df, key, name, cols: df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = marked.join(notes, "session_id", "full_outer").join(names, "session_id", "left")
    mates = teammates(lines).select("*", F.lit("").alias("model"), F.lit("").alias("cwd"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = out.withColumn("team_name", blank("team_name")).withColumn("config_source", F.lit("jsonl"))
    out = out.withColumn("lead_agent_id", F.lit("")).withColumn("lead_session_id", F.lit(""))
    if configs is not None:
        fit = match_config(out.select("session_id", "team_name"), configs)
        mates = merge_members(mates, fit.select("session_id", F.explode_outer("config.members").alias("m")).where("m.agentId <> ''").select("session_id", "m.*"))
        out = out.drop("lead_agent_id", "lead_session_id").join(fit.select("session_id", F.struct("config.name", "config.leadAgentId", "config.leadSessionId").alias("c")), "session_id", "left")
        out = out.withColumn("config_source", F.when(F.col("c").isNotNull(), "both").otherwise("jsonl")).withColumn("team_name", F.coalesce("c.name", "team_name"))
        out = out.withColumn("lead_agent_id", blank("c.leadAgentId")).withColumn("lead_session_id", blank("c.leadSessionId")).drop("c")
    out = out.join(group(mates, "agent_id", "teammates", ["agent_id", "name", "role", "model", "cwd", "status"]), "session_id", "left")
    out = out.join(group(subagents(lines), "agent_id", "subagents", ["agent_id", "subagent_type", "description", "status", "result"]), "session_id", "left")
    out = out.join(group(tasks(lines), "task_id", "tasks", ["task_id", "subject", "status", "owner", "description"]), "session_id", "left")
    out = out.join(lead_summary(lines), "session_id", "left")
    total = (F.coalesce("n", F.lit(0)) + F.coalesce("notes", F.lit(0))).cast("long")
    return out.select("session_id", "team_name", "lead_agent_id", "lead_session_id", "config_source", "teammates", "subagents", "tasks", total.alias("messages"), "last_line", blank("lead_summary").alias("lead_summary"))


def match_config(sessions: DataFrame, configs: DataFrame) -> DataFrame:
    """Each session's configuration: that of its team's name, else the newest one: session_id, config."""
    every = F.struct(*[F.col(c) for c in configs.columns])
    newest = configs.groupBy(F.lit(1).alias("_one")).agg(F.max_by(every, F.struct(F.coalesce("createdAt", F.lit(0)), "name")).alias("newest"))
    named = configs.groupBy(F.col("name").alias("team_name")).agg(F.max_by(every, F.struct("createdAt", "leadAgentId")).alias("named"))
    out = sessions.join(named, "team_name", "left").withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one", "left")  # one row
    return out.select("session_id", F.coalesce("named", "newest").alias("config"))


def merge_members(mates: DataFrame, members: DataFrame) -> DataFrame:
    """Teammates with what configuration says of them; it adds members that no line mentions."""
    members = members.select("session_id", F.col("agentId").alias("agent_id"), F.struct("name", "agentType", "model", "cwd").alias("c")).dropDuplicates(["session_id", "agent_id"])
    out = mates.join(members, ["session_id", "agent_id"], "full_outer")
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    known = F.col("status").isNotNull()
    return out.select(
        "session_id", "agent_id", F.when(known, F.col("name")).otherwise(F.coalesce("c.name", "agent_id")).alias("name"), blank(F.nullif("role", F.lit("")), "c.agentType").alias("role"),
        blank("c.model", "model").alias("model"), blank("c.cwd", "cwd").alias("cwd"), F.coalesce("status", F.lit("config")).alias("status"),
    )


def recovery_lines(lines: DataFrame, states: DataFrame, stamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two lines to append to each session with a team, chained to its last uuid.

    Output: session_id, line_index, type, uuid, parent_uuid, ts_text, text. Ids come from the session
    and the clock is passed in, so a repeated run gives the same lines. Sessions without uuid or
    with an empty state get none.
    """
    last = lines.groupBy("session_id").agg(F.max("line_index").alias("end"), F.max_by("uuid", F.when(F.col("uuid") != "", F.col("line_index"))).alias("tip")).where("tip is not null")
    rows = states.where(~is_empty()).join(last, "session_id")
    uid = lambda n: F.md5(F.concat_ws(":", "session_id", "tip", F.lit(n)))
    first = F.struct((F.col("end") + 1).alias("line_index"), F.lit("user").alias("type"), uid("1").alias("uuid"), F.col("tip").alias("parent_uuid"), F.concat(F.lit("Team state to go on with:\n"), recovery_text()).alias("text"))
    second = F.struct((F.col("end") + 2).alias("line_index"), F.lit("assistant").alias("type"), uid("2").alias("uuid"), uid("1").alias("parent_uuid"), F.lit("The team state above is taken over.").alias("text"))
    rows = rows.select("session_id", F.explode(F.array(first, second)).alias("r"))
    return rows.select("session_id", "r.line_index", "r.type", "r.uuid", "r.parent_uuid", F.lit(stamp).alias("ts_text"), "r.text")


def _listing(title: str, items: str, line) -> Column:
    body = F.array_join(F.transform(items, line), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}\n"), body)).otherwise("")


def recovery_text() -> Column:
    """A team state as text to put into a conversation."""
    or_ = lambda c, before: F.when(c != "", F.concat(F.lit(before), c)).otherwise("")
    return F.concat(
        F.lit("Active agent team: "), F.when(F.col("team_name") != "", F.col("team_name")).otherwise("unnamed"),
        _listing("Teammates:", "teammates", lambda t: F.concat(F.lit("  - "), t["name"], F.lit(" (agent_id: "), t["agent_id"], F.lit(")"), or_(t["role"], " — "), F.lit(" ["), t["status"], F.lit("]"))),
        _listing("Subagents:", "subagents", lambda s: F.concat(F.lit("  - "), s["agent_id"], or_(s["description"], " — "), F.lit(" ["), s["status"], F.lit("]"), or_(F.substring(s["result"], 1, 150), "\n    Result: "))),
        _listing("Shared task list:", "tasks", lambda t: F.concat(F.lit("  - ["), F.upper(t["status"]), F.lit("] "), t["subject"], F.when(t["owner"] != "", F.concat(F.lit(" (owner: "), t["owner"], F.lit(")"))).otherwise(""))),
        or_(F.col("lead_summary"), "\nCoordination context: "),
    )


def checkpoint_text() -> Column:
    """A team state as a markdown report."""
    mark = lambda s: F.when(s == "completed", "x").when(s == "in_progress", "/").otherwise(" ")
    return F.concat(
        F.lit("# Agent Team Checkpoint: "), F.when(F.col("team_name") != "", F.col("team_name")).otherwise("unnamed"), F.lit("\n"),
        _listing("## Teammates", "teammates", lambda t: F.concat(F.lit("- **"), t["name"], F.lit("** (`"), t["agent_id"], F.lit("`)"))),
        _listing("## Subagents", "subagents", lambda s: F.concat(F.lit("- `"), s["agent_id"], F.lit("` "), s["description"], F.lit(" ("), s["status"], F.lit(")"))),
        _listing("## Task List", "tasks", lambda t: F.concat(F.lit("- ["), mark(t["status"]), F.lit("] "), t["subject"])),
        F.when(F.col("lead_summary") != "", F.concat(F.lit("\n## Lead Context\n"), F.col("lead_summary"))).otherwise(""),
        F.format_string("\n_Extracted from %d team-related messages_", F.col("messages")),
    )


def is_empty() -> Column:
    """Whether a team state has nothing in it."""
    return (F.col("team_name") == "") & F.col("teammates").isNull() & F.col("subagents").isNull() & F.col("tasks").isNull()


def change_hash() -> Column:
    """Of a team state, what a new checkpoint is worth writing for: agents, tasks and messages in number."""
    return F.concat_ws(":", F.greatest(F.size("subagents"), F.lit(0)), F.greatest(F.size("tasks"), F.lit(0)), "messages")


def recovery_raw(lines: DataFrame, states: DataFrame, stamp: str) -> DataFrame:
    """The recovery lines as JSON text: session_id, line_index, raw."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    whole = F.struct(
        F.col("type"), "uuid", F.col("parent_uuid").alias("parentUuid"), F.col("session_id").alias("sessionId"), F.lit(False).alias("isSidechain"), F.col("ts_text").alias("timestamp"),
        F.struct(F.col("type").alias("role"), F.array(part).alias("content")).alias("message"),
    )
    return recovery_lines(lines, states, stamp).select("session_id", "line_index", F.to_json(whole).alias("raw"))


def team_protected(lines: DataFrame, run, stamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Applies `run` (lines -> lines) to everything but the team's lines, as if they weren't there.

    In sessions with an empty team state nothing is spared. The others get two lines at their end
    that tell the team's state (see recovery_lines; clock `stamp`). Lines come in order within their
    chunks, each session's by line_index.
    """
    from skein.sources.jsonl import from_raw

    lines = cut(lines)
    states = cut(team_state(lines))
    teams = states.where(~is_empty()).select("session_id", F.lit(True).alias("_team"))
    marked = lines.join(teams, "session_id", "left").withColumn("_team", F.coalesce("_team", F.lit(False)) & is_team_line(F.col("type"), F.col("root_content"), F.col("content_kind"), F.col("blocks")))
    marked = marked.select(*lines.columns, "_team")
    added = from_raw(recovery_raw(lines, states, stamp)).select(*lines.columns)
    out = run(marked.where(~F.col("_team")).drop("_team")).unionByName(marked.where("_team").drop("_team")).unionByName(added)
    return out.repartition(*CHUNK_KEY).sortWithinPartitions("session_id", "line_index")
