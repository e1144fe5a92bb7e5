"""What a user calls: sessions listed, diagnosed, treated, recapped, checkpointed, checked, guarded.

Every function takes a session and the folder of transcript files, works on all sessions in it at
once (or on one, by the beginning of its id), and gives DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalar import prune_text
from skein.operators import diagnosis, executor, recap, team, tokens
from skein.plans.prescriptions import PRESCRIPTIONS, STRATEGIES, recommend
from skein.session import cut
from skein.sources import catalog, documents, jsonl
from skein.sources.transcripts import listed, opened
from skein.streaming import guard as streaming


def _lines(spark: SparkSession, folder: str, session: str | None) -> DataFrame:
    lines = jsonl.read_sessions(spark, folder)
    return lines if session is None else lines.where(F.col("session_id").startswith(session))


def list_sessions(spark: SparkSession, folder: str, project: str | None = None) -> DataFrame:
    """The sessions, largest first, with the prescription that their size suggests."""
    files = catalog.from_files(spark, folder, project)
    return files.withColumn("prescription", recommend(F.col("size"))).orderBy(F.desc("size"), "path")


def current_session(spark: SparkSession, folder: str, project: str | None = None, text: str | None = None) -> DataFrame:
    """The session most likely in use: the newest whose last lines hold the text, else the newest of the project."""
    files = catalog.from_files(spark, folder)
    if text is not None:
        found = catalog.match_by_text(files, jsonl.read_sessions(spark, folder), text)
        if not found.isEmpty():
            return found
    of_project = catalog.newest(files, project)
    return of_project if not of_project.isEmpty() else catalog.newest(files)


def resolve(spark: SparkSession, folder: str, wanted: str, cwd: str | None = None) -> DataFrame:
    """The session meant by a .jsonl path, an id, the beginning of one, or `current`: at most one row of the catalogue."""
    return catalog.find(catalog.from_files(spark, folder), wanted, cwd)


def diagnose(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """Diagnostics of the sessions, one row each."""
    return diagnosis.diagnose(_lines(spark, folder, session))


def estimate_tokens(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """Token estimates of the sessions."""
    return tokens.estimate(_lines(spark, folder, session))


def treat(
    spark: SparkSession, folder: str, prescription: str = "standard", session: str | None = None, config: dict | None = None, protect_team: bool = False, write_to: str | None = None, version: str = "1"
) -> DataFrame:
    """Runs a prescription; before and after by session. With `write_to`, a new version is written there.

    With `protect_team`, lines of team coordination stay as they are.
    """
    lines = cut(_lines(spark, folder, session))
    run = lambda some: executor.run_prescription(some, prescription, config)[0]
    out = cut(team.team_protected(lines, run) if protect_team else run(lines))
    if write_to is not None:
        jsonl.write_version(out, write_to, version)
    named = lambda df, end: diagnosis.totals(df).join(tokens.estimate(df).select("session_id", "total"), "session_id").toDF("session_id", f"messages_{end}", f"bytes_{end}", f"tokens_{end}")
    both = named(lines, "before").join(named(out, "after"), "session_id", "left").fillna(0)
    both = both.withColumn("saved_bytes", F.col("bytes_before") - F.col("bytes_after"))
    return both.withColumn("result", prune_text(F.col("tokens_before"), F.col("tokens_after"), F.col("saved_bytes")))


def reload(spark: SparkSession, folder: str, session: str, target: str, prescription: str = "standard", version: str = "1") -> DataFrame:
    """Prunes one session with its team spared, as a new version, and writes its team report beside it: what a resume goes on with."""
    out = treat(spark, folder, prescription, session, protect_team=True, write_to=f"{target}/sessions", version=version)
    reports = checkpoints(spark, folder, session)
    write_texts(reports, "report", f"{target}/reports/version={version}")
    return out


def what_if(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """What every prescription would save: prescription, session_id, strategy and its savings.

    Each prescription begins with all of the one before, so the longest is run once for all.
    """
    _, reports = executor.run_prescription(_lines(spark, folder, session), "aggressive")
    out = None
    for name, members in PRESCRIPTIONS.items():
        for report in reports[: len(members)]:
            part = report.select(F.lit(name).alias("prescription"), *report.columns)
            out = part if out is None else out.unionByName(part)
    return out


def run_strategy(spark: SparkSession, folder: str, name: str, session: str | None = None, config: dict | None = None, top: int = 20) -> DataFrame:
    """The first actions that one operator would take."""
    actions = STRATEGIES[name].function(_lines(spark, folder, session), config or {})
    return actions.orderBy("session_id", "line_index", "ord").limit(top).select("session_id", "line_index", "action", "reason", "original_bytes", "pruned_bytes")


def recaps(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """A recap of each session."""
    return recap.recap(_lines(spark, folder, session))


def checkpoints(spark: SparkSession, folder: str, session: str | None = None, configs: str | None = None) -> DataFrame:
    """The team report of each session with a team; configurations are read from a folder if given."""
    known = jsonl.read_configs(spark, configs).drop("path") if configs else None
    return team.team_state(_lines(spark, folder, session), known).select("session_id", team.checkpoint_text().alias("report"))


def write_texts(texts: DataFrame, column: str, target: str) -> None:
    """Writes one text a session (recaps, reports) below a folder that doesn't exist yet."""
    texts.select("session_id", F.col(column).alias("value")).write.mode("errorifexists").partitionBy("session_id").text(target)


def doctor(spark: SparkSession, folder: str, settings: str | None = None, windows: bool = False, fix: bool = False) -> DataFrame:
    """Checks of the session store and of a settings file: name, status, bytes, sessions, message.

    With `fix`, the trust flag is reset (the file before is kept as .bak) and backups above their
    limit are deleted; these checks then have the status `fixed`.
    """
    files = catalog.from_files(spark, folder)
    checks = diagnosis.health(files.unionByName(catalog.backups(spark, folder)) if listed(folder, ".bak") else files).withColumn("message", F.lit(""))
    trust = _trust(settings, windows, fix)
    out = spark.createDataFrame([trust], checks.schema).unionByName(checks)
    if fix and not checks.where("name = 'backups' and status <> 'ok'").isEmpty():
        checked = out.collect()  # four rows, before what they tell of is deleted
        system, _ = opened(folder)
        gone = listed(folder, ".bak")
        for file in gone:
            system.delete_file(file.path)
        note = f"deleted {len(gone)} backups, {sum(f.size for f in gone) / 1048576:.1f}MB"
        out = spark.createDataFrame([r if r.name != "backups" else (r.name, "fixed", r.bytes, r.sessions, note) for r in checked], checks.schema)
    return out


def _trust(settings: str | None, windows: bool, fix: bool) -> tuple:
    value = documents.read(settings) if settings else {}
    if value is None:
        return ("trust-dialog", "warning", 0, 0, f"{settings} can't be read")
    places = documents.flagged(value)
    if places and fix:
        backup = documents.write(settings, documents.unflagged(value))
        return ("trust-dialog", "fixed", 0, len(places), f"reset; before: {backup}")
    return ("trust-dialog", "ok" if not places else "issue" if windows else "warning", 0, len(places), ", ".join(places))


# The events of a session at which the guard starts and teams are checkpointed.
HOOKS = {
    event: [{"matcher": matcher, "hooks": [{"type": "command", "command": f"skein {what}"}]} for matcher in matchers]
    for event, matchers, what in (
        ("SessionStart", [""], "guard"), ("PostToolUse", ["Task", "TaskCreate|TaskUpdate"], "checkpoint"), ("PreCompact", [""], "checkpoint"), ("Stop", [""], "checkpoint"),
    )
}


def init(settings: str) -> list[str]:
    """Adds the hooks that a settings file lacks, the file before kept as .bak; gives what was added."""
    value = documents.read(settings)
    if value is None:
        raise ValueError(f"{settings} can't be read")
    changed, added = documents.with_hooks(value, HOOKS)
    if added:
        documents.write(settings, changed)
    return added


def formulary(spark: SparkSession) -> DataFrame:
    """The operators with their tiers: name, description, tier, prescriptions."""
    rows = [(s.name, s.description, s.tier, [p for p, members in PRESCRIPTIONS.items() if s.name in members]) for s in STRATEGIES.values()]
    return spark.createDataFrame(rows, "name string, description string, tier string, prescriptions array<string>")


def guard(spark: SparkSession, folder: str, state: str, checkpoint: str, hard_mb: float = 50, soft_mb: float | None = None, danger_mb: float = 90, prescription: str = "standard", **more):
    """Starts the guard on a folder of transcripts (see streaming.guard.watch); gives the running query."""
    mb = 1024 * 1024
    return streaming.watch(spark, folder, state, checkpoint, hard_mb * mb, None if soft_mb is None else soft_mb * mb, danger_mb * mb, prescription, **more)
