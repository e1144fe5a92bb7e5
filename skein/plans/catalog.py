"""The core's registered queries, each over its whole tables, with the SQL it is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.operators import diagnosis, drift, executor, flatten, model, recap, strategies, team, tokens
from skein.plans.prescriptions import STRATEGIES
from skein.plans.sql import SQL
from skein.session import cut, shared_folder, table, tune
from skein.sources import adapters
from skein.sources import catalog as sessions
from skein.streaming import guard

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["session_id", "line_index"]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return model.from_table(table(spark, folder, "messages"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.from_table(table(spark, folder, "session_files"))


def _on_lines(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: function(_lines(spark, folder))


def _acted(name: str, *more: str, source: Callable[[SparkSession, str], DataFrame] = _lines, config: dict | None = None) -> Query:
    """The lines that an operator acts on, and further columns of its actions, as SQL: queries are named before a session is there."""
    return lambda spark, folder: STRATEGIES[name].function(source(spark, folder), config or {}).selectExpr(*KEY, *more).distinct()


def _documents(kind: str, text: Callable | None = None) -> Query:
    return lambda spark, folder: adapters.documents_as(table(spark, folder, "documents"), kind, text() if text else None)


def _new_text(name: str, kind: str, config: dict | None = None) -> Query:
    field = {"thinking": "thinking", "tool_result": "content_str"}.get(kind, "text")
    return _acted(name, f"get(new_blocks, 0).{field} as text", "pruned_bytes", source=_documents(kind), config=config)


def _tagged():
    return F.regexp_replace("text", r"(\([^()]*\))", "<system-reminder>$1</system-reminder>")


def _signed(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.documents_as(table(spark, folder, "documents"), "thinking", signed=40)


def _file_events(spark: SparkSession, folder: str) -> DataFrame:
    return cut(adapters.events_as_files(table(spark, folder, "events")))  # read several times


def _call_lines(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.calls_as_lines(table(spark, folder, "team_calls"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    values = drift.field_values(table(spark, folder, "team_calls"))
    changes = drift.schema_changes(values, table(spark, folder, "session_files"))
    return changes.select("path", "name", "change", "old_field", "new_field")


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return drift.unified_calls(table(spark, folder, "team_calls"), table(spark, folder, "session_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return flatten.element_paths(table(spark, folder, "transcript_lines"))


def p6_nodes(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return flatten.flat_rows(table(spark, folder, "transcript_lines")).withColumn("fields", F.to_json("fields"))


def p6_schema(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return flatten.merged_schema(table(spark, folder, "transcript_lines"))


def p6_tables(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    tables = flatten.child_tables(table(spark, folder, "transcript_lines"))
    return tables.withColumn("columns", F.to_json("columns", {"ignoreNullFields": "false"}))


def catalog_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("size").cast("long").alias("bytes"))


def newest_session(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.newest(_files(spark, folder)).select("path", "mtime")


def resolve_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.resolve(_files(spark, folder), "a").select("session_id", "path")


def tail_match(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.tail_contains(_document_lines(spark, folder), "crowns", 2, "t")


def tail_match_50(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.tail_contains(_document_lines(spark, folder), "crowns", column="t")


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = adapters.documents_as(table(spark, folder, "documents"), "text")
    return lines.withColumn("t", F.get("blocks", F.lit(0))["text"])


def collapse_savings(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return executor.savings("progress-collapse", lines, strategies.progress_collapse(lines, {}))


def apply_removals(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    done = executor.apply_actions(lines, strategies.progress_collapse(lines, {}).unionByName(strategies.metadata_strip(lines, {})))
    return done.select(*KEY, "byte_size")


def prescription_gentle(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = executor.run_prescription(_lines(spark, folder), "gentle")
    return diagnosis.totals(out)


def prescription_report(spark: SparkSession, folder: str) -> DataFrame:
    _, reports = executor.run_prescription(_lines(spark, folder), "aggressive")
    whole = reports[0]
    for report in reports[1:]:
        whole = whole.unionByName(report)
    return whole


def team_protected_gentle(spark: SparkSession, folder: str) -> DataFrame:
    out = team.team_protected(_lines(spark, folder), lambda lines: executor.run_prescription(lines, "gentle")[0])
    return diagnosis.totals(out)


def task_upsert(spark: SparkSession, folder: str) -> DataFrame:
    events = adapters.tasks_from_calls(table(spark, folder, "team_calls"))
    return team.merge_tasks(events, ["path", "task_id"])


def config_merge(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.lit("s").alias("session_id"), F.col("c_custkey").cast("string").alias("agent_id"), F.col("c_name").alias("name"), F.lit("").alias("role"), F.lit("").alias("model"), F.lit("").alias("cwd"), F.lit("running").alias("status")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("s").alias("session_id"), F.col("s_suppkey").cast("string").alias("agentId"), F.col("s_name").alias("name"), F.lit("supplier").alias("agentType"), F.lit("m").alias("model"), F.lit("/s").alias("cwd")
    )
    return team.merge_members(customers, suppliers).drop("session_id")


def model_window_lookup(spark: SparkSession, folder: str) -> DataFrame:
    windows = [("STANDARD ANODIZED", 1), ("STANDARD", 2), ("PROMO", 3), ("ECONOMY BURNISHED", 4)]
    parts = table(spark, folder, "part")
    return parts.select("p_partkey", tokens.window_of(F.col("p_type"), windows, 9).alias("window"))


def model_windows(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "messages").select("model").where("model is not null").distinct()
    return models.select("model", tokens.window_of(F.col("model")).alias("window"))


def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    noisy = F.concat(F.lit("<system-reminder>"), F.substring("text", 1, 9), F.lit("\n</system-reminder># **"), F.substring("text", 1, 30), F.lit("** <b>out</b> [Request interrupted by user] <br/>"), F.col("text"))
    return docs.select("doc_id", recap.clean(noisy).alias("text"))


def team_state(spark: SparkSession, folder: str) -> DataFrame:
    state = team.team_state(_call_lines(spark, folder))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return state.select("session_id", "team_name", count("teammates"), count("tasks"), "messages", "last_line")


def types_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return diagnosis.ranked_types(diagnosis.type_stats(_lines(spark, folder)))


def health_checks(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    backup = F.when(F.col("session_id").startswith("b"), F.concat("path", F.lit(".bak"))).otherwise(F.col("path"))
    return diagnosis.health(files.withColumn("path", backup), 5, (50, 200), 10)


def topic_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recap.topics(recap.user_turns(_lines(spark, folder)))


def recent_topics(spark: SparkSession, folder: str) -> DataFrame:
    return recap.recent(recap.topics(recap.user_turns(_lines(spark, folder)))).select("session_id", "rank", "line_index", "earlier")


def word_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return recap.word_coverage(recap.topics(recap.user_turns(_lines(spark, folder))))


def themes(spark: SparkSession, folder: str) -> DataFrame:
    return recap.themes(recap.topics(recap.user_turns(_lines(spark, folder))))


def breaker_window(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "events").where(F.col("event_type") == "error")
    errors = errors.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"), "event_id")
    return diagnosis.breaker_windows(errors, 86_400)


def guard_tiers(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return files.select("path", diagnosis.tier(F.col("size"), 5_000_000.0).alias("tier"), scalar.truncate(F.col("project"), 12).alias("short"))


def overflow_sessions(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn("raw", F.concat_ws(" ", F.transform("blocks", scalar.text_of)))
    return sessions.tail_contains(lines, "after the last merge", 20)


def formats(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return files.select("path", scalar.format_bytes(F.col("size")).alias("bytes"), scalar.format_tokens(F.col("lines")).alias("lines"), scalar.format_bar(F.col("size") / 1e5).alias("bar"), scalar.path_of(F.col("project")).alias("cwd"))


def guard_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table as a file stream, in one run to its end; events of sessions that reach a tier."""
    place = shared_folder(spark, f"guard-{uuid.uuid4().hex}")
    batch = table(spark, folder, "messages")
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/messages.parquet*").select("session_id", "byte_size")
    query = guard.start_guard(stream, f"{place}/events", f"{place}/checkpoint", hard=20_000, available_now=True, name=f"guard_{uuid.uuid4().hex}")
    query.awaitTermination()
    return spark.read.parquet(f"{place}/events").select("session_id", "bytes", "tier")


def queries() -> dict[str, Query]:
    """All queries of the core by name."""
    named = (
        p3_found, p3_unified, p6_found, p6_nodes, p6_schema, p6_tables, catalog_totals, newest_session, resolve_prefix, tail_match, tail_match_50, collapse_savings, apply_removals, prescription_gentle,
        prescription_report, team_protected_gentle, task_upsert, config_merge, model_window_lookup, topic_dedup, recent_topics, word_coverage, themes, breaker_window, guard_tiers,
        overflow_sessions, formats, guard_stream, model_windows, clean_texts, team_state, types_by_bytes, health_checks,
    )
    events = lambda spark, folder: cut(adapters.events_as_calls(table(spark, folder, "events")))
    sample = lambda f: lambda spark, folder: f(_files(spark, folder))
    return {f.__name__: f for f in named} | {
        "session_catalog": _files,
        "session_totals": _on_lines(diagnosis.totals),
        "type_stats": _on_lines(diagnosis.type_stats),
        "largest_messages": _on_lines(diagnosis.largest),
        "block_stats": _on_lines(diagnosis.block_stats),
        "diagnose": _on_lines(lambda m: diagnosis.diagnose(m).drop("types", "largest")),
        "progress_collapse": _acted("progress-collapse"),
        "file_history_dedup": _acted("file-history-dedup", "reason"),
        "metadata_strip": _acted("metadata-strip", "pruned_bytes"),
        "thinking_remove": _acted("thinking-blocks", "size(new_blocks) as blocks_left", "pruned_bytes"),
        "thinking_truncate": _new_text("thinking-blocks", "thinking", {"thinking_mode": "truncate"}),
        "thinking_signature_only": _acted("thinking-blocks", "pruned_bytes", source=_signed, config={"thinking_mode": "signature-only"}),
        "signature_stats": lambda spark, folder: diagnosis.block_stats(_signed(spark, folder)).select("session_id", "thinking_bytes", "signature_bytes"),
        "output_trim_bytes": _new_text("tool-output-trim", "tool_result", {"tool_output_max_bytes": 1024}),
        "output_trim_lines": _new_text("tool-output-trim", "tool_result", {"tool_output_max_lines": 10}),
        "mega_trim": _new_text("mega-block-trim", "text", {"mega_block_max_bytes": 2048}),
        "document_dedup": _new_text("document-dedup", "text", {"document_dedup_min_bytes": 300}),
        "file_events": _on_lines(strategies.file_events),
        "stale_read_lines": lambda spark, folder: strategies.stale_reads_of(_file_events(spark, folder)),
        "read_results": _on_lines(lambda m: strategies.read_results(m).select("session_id", "read_line", "line_index", "id")),
        "stale_reads": _acted("stale-reads", "pruned_bytes", source=_file_events),
        "reminder_copies": lambda spark, folder: strategies.reminder_copies(_documents("text", _tagged)(spark, folder)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("reminders"), F.count_if("again").alias("again")),
        "reminder_dedup": _acted("system-reminder-dedup", "get(new_blocks, 0).text as text", "pruned_bytes", source=_documents("text", _tagged)),
        "http_runs": _acted("http-spam"),
        "error_retry": _acted("error-retry-collapse", source=events),
        "poll_runs": _acted("background-poll-collapse", "reason"),
        "constant_fields": _on_lines(lambda m: strategies.constant_fields(m).select("session_id", F.array_join("fields", ",").alias("fields"))),
        "envelope_strip": _acted("envelope-strip", "pruned_bytes"),
        "token_heuristic": _on_lines(tokens.heuristic),
        "token_breakdown": _on_lines(tokens.breakdown),
        "last_usage": _on_lines(tokens.last_usage),
        "last_model": _on_lines(tokens.last_model),
        "token_estimate": _on_lines(tokens.estimate),
        "calibration": _on_lines(tokens.calibration),
        "tail_tokens": _on_lines(lambda m: tokens.tail_estimate(m, 5_000)),
        "tail_tokens_50k": _on_lines(tokens.tail_estimate),
        "team_filter": _on_lines(lambda m: team.team_lines(m).select(*KEY)),
        "subagents": lambda spark, folder: team.subagents(adapters.calls_as_agents(table(spark, folder, "team_calls"))),
        "recap": _on_lines(recap.recap),
        "oversized": sample(lambda f: diagnosis.oversized(f, 5)),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the same results."""
    return dict(SQL)


__all__ = ["cut", "oracle_sql", "queries"]
