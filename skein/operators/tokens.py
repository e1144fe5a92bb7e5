"""Token estimates of sessions: exact from recorded usage, else from characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import text_of, truthy

# Windows of known models in order of precedence, and the constants of the estimate.
MODEL_WINDOWS = [
    ("claude-opus-4-6", 1_000_000), ("claude-opus-4-5", 200_000), ("claude-sonnet-4-6", 200_000), ("claude-sonnet-4-5", 200_000), ("claude-haiku-4-5", 200_000),
    ("claude-3-5-sonnet", 200_000), ("claude-3-5-haiku", 200_000), ("claude-3-opus", 200_000), ("claude-3-sonnet", 200_000), ("claude-3-haiku", 200_000),
]
DEFAULT_WINDOW = 200_000
OVERHEAD = 21_000
CHARS_PER_TOKEN = 3.7


def is_context(types: Column, sidechain: Column, blocks: Column) -> Column:
    """Whether a line takes part in the context: not progress, snapshot, side branch or mere thinking."""
    speaks = F.exists(blocks, lambda b: truthy(b["type"].isin("text", "tool_use", "tool_result")))
    return ~types.isin("progress", "file-history-snapshot") & ~truthy(sidechain) & ((types != "assistant") | (F.size(blocks) == 0) | speaks)


def block_chars(b: Column) -> Column:
    """Characters of a block that count: none of thinking, its text, or the whole of a tool block."""
    text = F.length(text_of(b))
    return F.when(truthy(b["type"] == "thinking"), 0).when(text > 0, text).when(truthy(b["type"].isin("tool_use", "tool_result")), b["size"]).otherwise(0).cast("long")


def line_chars(lines: DataFrame) -> DataFrame:
    """session_id, type, chars of every line of the context."""
    rows = lines.where(is_context(F.col("type"), F.col("is_sidechain"), F.col("blocks")))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + block_chars(b))
    return rows.select("session_id", "type", chars.alias("chars"))


def _tokens(chars: Column, per_token: float) -> Column:
    return (chars / per_token).cast("long")


def heuristic(lines: DataFrame, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Every session's estimate from characters: session_id, chars, tokens. Sessions without context have the overhead."""
    every = lines.select("session_id").distinct()
    sums = line_chars(lines).groupBy("session_id").agg(F.sum("chars").alias("chars"))
    out = every.join(sums, "session_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)).cast("long"))
    return out.withColumn("tokens", _tokens(F.col("chars"), per_token) + OVERHEAD)


def breakdown(lines: DataFrame, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Tokens by type of line, without overhead: session_id, type, tokens."""
    sums = line_chars(lines).groupBy("session_id", "type").agg(F.sum("chars").cast("long").alias("chars"))
    return sums.select("session_id", "type", _tokens(F.col("chars"), per_token).alias("tokens"))


def last_usage(lines: DataFrame) -> DataFrame:
    """The last usage on the main branch: session_id, line_index and the four counts, total (output left out)."""
    main = lines.where((F.col("type") == "assistant") & ~truthy(F.col("is_sidechain")) & ~F.col("parse_error") & F.col("usage").isNotNull())
    last = main.groupBy("session_id").agg(F.max(F.struct("line_index", "usage")).alias("l"))
    part = lambda n: F.coalesce(F.col(f"l.usage.{n}"), F.lit(0)).alias(n)
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    out = last.select("session_id", F.col("l.line_index").alias("line_index"), *[part(n) for n in names])
    return out.withColumn("total", F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens"))


def last_model(lines: DataFrame) -> DataFrame:
    """The last model named on the main branch: session_id, model."""
    main = lines.where((F.col("type") == "assistant") & ~truthy(F.col("is_sidechain")) & (F.col("model") != ""))
    return main.groupBy("session_id").agg(F.max_by("model", "line_index").alias("model"))


def window_of(model: Column, windows: list[tuple[str, int]] = MODEL_WINDOWS, default: int = DEFAULT_WINDOW) -> Column:
    """A model's context window: of its exact name, else of the first name that it begins with."""
    exact = F.coalesce(*[F.when(model == name, size) for name, size in windows])
    prefix = F.coalesce(*[F.when(model.startswith(name), size) for name, size in windows])
    return F.coalesce(exact, prefix, F.lit(default)).cast("long")


def estimate(lines: DataFrame) -> DataFrame:
    """Each session's estimate: session_id, total, context_pct, method, confidence, model, context_window."""
    exact = last_usage(lines).select("session_id", F.col("total").alias("exact"))
    out = heuristic(lines).join(exact, "session_id", "left").join(last_model(lines), "session_id", "left")
    known = F.col("exact").isNotNull()
    out = out.withColumn("total", F.coalesce("exact", "tokens")).withColumn("context_window", window_of(F.col("model")))
    return out.select(
        "session_id", "total", F.round(F.col("total") / F.col("context_window") * 100, 1).alias("context_pct"),
        F.when(known, "exact").otherwise("heuristic").alias("method"), F.when(known, "high").otherwise("medium").alias("confidence"), "model", "context_window",
    )


def calibration(lines: DataFrame) -> DataFrame:
    """Characters a token by recorded usage: session_id, chars_per_token; null without usage above the overhead."""
    both = heuristic(lines).join(last_usage(lines).select("session_id", "total"), "session_id", "left")
    above = F.col("total") - OVERHEAD
    return both.select("session_id", F.when(above > 0, F.round(F.col("chars") / above, 2)).alias("chars_per_token"))


def tail_estimate(lines: DataFrame, tail_bytes: int = 50 * 1024) -> DataFrame:
    """The last usage within the last `tail_bytes` of a session: session_id, total; sessions without it are left out.

    As when reading a file's end: a line counts if it and all later ones fit, and of a session
    that is longer the first line that would fit only in part is left out.
    """
    from skein.operators.lines import CHUNK_KEY
    from pyspark.sql import Window

    sizes = lines.groupBy(*CHUNK_KEY).agg(F.sum(F.col("byte_size") + 1).alias("n"))
    later = Window.partitionBy("session_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*CHUNK_KEY, F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"))
    inside = Window.partitionBy(*CHUNK_KEY).orderBy(F.col("line_index").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = lines.join(sizes.where(F.col("after") <= tail_bytes), CHUNK_KEY)
    near = near.withColumn("end", F.col("after") + F.sum(F.col("byte_size") + 1).over(inside)).where(F.col("end") <= tail_bytes)
    return last_usage(near).select("session_id", "total")
