"""Applying actions, and running prescriptions: one operator on the result of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.model import list_size
from skein.plans.prescriptions import PRESCRIPTIONS, STRATEGIES
from skein.session import cut

KEY = ["session_id", "line_index"]


def _marked(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """All lines as they are after the actions, with what happened to each: _was (bytes), _gone, _saved, _removed, _replaced."""
    per_line = actions.groupBy(*KEY).agg(
        F.max(F.col("action") == "remove").alias("_gone"),
        F.max_by(F.struct("pruned_bytes", "new_blocks", "new_envelope", "new_inner"), F.when(F.col("action") == "replace", F.col("ord"))).alias("_new"),
        F.sum(F.col("original_bytes") - F.col("pruned_bytes")).cast("long").alias("_saved"), F.count_if(F.col("action") == "remove").alias("_removed"), F.count_if(F.col("action") == "replace").alias("_replaced"),
    )
    out = lines.join(per_line, KEY, "left")
    new = F.col("_new")
    changed = new.isNotNull()
    take = lambda then, name: F.when(changed, then).otherwise(F.col(name)).alias(name)
    renewed = {
        "byte_size": new["pruned_bytes"], "canonical_size": new["pruned_bytes"], "blocks": new["new_blocks"], "envelope": new["new_envelope"], "inner": new["new_inner"],
        "content_kind": F.when(F.size(new["new_blocks"]) > 0, "list").otherwise(F.col("content_kind")),
    }
    renewed["content_size"] = F.when(F.to_json(new["new_blocks"]) == F.to_json("blocks"), F.col("content_size")).otherwise(list_size(new["new_blocks"]))
    if "usage" in lines.columns:
        kept = F.array_contains(F.map_keys(new["new_inner"]), "usage")
        renewed["usage"] = F.when(kept, F.col("usage"))
    if "is_sidechain" in lines.columns:
        renewed["is_sidechain"] = F.when(F.array_contains(F.map_keys(new["new_envelope"]), "isSidechain"), F.col("is_sidechain"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        *[take(renewed[c], c) if c in renewed else F.col(c) for c in lines.columns], F.col("byte_size").alias("_was"), F.coalesce("_gone", F.lit(False)).alias("_gone"), zero("_saved"), zero("_removed"), zero("_replaced")
    )


def apply_actions(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """The lines after the actions: removal beats replacement, the last replacement of a line counts."""
    return _marked(lines, actions).where("not _gone").select(*lines.columns)


def savings(name: str, lines: DataFrame, actions: DataFrame) -> DataFrame:
    """What one operator saves in each session: strategy, session_id, original_bytes, saved_bytes, removed, replaced."""
    totals = lines.groupBy("session_id").agg(F.sum("byte_size").cast("long").alias("original_bytes"))
    done = actions.groupBy("session_id").agg(
        F.sum(F.col("original_bytes") - F.col("pruned_bytes")).cast("long").alias("saved"),
        F.count_if(F.col("action") == "remove").alias("gone"), F.count_if(F.col("action") == "replace").alias("changed"),
    )
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    return totals.join(done, "session_id", "left").select(
        F.lit(name).alias("strategy"), "session_id", "original_bytes", zero("saved", "saved_bytes"), zero("gone", "removed"), zero("changed", "replaced")
    )


def run_strategies(lines: DataFrame, names: list[str], config: dict | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The lines after the named operators in turn, and the savings of each; unknown names are skipped.

    Each step is written once to the checkpoint folder, lines and what happened to them together: the
    next step reads it several times, and its savings are read from it.
    """
    config = config or {}
    reports, current = [], cut(lines)
    for name in names:
        if name not in STRATEGIES:
            continue
        marked = cut(_marked(current, STRATEGIES[name].function(current, config)))
        whole = lambda c: F.sum(c).cast("long")
        reports.append(marked.groupBy("session_id").agg(
            whole("_was").alias("original_bytes"), whole("_saved").alias("saved_bytes"), whole("_removed").alias("removed"), whole("_replaced").alias("replaced")
        ).select(F.lit(name).alias("strategy"), "session_id", "original_bytes", "saved_bytes", "removed", "replaced"))
        current = marked.where("not _gone").select(*lines.columns)
    return current, reports


def run_prescription(lines: DataFrame, name: str, config: dict | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The lines after a prescription (gentle, standard, aggressive; anything else is standard)."""
    return run_strategies(lines, PRESCRIPTIONS.get(name, PRESCRIPTIONS["standard"]), config)
