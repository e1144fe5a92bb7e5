"""The registry of rewrite operators, and the prescriptions that order them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import strategies as s


class Strategy(NamedTuple):
    """A named operator: message model and settings in, actions out."""

    name: str
    description: str
    tier: str
    function: Callable[[DataFrame, dict], DataFrame]


STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str, description: str, tier: str):
    """Registers a function (lines, config) -> actions under a name."""

    def register(function: Callable[[DataFrame, dict], DataFrame]):
        STRATEGIES[name] = Strategy(name, description, tier, function)
        return function

    return register


# The names and tiers, in the order in which prescriptions run them.
for _name, _what, _tier, _function in (
    ("progress-collapse", "runs of progress lines", "gentle", s.progress_collapse),
    ("file-history-dedup", "repeated file snapshots", "gentle", s.file_history_dedup),
    ("metadata-strip", "token and cost fields", "gentle", s.metadata_strip),
    ("thinking-blocks", "thinking and signatures", "standard", s.thinking_blocks),
    ("tool-output-trim", "long tool results", "standard", s.tool_output_trim),
    ("stale-reads", "reads of files edited later", "standard", s.stale_reads),
    ("system-reminder-dedup", "repeated reminders", "standard", s.reminder_dedup),
    ("http-spam", "progress between web calls", "aggressive", s.http_spam),
    ("error-retry-collapse", "calls repeated after errors", "aggressive", s.error_retry_collapse),
    ("background-poll-collapse", "runs of polls", "aggressive", s.background_poll_collapse),
    ("document-dedup", "copies of large blocks", "aggressive", s.document_dedup),
    ("mega-block-trim", "blocks above a limit", "aggressive", s.mega_block_trim),
    ("envelope-strip", "constant envelope fields", "aggressive", s.envelope_strip),
):
    strategy(_name, _what, _tier)(_function)

PRESCRIPTIONS: dict[str, list[str]] = {
    "gentle": list(STRATEGIES)[:3],
    "standard": list(STRATEGIES)[:7],
    "aggressive": list(STRATEGIES),
}


def recommend(total_bytes: Column) -> Column:
    """The prescription for a session of that size: 5 MB and 20 MB are the borders."""
    mb = total_bytes / (1024 * 1024)
    return F.when(mb < 5, "gentle").when(mb <= 20, "standard").otherwise("aggressive")
