"""Credentials embedded in source code and settings: found corpus-wide, and redacted in place.

1. Every text is scanned once for literals in places that hold credentials, and for literals that
   look issued by a machine.
2. The literals are indexed corpus-wide: how many owners (sessions) use each. What has the form of a
   default or a guess and is used by more than a share of all owners is a placeholder. Other forms
   stay however many share them, as one file copied into many sessions gives its credentials many
   owners.
3. Literals of credential form are confirmed, those of default form only where they are rare.
4. Every text is scanned again for the confirmed values, so a secret is also found where nothing
   around it says what it is. Each value is known by its longest word; the words of every text are
   looked up in a bitmap of bounded size, and the texts that pass are joined with their values and
   searched with an Aho-Corasick automaton over the values of the batch. The number of scans is the
   same however many values there are, and none goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.sketch import bitmap
from skein.llm import secret_patterns as patterns
from skein.session import cut

#: A literal of default form used by more than this share of all owners is a shared placeholder ...
MOST_SHARE = 0.005
#: ... if there are owners enough to speak of a share.
LEAST_OWNERS = 10

FIELDS = ("content", "input")


def _views(block: pd.Series) -> Iterator[tuple[str, str]]:
    for field in FIELDS:
        text = getattr(block, field)
        if isinstance(text, str) and text:
            yield field, patterns.opened(text) if field == "input" else text


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for block in pdf.itertuples(index=False):
            for field, text in _views(block):
                for start, value, kind, end in patterns.literals(text):
                    shaped = not patterns.placeholder(value) if kind != "key" else True
                    default = kind != "key" and patterns.stand_in(value)
                    rows.append((block.block_id, block.session_id, field, start, end, value, kind, shaped, default))
        yield pd.DataFrame(rows, columns=["block_id", "session_id", "field", "start_pos", "end_pos", "value", "kind", "shaped", "stand_in"])


def candidate_literals(blocks: DataFrame) -> DataFrame:
    """Literals of `content` and `input`: block_id, session_id, field, start_pos, end_pos, value, kind, shaped, stand_in.

    `shaped` is false for what is empty, masked, a stand-in or a reference by its form alone,
    `stand_in` true for what has the form of a default or a guess. Null or empty fields give
    nothing; rows without block_id are left out.
    """
    schema = "block_id long, session_id string, field string, start_pos long, end_pos long, value string, kind string, shaped boolean, stand_in boolean"
    src = blocks.where(F.col("block_id").isNotNull() & (F.col("content").isNotNull() | F.col("input").isNotNull()))
    return src.select("block_id", "session_id", *FIELDS).mapInPandas(_scan, schema)


def literal_index(literals: DataFrame) -> DataFrame:
    """For each literal the number of owners and of places: value, owners, places.

    Owners are sessions; a missing session counts as an owner of its own. Counted in two steps,
    first (value, owner), so that a placeholder used everywhere is reduced before it is shuffled.
    """
    pairs = literals.groupBy("value", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("places"))


def confirmed_secrets(literals: DataFrame, owners: int, most_share: float = MOST_SHARE) -> DataFrame:
    """Values that are of credential form; those of default form only if few of all `owners` use them."""
    shaped = literals.where(F.col("shaped"))
    rare = literal_index(shaped.where(F.col("stand_in"))).where(F.col("owners") <= max(LEAST_OWNERS, most_share * owners))
    return literal_index(shaped.where(~F.col("stand_in"))).unionByName(rare)


_WORD = re.compile(r"\w+")


def _number(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each value with the hash of its longest word: where the value stands apart, so does that word."""
    for pdf in batches:
        words = [max(_WORD.findall(v), key=len, default=None) for v in pdf["value"]]
        yield pd.DataFrame([(v, _number(w)) for v, w in zip(pdf["value"], words) if w], columns=["value", "anchor"])


def _word_scan(members):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, words = [], []
            for block in pdf.itertuples(index=False):
                own = set()
                for _, text in _views(block):
                    own.update(_WORD.findall(text))
                words.extend(own)
                ids.extend([block.block_id] * len(own))
            known = {w: _number(w) for w in set(words)}
            out = pd.DataFrame({"block_id": ids, "anchor": [known[w] for w in words]}).astype("int64")
            yield out[members.value(out["anchor"].to_numpy())]

    return scan


def _rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        automaton = ahocorasick.Automaton()
        for values in pdf["values"]:
            for value in values:
                automaton.add_word(value, len(value))
        automaton.make_automaton()
        rows = []
        for block in pdf.itertuples(index=False):
            for field, text in _views(block):
                for last, size in automaton.iter(text):
                    start, end = last + 1 - size, last + 1
                    if (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                        continue
                    rows.append((block.block_id, field, start, end))
        yield pd.DataFrame(rows, columns=["block_id", "field", "start_pos", "end_pos"])


def _apart(spans: pd.Series) -> pd.Series:
    """Of spans that overlap the one that starts first; of those that start together the longest."""
    out = []
    for held in spans:
        kept, end = [], -1
        for s in sorted(((x["start_pos"], -x["end_pos"]) for x in held)):
            if s[0] >= end:
                kept.append({"start_pos": s[0], "end_pos": -s[1]})
                end = -s[1]
        out.append(kept)
    return pd.Series(out)


def find_secrets(blocks: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """All places of confirmed secrets: block_id, field, start_pos, end_pos.

    Positions count code points of the column as stored; a secret in pieces has the start of its
    first and the end of its last piece. Repeated rows give one row. Where hits overlap, as a
    value inside a private key or a longer value, the one that starts first stays (the longest of
    those that start together). Private keys are found by their own first line, so they are not
    searched for again.
    """
    literals = cut(candidate_literals(blocks))
    owners = blocks.select("session_id").distinct().count()
    secrets = cut(confirmed_secrets(literals, owners, most_share).select("value"))
    found = literals.where("shaped").join(secrets, "value", "left_semi").select("block_id", "field", "start_pos", "end_pos")
    spread = secrets.where(~F.col("value").startswith("-----BEGIN"))
    anchors = cut(spread.mapInPandas(_anchors, "value string, anchor long"))
    src = blocks.where(F.col("block_id").isNotNull() & (F.col("content").isNotNull() | F.col("input").isNotNull())).select("block_id", *FIELDS)
    near = src.mapInPandas(_word_scan(bitmap(anchors, "anchor")), "block_id long, anchor long").distinct()
    wanted = near.join(anchors, "anchor").groupBy("block_id").agg(F.collect_set("value").alias("values"))
    again = src.join(wanted, "block_id").mapInPandas(_rescan, "block_id long, field string, start_pos long, end_pos long")
    spans = found.unionByName(again).distinct().groupBy("block_id", "field").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("all"))
    apart = F.pandas_udf(_apart, "array<struct<start_pos:bigint,end_pos:bigint>>")
    return spans.select("block_id", "field", F.explode(apart("all")).alias("s")).select("block_id", "field", "s.start_pos", "s.end_pos")


def _blank(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, s):
        if t is None or s is None:
            return t
        parts, end = [], 0
        for at in sorted(s, key=lambda x: x["start_pos"]):
            parts += [t[end : at["start_pos"]], "REDACTED"]
            end = at["end_pos"]
        return "".join(parts) + t[end:]

    return pd.Series([one(t, s) for t, s in zip(text, spans)])


def redact(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks with every found secret replaced by REDACTED, quotes and code around it kept.

    The columns of `blocks` stay as they are but for content and input. Blocks without secrets
    pass unchanged, and so do nulls; a repeated row is redacted like the first.
    """
    spans = found.groupBy("block_id").agg(
        *[F.collect_list(F.when(F.col("field") == f, F.struct("start_pos", "end_pos"))).alias(f"__skein_{f}") for f in FIELDS]
    )
    joined = blocks.join(spans, "block_id", "left")
    blank = F.pandas_udf(_blank, "string")
    for field in FIELDS:
        joined = joined.withColumn(field, F.when(F.size(F.col(f"__skein_{field}")) > 0, blank(field, f"__skein_{field}")).otherwise(F.col(field)))
    return joined.select(*blocks.columns)
