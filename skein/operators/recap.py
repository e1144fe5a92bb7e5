"""Recaps of sessions: cleaned user topics, themes that cover them, recent ones, where it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import text_of, truncate
from skein.session import cut

# Words that make no theme.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in "
    "for on with at by from as into through during before after above below between out off over under again further then once here there when where "
    "why how all both each few more most other some such no nor not only own same so than too very just don now and but or if while because until it "
    "its this that these those i me my we us our you your he him his she her they them their what which who whom let see get got make go going went "
    "come take give say said know think want look use find tell ask work seem feel try leave call keep put show also well back even still way new one "
    "two first last long great little right old big high different small large next early young important sure ok yes yeah about up like can't don't "
    "doesn't didn't won't wasn't weren't isn't aren't hasn't haven't couldn't wouldn't shouldn't really thing things something anything "
    "everything nothing much many lot lots stuff already done doing made making went been able getting better lets check run set start "
    "change add read write open close update"
).split()
# What is taken out of user texts, in this order, and what is put in its place.
CLEANING = [
    (r"(?s)<system-reminder>.*?</system-reminder>", ""), (r"(?s)<local-command-caveat>.*?</local-command-caveat>", ""), (r"(?s)<command-name>.*?</command-name>", ""),
    (r"(?s)<command-message>.*?</command-message>", ""), (r"(?s)<command-args>.*?</command-args>", ""), (r"(?s)<local-command-stdout>.*?</local-command-stdout>", ""),
    (r"(?s)<[^>]+>.*?</[^>]+>", ""), (r"<[^>]+/?>", ""), (r"(?d)SessionStart:.*", ""), (r"(?d)\[Request interrupted by user.*?\]", ""), ("[▖▗▘▝▚▞]+", ""),
    (r"Claude Code v[\d.]+", ""), (r"Opus \d+\.\d+ · Claude \w+", ""), (r"~/Documents/\S+", ""), (r"#{1,6}\s+", ""), (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
    (r"(?U)\s+", " "), (r"^ | $", ""),
]


def clean(text: Column) -> Column:
    """A user's text without tags, command noise and markup, on one line."""
    for pattern, put in CLEANING:
        text = F.regexp_replace(text, pattern, put)
    return text


def spoken(blocks: Column) -> Column:
    """The text blocks of a line, joined by spaces."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), text_of), " ")


def user_turns(lines: DataFrame) -> DataFrame:
    """session_id, chunk, line_index, topic: cleaned user texts of three characters and more."""
    rows = lines.where(F.col("type") == "user").select("session_id", "chunk", "line_index", clean(spoken(F.col("blocks"))).alias("topic"))
    return rows.where(F.length("topic") >= 3)


def topics(turns: DataFrame, prefix: int = 40) -> DataFrame:
    """The first turn of each beginning: session_id, line_index, topic; case doesn't matter."""
    first = turns.groupBy("session_id", F.lower(F.substring("topic", 1, prefix)).alias("start")).agg(F.min(F.struct("line_index", "topic")).alias("t"))
    return first.select("session_id", "t.line_index", "t.topic")


def topic_words(found: DataFrame) -> DataFrame:
    """Words of each topic that may name a theme: session_id, line_index, word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("topic"), F.lit(r"[a-z][a-z_-]+"), F.lit(0)))
    rows = found.select("session_id", "line_index", F.explode(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))).alias("word"))
    return rows.where(F.length("word") > 2)


def word_coverage(found: DataFrame, least: int = 2) -> DataFrame:
    """How many topics each word is in: session_id, word, topics; words of fewer than `least` left out."""
    return topic_words(found).groupBy("session_id", "word").agg(F.count(F.lit(1)).alias("topics")).where(F.col("topics") >= least)


def themes(found: DataFrame, most: int = 5, least_topics: int = 6) -> DataFrame:
    """Greedy cover of a session's topics by words: session_id, rank, theme, topics.

    Words are taken by how many topics they are in (ties by the alphabet) if at least two of these
    have no theme yet. A word passed over once never qualifies later, so each round takes, for all
    sessions at once, the first word that still does; there are `most` rounds.
    """
    many = found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_topics).select("session_id")
    pairs = cut(topic_words(found).join(many, "session_id", "left_semi"))
    sizes = pairs.groupBy("session_id", "word").agg(F.count(F.lit(1)).alias("topics")).where("topics >= 2")
    open_ = pairs.join(sizes, ["session_id", "word"])
    picked = None
    for rank in range(1, most + 1):
        left = open_.groupBy("session_id", "word", "topics").agg(F.count(F.lit(1)).alias("left")).where("left >= 2")
        best = left.groupBy("session_id").agg(F.min(F.struct((-F.col("topics")).alias("size"), "word")).alias("b"))
        best = cut(best.select("session_id", F.lit(rank).alias("rank"), F.col("b.word").alias("theme"), (-F.col("b.size")).alias("topics")))
        picked = best if picked is None else picked.unionByName(best)
        covered = pairs.join(best.select("session_id", F.col("theme").alias("word")), ["session_id", "word"], "left_semi").select("session_id", "line_index")
        open_ = cut(open_.join(covered, ["session_id", "line_index"], "left_anti"))
    return picked


def recent(found: DataFrame, most: int = 8) -> DataFrame:
    """The last topics, newest first: session_id, rank, line_index, topic, earlier (how many more there are)."""
    total = found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("line_index").desc()))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= most).join(total, "session_id")
    return rows.select("session_id", "rank", "line_index", "topic", F.greatest(F.col("n") - most, F.lit(0)).alias("earlier"))


def recap(lines: DataFrame) -> DataFrame:
    """The recap of each session with a user turn: session_id, recap (text of about a dozen lines)."""
    turns = cut(user_turns(lines))
    found = cut(topics(turns))
    counts = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")).join(found.groupBy("session_id").agg(F.count(F.lit(1)).alias("topics")), "session_id")
    said = lines.where(F.col("type") == "assistant").select("session_id", "line_index", F.trim(F.regexp_replace(spoken(F.col("blocks")), r"(?U)\s+", " ")).alias("text"))
    last = said.where(F.length("text") >= 3).groupBy("session_id").agg(F.max_by("text", "line_index").alias("last"))
    named = themes(found).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat("theme", F.lit(" ("), F.col("topics").cast("string"), F.lit(")")).alias("t")))).alias("themes"))
    late = recent(found).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", truncate(F.col("topic")).alias("t")))).alias("recent"), F.max("earlier").alias("earlier"))
    out = counts.join(late, "session_id").join(named, "session_id", "left").join(last, "session_id", "left")
    text = F.concat(
        F.format_string("\n  PREVIOUSLY ON THIS SESSION\n  %d exchanges | %d topics\n\n", "turns", "topics"),
        F.when(F.size("themes") > 0, F.concat(F.lit("  Themes: "), F.array_join(F.transform("themes", lambda x: x["t"]), ", "), F.lit("\n\n"))).otherwise(""),
        F.lit("  Recent:"), F.array_join(F.transform("recent", lambda x: F.concat(F.lit("\n  - "), x["t"])), ""),
        F.when(F.col("earlier") > 0, F.format_string("\n  ... +%d earlier", "earlier")).otherwise(""),
        F.when(F.col("last").isNotNull(), F.concat(F.lit("\n\n  Last: "), truncate(F.col("last"), 72))).otherwise(""), F.lit("\n"),
    )
    return out.select("session_id", text.alias("recap"))
