"""Mixing sources to target weights, in tokens of a public tokenizer.

Token weights are raked (iterative proportional fitting) to three marginals: the wanted shares of the
sources, and the shares that languages and topics have in the corpus. The cells that are raked are
combinations of source, language and topic, on the driver or, if they are many, by distributed sums
of the groups in every round. Documents are then drawn by the
calibrated weight of their cell: its whole part is certain, its fraction the probability of one copy
more. The draw is a hash of the document, so it can be repeated and needs no order; a last threshold
for each source makes the tokens drawn meet the target.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

#: Vocabulary of ranks (base64 token and rank a line) and the pattern that parts the text before.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Combinations of source, language and topic that are raked on the driver; more are raked as a DataFrame, with the same result.
MOST_CELLS = 50_000
#: Raking ends when no weight changes by more than this share of itself.
SETTLED = 1e-7
ROUNDS = 50
BINS = 4096


def _counter(vocabulary):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.value.splitlines())}
        encoding = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def _title(agenda_item: Column) -> Column:
    """An agenda item's title in lower case, without remarks in brackets; null if it is cut off."""
    title = F.trim(F.regexp_replace(F.lower(agenda_item), r"\([^()]*\)|\s+", " "))
    return F.when(~title.rlike(r"(\.\.\.|…)$") & (title != ""), title)


def topic_of(title: Column) -> Column:
    """The subject of a title: its last two words, which name the kind of business, or 'none'."""
    words = F.filter(F.split(title, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " "), F.lit("")), F.lit("none"))


def _titled(documents: DataFrame) -> DataFrame:
    """The documents with `title`: the one that most documents of the same agenda_id spell out, else their own."""
    own = _title(F.col("agenda_item"))
    if "agenda_id" not in documents.columns:
        return documents.withColumn("title", own)
    spelt = documents.select("agenda_id", own.alias("t")).where("agenda_id is not null and t is not null").groupBy("agenda_id", "t").agg(F.count(F.lit(1)).alias("n"))
    agreed = spelt.groupBy("agenda_id").agg(F.max_by("t", F.struct("n", "t")).alias("agreed"))
    return documents.join(agreed, "agenda_id", "left").withColumn("title", F.coalesce("agreed", own))


def counted(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every document, one row each.

    A document given twice counts once (the copy with the longest text). A null language is 'und',
    case doesn't matter; null texts have no tokens; documents without source or id are left out. The
    topic is the subject of the agenda item, whose title is the one that most documents of its
    agenda_id spell out. The vocabulary, about a megabyte, is read by the driver and sent.
    """
    with open(tokenizer, "rb") as lines:
        vocabulary = documents.sparkSession.sparkContext.broadcast(lines.read())
    count = F.pandas_udf(_counter(vocabulary), "long")
    names = [c for c in ("doc_id", "source", "lang", "agenda_id", "agenda_item", "text") if c in documents.columns]
    kept = documents.select(*names).where(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    rows = kept.select("doc_id", "source", "lang", *[c for c in ("agenda_id", "agenda_item") if c in names], count(F.coalesce("text", F.lit(""))).alias("tokens"))
    rows = _titled(rows).select("doc_id", "source", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), topic_of(F.col("title")).alias("topic"), "tokens")
    one = rows.groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "lang", "topic")).alias("r"))
    return one.select("doc_id", "r.source", "r.lang", "r.topic", "r.tokens")


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells, such that weighted tokens meet the targets of each grouping, the first last.

    `groups[k]` numbers each cell's group, `targets[k]` has the wanted tokens of the groups; no
    weight exceeds the cell's cap. What a group can't reach under the caps it misses.
    """
    weights = np.minimum(np.ones(len(tokens)), caps)
    for _ in range(rounds):
        before = weights
        for group, target in [*zip(groups[1:], targets[1:]), (groups[0], targets[0])]:
            have = np.bincount(group, weights * tokens, minlength=len(target))
            factor = np.divide(target, have, out=np.ones(len(target)), where=have > 0)
            weights = np.minimum(weights * factor[group], caps)
        if (np.abs(weights - before) <= SETTLED * before).all():
            break
    group, target = groups[0], targets[0]
    for _ in range(rounds):  # what caps cut off goes to the source's other cells
        have = np.bincount(group, weights * tokens, minlength=len(target))
        full = weights >= caps * (1 - 1e-12)
        held = np.bincount(group, weights * tokens * full, minlength=len(target))
        factor = np.divide(target - held, have - held, out=np.ones(len(target)), where=(have - held) > 1e-9)
        weights = np.where(full, weights, np.minimum(weights * np.maximum(factor, 0)[group], caps))
    return weights


def rake_cells(cells: DataFrame, goals: DataFrame, size: float, rounds: int = ROUNDS) -> DataFrame:
    """`rake` for any number of cells: source, lang, topic, tokens become source, lang, topic, weight.

    `goals` has source, goal (tokens) and cap. Languages and topics are to keep their shares of
    `size`. Each step sums the groups of one column and multiplies the weights of their cells.
    """
    held = F.col("weight") >= F.col("cap") * (1 - 1e-12)
    have = F.sum(F.col("weight") * F.col("tokens"))
    whole = max(cells.agg(F.sum("tokens")).first()[0] or 0, 1)
    cells = cells.join(goals.select("source", "cap"), "source").withColumn("weight", F.least(F.lit(1.0), "cap"))
    for _ in range(rounds):
        cells = cells.withColumn("before", F.col("weight"))
        for column in ("lang", "topic", "source"):
            sums = cells.groupBy(column).agg(have.alias("have"), (F.sum("tokens") / whole * size).alias("goal"))
            if column == "source":
                sums = sums.drop("goal").join(goals.select("source", "goal"), "source")
            factor = sums.select(column, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(1.0).alias("factor"))
            cells = cells.join(factor, column).withColumn("weight", F.least(F.col("weight") * F.col("factor"), "cap")).drop("factor")
        cells = cut(cells)
        settled = cells.where(F.abs(F.col("weight") - F.col("before")) > SETTLED * F.col("before")).isEmpty()
        cells = cells.drop("before")
        if settled:
            break
    for _ in range(rounds):
        sums = cells.groupBy("source").agg(have.alias("have"), F.sum(F.when(held, F.col("weight") * F.col("tokens")).otherwise(0.0)).alias("held")).join(goals.select("source", "goal"), "source")
        left = F.col("have") - F.col("held")
        factor = sums.select("source", F.when(left > 1e-9, F.greatest((F.col("goal") - F.col("held")) / left, F.lit(0.0))).otherwise(1.0).alias("factor"))
        grown = F.when(held, F.col("weight")).otherwise(F.least(F.col("weight") * F.col("factor"), "cap"))
        if not cells.join(factor, "source").where(F.abs(grown - F.col("weight")) > 1e-12 * F.col("weight")).limit(1).count():
            break
        cells = cut(cells.join(factor, "source").withColumn("weight", grown).drop("factor"))
    return cells.select("source", "lang", "topic", "weight")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, most_cells: int = MOST_CELLS) -> DataFrame:
    """The chosen documents: doc_id, source, tokens, repeats (at least 1).

    `targets` has source, weight and max_repeats; sources that it doesn't list aren't used. `total`
    is the wanted size in tokens, by default that of all listed sources together. A source that
    can't reach its share gives all its documents max_repeats times. Weights needn't sum to 1;
    null or non-positive weights and repeats count as 0, a source listed twice has the greatest of its values.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").cast("double").alias("cap"))
    wanted = wanted.where((F.col("weight") > 0) & (F.col("cap") > 0))
    docs = cut(counted(documents, tokenizer).join(wanted.select("source"), "source", "left_semi"))
    cells = cut(docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    size = float(total if total is not None else cells.agg(F.sum("tokens")).first()[0] or 0)
    weight = wanted.agg(F.sum("weight")).first()[0]
    if cells.isEmpty():
        return docs.select("doc_id", "source", "tokens", F.lit(1).cast("long").alias("repeats"))
    goals = wanted.select("source", (F.col("weight") / weight * size).alias("goal"), "cap")
    few = cells.join(goals, "source").limit(most_cells + 1).toPandas()
    if len(few) <= most_cells:
        tokens = few["tokens"].to_numpy(dtype=float)
        numbers = [pd.factorize(few[c], sort=True)[0] for c in ("source", "lang", "topic")]
        meant = [few.groupby("source", sort=True)["goal"].first().to_numpy()]
        meant += [np.bincount(n, tokens) / max(tokens.sum(), 1) * size for n in numbers[1:]]
        few["weight"] = rake(tokens, numbers, meant, few["cap"].to_numpy())
        weights = F.broadcast(documents.sparkSession.createDataFrame(few[["source", "lang", "topic", "weight"]]))  # at most most_cells rows
    else:
        weights = rake_cells(cells, cut(goals), size)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = docs.join(weights, ["source", "lang", "topic"])
    drawn = drawn.withColumn("sure", F.floor(F.col("weight") + 1e-9)).withColumn("part", F.greatest(F.col("weight") - F.col("sure"), F.lit(0.0)))
    # a document gets one copy more if its rank is below its source's threshold, which is 1 but
    # for the chance of the draw
    rank = F.when(F.col("part") > 1e-9, F.least(F.floor(uniform / F.col("part") * (BINS / 4)), F.lit(BINS))).otherwise(BINS + 1)
    drawn = cut(drawn.select("doc_id", "source", "tokens", "sure", rank.cast("long").alias("rank")))
    # the threshold is found among a source's few thousand ranks, for all sources at once
    sums = drawn.groupBy("source", "rank").agg(F.sum("tokens").alias("n"), F.sum(F.col("sure") * F.col("tokens")).alias("sure"))
    of_source = Window.partitionBy("source")
    left = F.col("goal") - F.sum("sure").over(of_source)
    reached = F.sum("n").over(of_source.orderBy("rank")) - F.col("n") / 2
    takes = (F.col("rank") <= BINS) & (F.col("reached") <= F.col("left"))
    limits = sums.join(goals, "source").withColumn("left", left).withColumn("reached", reached).groupBy("source").agg(F.max(F.when(takes, F.col("rank"))).alias("below"))
    drawn = drawn.join(limits, "source")
    repeats = (F.col("sure") + (F.col("rank") <= F.coalesce("below", F.lit(-1))).cast("long")).cast("long")
    return drawn.select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """What each source was to give and gives: source, weight, max_repeats, documents, tokens, actual_share, most_repeats.

    `tokens` counts repeats; a source that gives nothing has 0.
    """
    chosen = cut(mix(documents, targets, total, seed, tokenizer))
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = by.groupBy(F.lit(1).alias("one")).agg(F.sum("tokens").alias("whole"))
    out = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    out = out.join(by, "source", "left").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one", "left")  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    share = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0))
    return out.select("source", "weight", "max_repeats", zero("documents"), zero("tokens"), share.alias("actual_share"), zero("most_repeats"))
