"""Evaluation passages inside training text, whole or in part.

Every item is cut into consecutive pieces of half a passage, so that any passage of `words` words
holds a whole piece; the pieces, as words numbered by the items' own vocabulary, are the patterns of
one Aho-Corasick automaton. Its nodes are thus at most the words of the items, whatever the length
of a passage. Every document is normalised in the same way, with each word's place in the original
kept, and scanned once; a hit is verified by going on word by word to both sides as far as item and
document agree. The automaton is built once in each Python worker.

The items are a fixed set: its words are counted before they are sent to the executors. Sets above
BLOCK_WORDS words are scanned in blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
WORDS = 25
#: Words of items, and so nodes, in one automaton at most: about 600 MB.
BLOCK_WORDS = 4_000_000

# one pass over the text: a bracketed remark, a hyphen at a line's end, or a word
_PIECE = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]|[-‐­][^\S\n]*\n\s*|\w+|­|​")


def normalise(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with their places: (word, start, end).

    Case is folded; punctuation and white space only part words; words broken by a hyphen at a
    line's end are joined; remarks in round or square brackets are left out.
    """
    words: list[tuple[str, int, int]] = []
    join_at = -1
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece[0] in "([":
            continue
        if not (piece[0].isalnum() or piece[0] == "_"):
            if words and words[-1][2] == m.start():
                join_at = m.end()
            continue
        word = piece.casefold().strip("_")
        if not word:
            continue
        if join_at == m.start():
            last, start, _ = words.pop()
            words.append((last + word, start, m.end()))
        else:
            words.append((word, m.start(), m.end()))
    return words


class Passages:
    """The items as an automaton over numbered words, and how far a document agrees with them."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.words = words
        self.piece = max(1, (words + 1) // 2)
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        pieces: dict[tuple, list[tuple[int, int]]] = {}
        for item, text in items:
            plain = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w, _, _ in normalise(text)], dtype=np.int32)
            if len(plain) < words:
                continue
            for at in range(0, len(plain) - self.piece + 1, self.piece):
                pieces.setdefault(tuple(plain[at : at + self.piece].tolist()), []).append((len(self.items), at))
            self.items.append((item, plain))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def spans(self, placed: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, last word) of all that a normalised document holds of the items."""
        if len(placed) < self.words or not self.items:
            return
        line = np.array([self.numbers.get(w, 0) for w, _, _ in placed], dtype=np.int32)
        reached: dict[tuple[int, int], int] = {}  # by item and distance of the places: where agreement ended
        runs: dict[int, list[tuple[int, int]]] = {}
        for last, places in self.automaton.iter(tuple(line.tolist())):
            first = last - self.piece + 1
            for number, at in places:
                item, plain = self.items[number]
                if reached.get((number, first - at), -1) >= last:
                    continue
                ahead = _agree(line[last + 1 :], plain[at + self.piece :])
                back = _agree(line[:first][::-1], plain[:at][::-1])
                reached[number, first - at] = last + ahead
                if back + self.piece + ahead >= self.words:
                    runs.setdefault(item, []).append((first - back, last + ahead))
        for item, found in runs.items():
            begin, end = None, None
            for a, b in sorted(found):
                if begin is None or a > end + 1:
                    if begin is not None:
                        yield item, begin, end
                    begin, end = a, b
                else:
                    end = max(end, b)
            yield item, begin, end


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words are equal; looked at in growing parts, as most agreements are short."""
    size, at, step = min(len(a), len(b)), 0, 32
    while at < size:
        differ = np.flatnonzero(a[at : min(at + step, size)] != b[at : min(at + step, size)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return size


_KEPT: dict[str, Passages] = {}


def _passages(name: str, items, words: int) -> Passages:
    """The automaton of a block of items, built once in a worker and kept for its next tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Passages(items.value, words)
    return _KEPT[name]


def _scanner(items, words: int):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = _passages(name, items, words)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                placed = normalise(text)
                rows.extend((doc, item, placed[a][1], placed[b][2], b - a + 1) for item, a, b in passages.spans(placed))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_pos", "end_pos", "words"])

    return scan


def leaked_spans(documents: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where documents hold at least `words` consecutive words of an item.

    Output: doc_id, item_id, start_pos, end_pos (code points of the original text), words. Items
    shorter than that can't leak; null texts and ids give nothing; a repeated document or item
    counts once. The items are read to the driver in blocks of at most `block_words` words (and one
    item), one scan of the documents for each.
    """
    documents = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    schema = "doc_id long, item_id long, start_pos long, end_pos long, words long"
    spark, block, size, found = documents.sparkSession, [], 0, None

    def scanned(block):
        hits = documents.mapInPandas(_scanner(spark.sparkContext.broadcast(block), words), schema)
        return hits if found is None else found.unionByName(hits)

    for row in items.toLocalIterator():
        count = sum(1 for _ in re.finditer(r"\w+", row.text)) + 1
        if block and size + count > block_words:
            found, block, size = scanned(block), [], 0
        block.append((row.item_id, row.text))
        size += count
    return scanned(block).distinct()


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each document and item it holds a passage of: doc_id, item_id."""
    return leaked_spans(documents, items, words).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """Every item with the number of documents it leaked into: item_id, documents, most_words."""
    spans = leaked_spans(documents, items, words).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("most_words"))
    every = items.where(F.col("item_id").isNotNull()).select("item_id").distinct()
    out = every.join(spans, "item_id", "left")
    return out.select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("most_words", F.lit(0)).cast("long").alias("most_words"))
