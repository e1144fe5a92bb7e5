"""Scalar expressions: sizes of JSON text, text of blocks, formats. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_size(text: Column) -> Column:
    """Bytes of a text in ASCII JSON without quotes: escapes count as they are written."""
    return (
        F.length(text)
        + F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\x0C]'))
        + 5 * F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F\x7F]"))
        + 5 * F.regexp_count(text, F.lit(r"[\x{80}-\x{FFFF}]"))
        + 11 * F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    ).cast("long")


def json_size(text: Column) -> Column:
    """Bytes of a string as an ASCII JSON string, quotes included."""
    return ascii_size(text) + 2


def raw_json_size(text: Column) -> Column:
    """Bytes of compact JSON text once non-ASCII characters are escaped."""
    wide = F.regexp_count(text, F.lit(r"[\x{80}-\x{FFFF}]"))
    return (F.length(text) + 5 * wide + 11 * F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def object_size(members: list[tuple[str, Column]]) -> Column:
    """Bytes of a compact JSON object of (name, size of its value); null sizes are absent members."""
    total, count = F.lit(0), F.lit(0)
    for name, size in members:
        total = total + F.coalesce(size + len(name) + 3, F.lit(0))
        count = count + size.isNotNull().cast("int")
    return (total + F.greatest(count - 1, F.lit(0)) + 2).cast("long")


def text_of(block: Column) -> Column:
    """A block's text: the first of text, thinking and content that isn't empty, else ''."""
    nested = F.array_join(F.transform(block["content_list"], lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(block["text"]), filled(block["thinking"]), filled(block["content_str"]), nested, F.lit(""))


def truthy(flag: Column) -> Column:
    """A boolean with null taken as false."""
    return F.coalesce(flag, F.lit(False))


def preview(text: Column, chars: int = 80) -> Column:
    """First characters of a text on one line."""
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def ends_of(text: Column, half: int, marker: Column) -> Column:
    """First and last `half` characters around a marker."""
    return F.concat(F.substring(text, 1, half), marker, F.right(text, F.lit(half)))


def format_bytes(n: Column) -> Column:
    """B, KB with one decimal, MB with two; 1024 to the next; null stays null."""
    kb, mb = F.format_string("%.1fKB", n / 1024), F.format_string("%.2fMB", n / (1024 * 1024))
    return F.when(n < 1024, F.format_string("%dB", n.cast("long"))).when(n < 1024 * 1024, kb).when(n.isNotNull(), mb)


def format_percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("0%")).when(part.isNotNull() & whole.isNotNull(), F.format_string("%.1f%%", part / whole * 100))


def format_tokens(n: Column) -> Column:
    """Plain, K with one decimal, M with two; 1000 to the next; null stays null."""
    k, m = F.format_string("%.1fK", n / 1000), F.format_string("%.2fM", n / 1_000_000)
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 1_000_000, k).when(n.isNotNull(), m)


def format_bar(percent: Column, width: int = 20) -> Column:
    """A bar of `width` places that `percent` fills, and the whole percents."""
    filled = F.least(F.greatest(F.round(percent / 100 * width).cast("int"), F.lit(0)), F.lit(width))
    bar = F.concat(F.repeat(F.lit("="), filled), F.repeat(F.lit("-"), F.lit(width) - filled))
    return F.when(percent.isNotNull(), F.format_string("[%s] %s%%", bar, F.round(percent).cast("long").cast("string")))


def truncate(text: Column, most: int = 70) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def slug_of(path: Column) -> Column:
    """A working directory's project name."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def path_of(slug: Column) -> Column:
    """The directory a project name stands for; names with '-' come back with '/'."""
    return F.replace(slug, F.lit("-"), F.lit("/"))


def prune_text(tokens_before: Column, tokens_after: Column, saved_bytes: Column) -> Column:
    """What a prune freed in one phrase, tokens first if they are known and not 0."""
    freed, mb = tokens_before - tokens_after, F.format_string("%.1fMB saved", saved_bytes / (1024 * 1024))
    short = F.when(freed >= 1000, F.format_string("%.1fK", freed / 1000)).otherwise(freed.cast("long").cast("string"))
    known = (F.coalesce(tokens_before, F.lit(0)) != 0) & (F.coalesce(tokens_after, F.lit(0)) != 0)
    return F.when(known, F.concat(short, F.lit(" tokens freed ("), format_percent(freed, tokens_before), F.lit("), "), mb)).otherwise(mb)


def clock(at: Column) -> Column:
    """A time as hours, minutes and seconds."""
    return F.date_format(at, "HH:mm:ss")
