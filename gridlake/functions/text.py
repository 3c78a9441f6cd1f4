"""Text expressions: trimming, normalising and cleaning, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.fixed_values import WS, WS_CHARS


def trim_ws(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


def squeeze(c: Column) -> Column:
    """Key form of stored values: trimmed, lower case, inner white space as one blank."""
    return F.regexp_replace(F.lower(trim_ws(c)), f"{WS}+", " ")


def compact(c: Column) -> Column:
    """Key form of looked-up values: no white space at all, lower case."""
    return F.lower(F.translate(c, WS_CHARS, ""))


def one_line(c: Column) -> Column:
    """Cell text for line-oriented output: breaks and tabs become one blank, NULL is empty."""
    return F.coalesce(trim_ws(F.regexp_replace(c, r"[\r\n\t]+", " ")), F.lit(""))


def clean_text(c: Column) -> Column:
    """Drop a leading BOM, use LF line ends, keep at most two empty lines in a row."""
    unix = F.regexp_replace(F.regexp_replace(c, "^\\x{FEFF}", ""), "\r\n|\r", "\n")
    bare = F.regexp_replace(unix, f"(?m)^{_BLANK}+$", "")
    squeezed = F.regexp_replace(bare, "\n{4,}", "\n\n\n")
    edges = F.regexp_replace(F.regexp_replace(squeezed, "\\A\n{3,}", "\n\n"), "\n{3,}\\z", "\n\n")
    return F.when(squeezed.rlike("\\A\n+\\z"), F.left(squeezed, F.lit(1))).otherwise(edges)


# White space that may fill a line, i.e. all of WS but the line feed.
_BLANK = WS.replace("\\n", "")


def clean_lines(c: Column) -> Column:
    """Trim all lines and drop the empty ones."""
    lines = F.transform(F.split(c, "\n"), trim_ws)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def word_count(c: Column) -> Column:
    """Number of white-space separated words, 0 for NULL and blank text."""
    text = trim_ws(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"{WS}+"))).cast("bigint")


def contains_any(c: Column, words: list[str]) -> Column:
    """True if any of a fixed list of words occurs in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit
