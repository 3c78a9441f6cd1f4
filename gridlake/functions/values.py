"""Expressions that recognise and convert cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import trim_ws


def _literal_number(text: Column) -> Column:
    """Double for text spelled as a number literal, else NULL."""
    bare = trim_ws(text)
    digits = F.translate(bare, "_", "")
    return F.when(bare.rlike(fv.FLOAT_LITERAL), digits).when(
        F.lower(bare).isin(fv.FLOAT_WORDS), bare).try_cast("double")


def to_number(c: Column, percent: str = "null") -> Column:
    """Number of a cell. Thousands commas go; percent='scale' reads '12%' as 0.12."""
    no_commas = F.translate(c, ",", "")
    value = _literal_number(no_commas)
    if percent == "scale":
        scaled = _literal_number(F.regexp_replace(no_commas, f"%{fv.WS}*\\z", "")) / 100
        value = F.when(trim_ws(no_commas).endswith("%"), scaled).otherwise(value)
    return value


def is_numeric(c: Column) -> Column:
    """Looks numeric once commas and percent signs are removed; FALSE for NULL."""
    marked = c.contains(",") | c.contains("%")
    bare = trim_ws(F.when(marked, F.translate(c, ",%", "")).otherwise(c))
    return F.coalesce(
        bare.rlike(fv.FLOAT_LITERAL) | F.lower(bare).isin(fv.FLOAT_WORDS), F.lit(False))


def is_date_like(c: Column) -> Column:
    """Has a digit and date punctuation; only a shape test, see to_timestamp."""

    def after(mark: str) -> Column:
        return F.instr(c, mark) + 1

    def many(mark: str) -> Column:
        second = F.call_function("locate", F.lit(mark), c, after(mark))
        return c.contains(mark) & (second > 0)

    marked = many("/") | many("-") | (c.contains(":") & (c.contains("/") | c.contains("-")))
    return F.coalesce(marked & c.rlike(r"\d"), F.lit(False))


def is_long_id(c: Column) -> Column:
    """Only digits, at least ten of them."""
    return F.coalesce(trim_ws(c).rlike(r"^\d{10,}\z"), F.lit(False))


def has_leading_zero(c: Column) -> Column:
    return F.coalesce(trim_ws(c).rlike(r"^0\d+\z"), F.lit(False))


def exceeds_exact_double(c: Column) -> Column:
    """Too large for a double to hold every integer."""
    number = _literal_number(F.translate(c, ",%", ""))
    return F.coalesce(~F.isnan(number) & (F.abs(number) > fv.MAX_EXACT_INTEGER), F.lit(False))


def is_identifier_name(c: Column) -> Column:
    return F.coalesce(c.rlike(fv.IDENTIFIER_NAME), F.lit(False))


def to_timestamp(c: Column) -> Column:
    """Zone-free timestamp of the seven accepted spellings, day before month, else NULL."""
    text = trim_ws(c)
    time = rf"((?:{fv.WS}+|T)\d{{1,2}}:\d{{1,2}}:\d{{1,2}})?"
    blank_time = rf"(?:{fv.WS}+\d{{1,2}}:\d{{1,2}}:\d{{1,2}})?"
    dashed = F.when(text.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{time}\z"), text)
    slashed = F.when(
        text.rlike(rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{blank_time}\z"),
        F.translate(text, "/", "-"),
    )
    year_last = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
    day_first = F.when(text.rlike(year_last), F.regexp_replace(text, year_last, "$3-$2-$1"))
    month_first = F.when(text.rlike(year_last), F.regexp_replace(text, year_last, "$3-$1-$2"))
    spellings = [
        F.regexp_replace(s, f"{fv.WS}+", " ").try_cast("timestamp_ntz")
        for s in (dashed, slashed, day_first, month_first)
    ]
    return F.coalesce(*spellings)


def as_json_value(c: Column, type_name: str) -> Column:
    """Column in a JSON-safe type: decimals as double, times as ISO text, bytes as text."""
    if type_name.startswith("decimal"):
        return c.cast("double")
    if type_name == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if type_name.startswith("timestamp"):
        return F.regexp_replace(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000\z", "")
    if type_name == "binary":
        # Invalid bytes are left out: they turn into replacement marks, which go.
        return F.translate(F.make_valid_utf8(c.cast("string")), "\ufffd", "")
    return c
