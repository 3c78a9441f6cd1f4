"""Spreadsheet coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of up to three letters, which all spreadsheets hold; others take the longer way.
THREE_LETTERS = 18278
#: A 64-bit number has at most so many letters.
MOST_LETTERS = 14


def col_letter(n: Column) -> Column:
    """Letters of a 1-based column number."""

    def letter(zero_based: Column) -> Column:
        return F.char(F.lit(65) + zero_based)

    one = letter(n - 1)
    two = F.concat(letter(F.floor((n - 27) / 26)), letter(F.pmod(n - 27, F.lit(26))))
    three = F.concat(
        letter(F.floor((n - 703) / 676)),
        letter(F.pmod(F.floor((n - 703) / 26), F.lit(26))),
        letter(F.pmod(n - 703, F.lit(26))),
    )
    return (
        F.when(n.between(1, 26), one)
        .when(n.between(27, 702), two)
        .when(n.between(703, THREE_LETTERS), three)
        .when(n > THREE_LETTERS, _letters(n))
    )


def _letters(n: Column) -> Column:
    """Letter by letter from the right."""

    def step(state: Column, _: Column) -> Column:
        last = F.pmod(state["n"] - 1, F.lit(26))
        return F.when(state["n"] > 0, F.struct(
            F.call_function("div", state["n"] - 1, F.lit(26)).alias("n"),
            F.concat(F.char(F.lit(65) + last), state["text"]).alias("text"))).otherwise(state)

    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LETTERS)), start, step, lambda s: s["text"])


def cell_range(first_col: Column, first_row: Column, last_col: Column, last_row: Column) -> Column:
    return F.concat(
        col_letter(first_col), first_row.cast("string"), F.lit(":"),
        col_letter(last_col), last_row.cast("string"),
    )
