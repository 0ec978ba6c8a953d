"""Text and hash expressions used by ingestion, linkage and context building."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell whose trimmed text starts with one of these could run as a formula in a spreadsheet.
FORMULA_START = r"^[=+@|%-]"


def sanitize_cell(cell: Column) -> Column:
    """Text for export: null becomes empty, formula starts are quoted."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(F.trim(text).rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def first_text(*choices: Column) -> Column:
    """The first choice that isn't blank, trimmed, else the empty string."""
    filled = [F.when(F.trim(c) != "", F.trim(c)) for c in choices]
    return F.coalesce(*filled, F.lit(""))


def token_count(text: Column) -> Column:
    """Estimated tokens: a quarter of the code points, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def match_key(name: Column) -> Column:
    """Key under which names are equal: trimmed and in lower case."""
    return F.lower(F.trim(name))


def row_hash(*columns: str) -> Column:
    """Equal for equal values of the named columns, whatever their order in the row; nulls count as values."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def stable_id(name: Column) -> Column:
    """An id that depends on the name alone."""
    return F.sha2(name, 256)


def lakhs(amount: Column) -> Column:
    """An amount as text: above 100,000 in lakhs with one place (halves go up), else whole with thousands apart; null stays null."""
    # format_number alone would take a half to the even side, or to that of the binary fraction
    tenths = F.round(amount / 100_000 * 10, 0)
    return F.when(amount > 100_000, F.concat(F.format_number(tenths / 10, 1), F.lit(" LPA"))).otherwise(F.format_number(amount, 0))


def and_others(names: Column, n: int) -> Column:
    """The first n of the sorted distinct names, and how many others there are."""
    listed = F.array_sort(F.array_distinct(names))
    shown = F.array_join(F.slice(listed, 1, n), ", ")
    return F.when(F.size(listed) > n, F.concat(shown, F.lit(" and "), (F.size(listed) - n).cast("string"), F.lit(" others"))).otherwise(shown)


def truncated(text: Column, n: int) -> Column:
    """The first n characters and three dots, or the whole of a shorter text."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def iso_time(text: Column) -> Column:
    """The moment that ISO text names, with ``Z`` or an offset or none (then UTC); null if it names none."""
    return F.try_to_timestamp(text)


def split_list(cell: Column) -> Column:
    """A list cell: JSON array, else comma-separated; blank and NULL are empty; items are trimmed and not blank."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    items = F.coalesce(F.from_json(text, "array<string>"), F.split(text, ","))
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when((text == "") | (F.upper(text) == "NULL"), F.array().cast("array<string>")).otherwise(kept)


def _literal(cell: str | None) -> list[str]:
    text = (cell or "").strip()
    if not text:
        return []
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [text]
    return [str(v) for v in (value if isinstance(value, list) else [value]) if v is not None]


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(cells: pd.Series) -> pd.Series:
    """A cell in Python's notation: a list without its None items, another value alone, and text as it is."""
    return cells.map(_literal)
