"""CSV files: scans with an encoding fallback, previews, checks of their headers, and the sink of rejected rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import sanitize_cell

# Columns that a file of each kind must have.
SKILL_COLUMNS = ("ID", "NAME", "DESCRIPTION", "CATEGORY", "SUBCATEGORY")
JOB_COLUMNS = ("Job ID", "Job Title", "Company Name", "Location", "standardized_skills")
#: What the decoder puts in place of bytes that are not UTF-8.
REPLACED = "�"


def scan(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All cells as text; UTF-8, or Latin-1 if some cell or name is not UTF-8.

    Files with line ends inside cells are read whole by one task each (``multi_line``); without them a large
    file is split. The check for the encoding stops at the first cell that fails.
    """
    read = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    rows = read.csv(path)
    broken = [F.contains(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(REPLACED)) for c in rows.columns]
    foreign = any(REPLACED in c for c in rows.columns) or (bool(broken) and not rows.where(F.greatest(*broken, F.lit(False))).isEmpty())
    return read.option("encoding", "ISO-8859-1").csv(path) if foreign else rows


@dataclass
class Preview:
    rows: DataFrame
    total: int
    has_more: bool


def preview(rows: DataFrame, n: int = 10) -> Preview:
    """The first rows, how many there are, and whether there are more."""
    total = rows.count()
    return Preview(rows.limit(n), total, total > n)


def header_errors(rows: DataFrame, required: Sequence[str]) -> list[str]:
    """What is wrong with a file as a whole: no rows, or columns that are missing whatever their case; empty if nothing is."""
    if rows.isEmpty():
        return ["CSV has header row but no data"]
    found = {c.strip().lower() for c in rows.columns}
    missing = [c for c in required if c.lower() not in found]
    return [f"Required columns: {', '.join(required)}", f"Missing columns: {', '.join(missing)}", f"Found columns: {', '.join(rows.columns)}"] if missing else []


def write_csv(rows: DataFrame, path: str, sanitized: bool = False, quote_all: bool = True) -> None:
    """Write all cells as text with a header; ``sanitized`` quotes cells that a spreadsheet would run."""
    cell = sanitize_cell if sanitized else lambda c: c.cast("string")
    rows.select(*[cell(F.col(f"`{c}`")).alias(c) for c in rows.columns]).write.option("header", True).option("quoteAll", quote_all).option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("errorifexists").csv(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """The file of rejected rows: number, message and the row as JSON, every cell in quotes."""
    write_csv(errors.select("row_number", "error_message", "raw_data").orderBy("row_number"), path)
