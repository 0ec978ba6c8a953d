"""Ingestion: validation, change detection, upserts, edge merges and job summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import row_hash

CONFIRMATION = "CONFIRM DELETE"


def split_valid(rows: DataFrame, required: Sequence[str], row_number: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and one error row for each of the others."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))
    marked = rows.withColumn("_missing", missing)
    errors = marked.where(F.size("_missing") > 0).select(
        F.col(row_number).alias("row_number"), F.concat(F.lit("Missing required field: "), F.concat_ws(", ", "_missing")).alias("error_message"), F.to_json(F.struct(*rows.columns)).alias("raw_data")
    )
    return marked.where(F.size("_missing") == 0).drop("_missing"), errors


def split_typed(rows: DataFrame, required: Sequence[str], types: Mapping[str, str], row_number: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields and the types asked for, and one error row for each of the others.

    A row that lacks a field is reported for that alone; a blank cell of a typed column is null and no error.
    """
    good, errors = split_valid(rows, required, row_number)
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    wrong = F.array_compact(F.array(*[F.when(filled(c).isNotNull() & filled(c).try_cast(t).isNull(), F.lit(f"{c} must be {t}")) for c, t in types.items()]))
    marked = good.withColumn("_wrong", wrong)
    untyped = marked.where(F.size("_wrong") > 0).select(
        F.col(row_number).alias("row_number"), F.concat(F.lit("Invalid data type: "), F.concat_ws(", ", "_wrong")).alias("error_message"), F.to_json(F.struct(*rows.columns)).alias("raw_data")
    )
    typed = marked.where(F.size("_wrong") == 0).drop("_wrong").withColumns({c: filled(c).try_cast(t) for c, t in types.items()})
    return typed, errors.unionByName(untyped)


def merge_batch(rows: DataFrame, key: str, order: str, first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """One row for each key: of some columns the first value that isn't blank, of others the last value, in file order."""
    filled = {c: F.when(F.trim(c) != "", F.col(order)) for c in first}
    earliest = [F.min_by(c, filled[c]).alias(c) for c in first]
    return rows.groupBy(key).agg(*earliest, F.max_by(F.struct(*last), F.col(order)).alias("_last")).select(key, *first, "_last.*")


def batch_number(place: Column, size: int) -> Column:
    """The batch, from 1, that a row's place from 1 falls in."""
    return F.ceil(place / size).cast("long")


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in file order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def first_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in file order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def actions(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, action)`` of each new row: created, updated or unchanged, by the hash of its columns."""
    # a key that the old table repeats is unchanged if any of its rows is
    before = old.groupBy(key).agg(F.collect_set(row_hash(*columns)).alias("old_hash"))
    after = new.select(key, row_hash(*columns).alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "created").when(F.array_contains("old_hash", F.col("new_hash")), "unchanged").otherwise("updated")
    return after.join(before, key, "left").select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], now: Column) -> DataFrame:
    """Old rows with new values laid over them; ``created_at`` stays, ``updated_at`` moves only on change.

    ``old`` has the key, the columns, ``created_at`` and ``updated_at``.
    """
    a = old.select(key, F.struct(*columns).alias("o"), row_hash(*columns).alias("oh"), "created_at", "updated_at")
    b = new.select(key, F.struct(*columns).alias("n"), row_hash(*columns).alias("nh"))
    both = a.join(b, key, "full_outer")
    changed = F.col("nh").isNotNull() & (F.col("oh").isNull() | (F.col("oh") != F.col("nh")))
    value = F.when(F.col("nh").isNotNull(), F.col("n")).otherwise(F.col("o"))
    return both.select(
        key, value.alias("v"), F.coalesce("created_at", now).alias("created_at"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at")
    ).select(key, "v.*", "created_at", "updated_at")


def merge_edges(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("src", "dst")) -> DataFrame:
    """All old edges, and the new ones whose ends aren't linked yet; properties of an edge are set once."""
    added = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(added, allowMissingColumns=True)


def remove_edges(edges: DataFrame, nodes: DataFrame, key: str, both_ends: bool = False) -> DataFrame:
    """Edges without those that start (or start or end) at the given nodes."""
    gone = nodes.select(F.col(key).alias("_gone")).distinct()
    kept = edges.join(gone, edges["src"] == F.col("_gone"), "left_anti")
    return kept.join(gone, kept["dst"] == F.col("_gone"), "left_anti") if both_ends else kept


def removal_counts(edges: DataFrame, nodes: DataFrame, key: str, both_ends: bool = False) -> DataFrame:
    """One row: edges kept and edges removed."""
    kept = remove_edges(edges, nodes, key, both_ends)
    part = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    counts = part(edges, "all").unionByName(part(kept, "kept"))
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("n")))
    return counts.agg(of("kept").alias("kept"), (of("all") - of("kept")).alias("removed"))


def delete_all(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of the nodes and the distinct relationships that go, and the two tables without rows."""
    counts = nodes.agg(F.count("*").alias("nodes")).withColumn("k", F.lit(0)).join(edges.distinct().agg(F.count("*").alias("relationships")).withColumn("k", F.lit(0)), "k").drop("k")  # two single rows
    return counts, nodes.limit(0), edges.limit(0)


def replace_all(old: DataFrame, new: DataFrame, confirmation: str) -> DataFrame:
    """FULL mode: the new rows alone, if the deletion was confirmed by its literal."""
    if confirmation != CONFIRMATION:
        raise ValueError(f"a full load deletes all rows; pass {CONFIRMATION!r}")
    return new


def job_state(processed: Column, failed: Column, total: Column) -> Column:
    """State of an ingestion run from its counts."""
    return (
        F.when(processed + failed < total, "processing")
        .when(processed == 0, "failed")
        .when(failed > 0, "completed_with_errors")
        .otherwise("completed")
    )


def progress(total: Column, done: Column, speed: Column, state: Column, batch: int = 1000) -> tuple[Column, Column, Column]:
    """Percentage (2 places), whole seconds left while the run goes on, and number of batches; null without rows."""
    pct = F.round(F.when(total > 0, done / total * 100).otherwise(F.lit(0.0)), 2)
    eta = F.when((state == "processing") & (speed > 0) & (total > done), F.floor((total - done) / speed)).cast("long")
    return pct, eta, F.when(total > 0, F.ceil(total / batch)).cast("long")


def error_summary(count: Column, total: Column) -> Column:
    return F.concat(F.format_number(count, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" rows failed"))
