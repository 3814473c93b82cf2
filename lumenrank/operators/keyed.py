"""Keyed tables: upsert, sync, resume and replacement by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def once(rows: DataFrame, keys: str | list[str]) -> DataFrame:
    """The same rows; a key that occurs twice fails the job. A later write by the same keys needs no other shuffle."""
    keys = [keys] if isinstance(keys, str) else keys
    text = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit("key twice in one batch: "), text)).cast("boolean")).otherwise(True)
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` put in by key; columns that rows lack are null.

    Of rows with one key the last by ``order`` counts; without an order a repeated key fails the job.
    """
    rows = once(rows, key) if order is None else newest(rows, key, order)
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def sync(table: DataFrame, source: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``table`` with every row of another table put in by key, and one row (affected): how many that were.

    Rows that the source lacks stay: a sync deletes nothing.
    """
    fresh = source.select(table.columns)
    return upsert(table, fresh, key), fresh.agg(F.count(F.lit(1)).alias("affected"))


def replace_sources(table: DataFrame, rows: DataFrame, source: str = "source") -> DataFrame:
    """``table`` with every row of the new rows' sources replaced, so a shrunken note leaves no stale chunk."""
    return table.join(rows.select(source).distinct(), source, "left_anti").unionByName(rows)


def not_stored(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in the table: what a resumed run still has to do."""
    return rows.join(table.select(key), key, "left_anti")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order: the limit option of an ingest."""
    return rows.orderBy(*order).limit(n)


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows at random, the same for a seed on every cluster: by md5 of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, so a batch may hold a key more than once."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
