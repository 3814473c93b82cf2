"""Calls of an outside service for many rows, any of which may fail: a failed call is a row with its error, never a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.sources.stores import tolerant_table

#: What a call left: its answer or its last error, and how often it was tried.
RESULT = "struct<answer:string,error:string,tries:int>"
GENERATED = "queries array<struct<query:string,passage:string,type:string>>"


class Refused(Exception):
    """Raised by a service for an input that it will never answer; such a call is not tried again."""


def attempt(call: Callable[[str], str], text: str, tries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(answer, error, tries) of one input; between tries the pause doubles, from ``wait`` seconds."""
    for n in range(1, tries + 1):
        try:
            return str(call(text)), None, n
        except Refused as e:
            return None, f"Refused: {e}", n
        except Exception as e:  # whatever a service raises is that row's result
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            time.sleep(wait * 2 ** (n - 1))
    return None, error, tries


def called(text: Column, service: Callable[[], Callable[[str], str]], at_once: int = 4, tries: int = 3, wait: float = 0.5) -> Column:
    """The result of calling a service on each text: ``RESULT``; null for a null text, which is not sent.

    ``service()`` makes the call once in each task. Each task has at most ``at_once`` calls under way, so the
    number of tasks that run together bounds the whole. An executor that is lost has its calls made again.
    """
    if at_once < 1 or tries < 1 or wait < 0:
        raise ValueError("at_once and tries are at least 1, wait is at least 0")

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = service()
        with ThreadPoolExecutor(at_once) as pool:
            for s in batches:
                rows = pool.map(lambda t: (None, None, 0) if t is None else attempt(call, t, tries, wait), s)
                yield pd.DataFrame(list(rows), columns=["answer", "error", "tries"]).astype({"tries": "int32"})

    result = run.asNondeterministic()(text)  # never copied to a second place in a plan
    return F.when(text.isNotNull(), result)


def call_all(rows: DataFrame, path: str, service: Callable[[], Callable[[str], str]], key: str = "id", text: str = "text", parts: int = 8, **options) -> DataFrame:
    """(key, answer, error, tries): the last result of each key of ``rows``, kept at ``path``.

    Keys that have an answer there are left out, so that a run that broke off, or one after failures, does
    what is left. Work is saved in ``parts`` slices by a hash of the key: a crash loses the slice under way at most. Of
    rows with equal keys the one with the smallest text is sent, a null key like any other; rows with null text have neither answer nor error.
    """
    spark = rows.sparkSession
    schema = f"key {rows.schema[key].dataType.simpleString()}, answer string, error string, tries int, at timestamp"
    for part in range(parts):
        done = tolerant_table(spark, path, schema).where("answer IS NOT NULL").select(F.col("key").alias("done"))
        own = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        left = own.groupBy("key").agg(F.min("text").alias("text")).join(done, F.col("key").eqNullSafe(F.col("done")), "left_anti")
        results = left.withColumn("r", called(F.col("text"), service, **options))
        results.select("key", "r.answer", "r.error", F.coalesce("r.tries", F.lit(0)).alias("tries"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)
    saved = tolerant_table(spark, path, schema)
    last = saved.groupBy("key").agg(F.max_by(F.struct("answer", "error", "tries"), F.struct(F.col("answer").isNotNull(), F.col("at"))).alias("r"))
    asked = rows.select(F.col(key).alias("asked")).distinct()
    return last.join(asked, F.col("key").eqNullSafe(F.col("asked")), "left_semi").select(F.col("key").alias(key), "r.*")


def generated_queries(results: DataFrame, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """Of results whose answers are JSON objects with ``queries``: the queries (source_file, query, passage, type), and the failures (source_file, error), unreadable answers among them."""
    read = results.select(F.col(key).alias("source_file"), "error", "answer", F.from_json("answer", GENERATED)["queries"].alias("queries"))
    made = read.select("source_file", F.explode("queries").alias("q")).select("source_file", "q.query", "q.passage", "q.type").where("query IS NOT NULL")
    unread = F.when(F.col("answer").isNotNull() & F.col("queries").isNull(), "unreadable answer")
    failed = read.select("source_file", F.coalesce("error", unread).alias("error")).where("error IS NOT NULL")
    return made, failed
