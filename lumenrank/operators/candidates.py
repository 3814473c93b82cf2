"""Candidates for the labelling pool from named sources: stored vectors, lexical indexes and canned rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.config import Arm, checked_top_k, pool_sources
from lumenrank.operators.fusion import arm_search
from lumenrank.operators.pooling import normalise_rows
from lumenrank.session import stored
from lumenrank.sources.stores import static_results


def _rows(name: str, ordinal: int, spec: Mapping, queries: DataFrame, top_k: int, tables: dict[str, DataFrame], encoders: dict, lexical: dict) -> DataFrame:
    kind = spec["type"]
    if kind == "remote":
        raise ValueError(f"source {name!r}: read remote results into a file and name that as a static source")
    if kind == "static":
        rows = normalise_rows(static_results(queries.sparkSession, spec["chunks_file"], queries, top_k))
        found = rows.select("qid", "chunk_id", "text", "rank", "score")
    else:
        arm = Arm(spec["table"], spec.get("embedder") if kind == "pgvector" else None).checked(name)
        hits = arm_search(arm, tables, encoders, lexical)(queries, top_k)
        found = hits.join(tables[arm.table].select("id", "text"), "id").select("qid", F.col("id").cast("string").alias("chunk_id"), "text", "rank", "score")
    return found.select(F.col("qid").alias("query_key"), F.lit(name).alias("retriever"), F.lit(ordinal).alias("ordinal"), "chunk_id", "text", "rank", "score")


def candidates(specs: list[Mapping], queries: DataFrame, top_k: int, tables: dict[str, DataFrame], encoders: dict, lexical: dict) -> DataFrame:
    """(query_key, retriever, ordinal, chunk_id, text, rank, score) of all sources, as ``pooling.pool`` takes them.

    ``specs`` are checked by ``config.pool_sources``; ``queries``: (qid, query). ``tables`` holds chunk tables (id, text
    and, for vectors, vector) by name, ``encoders`` functions from a text column to vectors, ``lexical`` indexes
    by table. A remote source has to be read into a table or a file of rows first.
    """
    checked_top_k(top_k)
    sources = enumerate(pool_sources(specs).items())
    return reduce(DataFrame.unionByName, [_rows(name, i, spec, queries, top_k, tables, encoders, lexical) for i, (name, spec) in sources])


def gathered(specs: list[Mapping], queries: DataFrame, top_k: int, tables: dict[str, DataFrame], encoders: dict, lexical: dict) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``candidates`` from the sources that work, and the error of each that doesn't, by name.

    Each source is searched and its rows are written by a job of its own, so that an error while it runs
    is that source's alone. Wrong specs are an error before any search; so is that no source works.
    """
    checked_top_k(top_k)
    parts, errors = [], {}
    for i, (name, spec) in enumerate(pool_sources(specs).items()):
        try:
            parts.append(stored(_rows(name, i, spec, queries, top_k, tables, encoders, lexical), "source"))
        except Exception as e:  # a source's error is recorded, whatever it is
            errors[name] = f"{type(e).__name__}: {e}"
    if not parts:
        raise RuntimeError(f"no source works: {errors}")
    return reduce(DataFrame.unionByName, parts), errors
