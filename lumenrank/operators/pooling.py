"""Judgment pool: foreign rows to one shape, pooling by text, judgments, and the queue of unjudged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.text import chunk_key
from lumenrank.operators.keyed import once

# Names under which retrievers return the same thing, the first present wins.
ID_FIELDS = ("chunk_id", "doc_id", "id")
TEXT_FIELDS = ("text", "chunk", "content")
SCORE_FIELDS = ("score", "similarity")
METADATA_FIELDS = ("metadata", "doc_metadata")
GRADES = (0, 1, 2)


def _present(row: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that is there and not null, as a variant."""
    parsed = F.try_parse_json(row)
    found = (F.try_variant_get(parsed, f"$.{n}", "variant") for n in names)
    return F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in found))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def normalise_rows(rows: DataFrame, column: str = "row") -> DataFrame:
    """Retriever rows as JSON text to chunk_id, text, score, metadata.

    Of several names the first that is not null counts. Ids become text; text that is no string and
    scores that are no numbers (a string of digits is none) become null; metadata that is no object becomes
    empty; a ``source`` that is a string joins the metadata unless it is there already.
    """
    row = F.col(column)
    ids, texts, scores, metas, source = (_present(row, n) for n in (ID_FIELDS, TEXT_FIELDS, SCORE_FIELDS, METADATA_FIELDS, ("source",)))
    number = _kind(scores).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")
    meta = F.when(_kind(metas) == "OBJECT", F.from_json(F.to_json(metas), "map<string,string>"))
    meta = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    named = F.when(_kind(source) == "STRING", F.try_variant_get(source, "$", "string"))
    with_source = F.when(named.isNotNull() & ~F.map_contains_key(meta, "source"), F.map_concat(meta, F.create_map(F.lit("source"), named))).otherwise(meta)
    return rows.withColumns(
        {
            "chunk_id": F.try_variant_get(ids, "$", "string"),
            "text": F.when(_kind(texts) == "STRING", F.try_variant_get(texts, "$", "string")),
            "score": F.when(number, F.try_variant_get(scores, "$", "double")),
            "metadata": with_source,
        }
    )


def pool(results: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """(query_key, chunk_key, text, best_rank, sources, score): results of all retrievers by text identity.

    ``results``: (query_key, retriever, ordinal, chunk_id, text, rank, score). The first
    retriever's text stays; ``judgments`` (query_key, chunk_key, score) add the grade. Order
    by best rank, then key.
    """
    keyed = results.withColumn("chunk_key", chunk_key(F.col("text"), F.col("retriever"), F.col("chunk_id")))
    order = F.struct("ordinal", "rank")
    source = F.struct("ordinal", "rank", "retriever", "chunk_id", "score")
    out = keyed.groupBy("query_key", "chunk_key").agg(F.min_by("text", order).alias("text"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_list(source)).alias("sources"))
    if judgments is None:
        return out.withColumn("grade", F.lit(None).cast("int"))
    return out.join(judgments.select("query_key", "chunk_key", F.col("score").alias("grade")), ["query_key", "chunk_key"], "left")


def checked_grades(judgments: DataFrame) -> DataFrame:
    """The same rows; a grade other than 0, 1 or 2 fails the job."""
    bad = F.raise_error(F.format_string("grade out of range: %s", F.col("score").cast("string")))
    return judgments.withColumn("score", F.when(F.col("score").isin(*GRADES), F.col("score")).otherwise(bad))


def upsert_judgments(store: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The store with new judgments: all is replaced but created_at; updated_at is ``now``.

    Both have (query_key, chunk_key, score, text); the store also created_at and updated_at. A key that
    is judged twice in ``new`` fails the job.
    """
    keys = ["query_key", "chunk_key"]
    new = once(new, keys)
    fresh = new.join(store.select(*keys, "created_at"), keys, "left")
    fresh = fresh.select(*keys, "score", "text", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))
    return store.join(new.select(*keys), keys, "left_anti").select(fresh.columns).unionByName(fresh)


def merge_queue(queue: DataFrame, found: DataFrame, judged: DataFrame, run_id: str, now: Column) -> DataFrame:
    """The queue of unjudged results after a run.

    ``queue``: (query_key, chunk_id, chunk_key, best_rank, runs, first_seen_at); ``found``: (query_key,
    chunk_id, chunk_key, rank); ``judged``: (query_key, chunk_key). Judged rows leave, new ones enter,
    the best rank and the runs of known ones grow.
    """
    keys = ["query_key", "chunk_id"]
    fresh = found.groupBy(*keys).agg(F.min_by("chunk_key", "rank").alias("new_key"), F.min("rank").alias("new_rank"))
    both = queue.join(fresh, keys, "full").withColumn("chunk_key", F.coalesce("chunk_key", "new_key"))
    runs = F.coalesce("runs", F.array().cast("array<string>"))
    out = both.select(
        *keys, "chunk_key", F.least("best_rank", "new_rank").alias("best_rank"),
        F.when(F.col("new_rank").isNotNull(), F.array_union(runs, F.array(F.lit(run_id)))).otherwise(runs).alias("runs"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
    )
    return out.join(judged.select("query_key", "chunk_key").distinct(), ["query_key", "chunk_key"], "left_anti").select(*keys, "chunk_key", "best_rank", "runs", "first_seen_at")
