"""A corpus pipeline of five training-data operators; each stage reads what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all of ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm import decontaminate, exact_dedup, language_id, minhash, packing
from lumenrank.llm.common import crc32_mod, materialize

#: SQL can't express profiles, signatures or packing; the stages are tested against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the id and a hash of the text as the id, so that a decision is about one text even where an id is repeated."""
    return docs.select(_key().alias("doc_id"), "text")


def _key() -> Column:
    """A null id comes last, as it never wins against another."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64("text").alias("h"))


def _without(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without the rows decided against, with the columns that they have, whatever their names.

    ``decisions`` has a row (doc_id, keep) for each row of ``docs``, by the ids of ``_keyed``. Texts that are
    dropped for all their rows leave by an anti join, which carries documents through at most one
    shuffle. Of repeated rows (same id and same text) as many stay as were kept, the first by their other columns (as JSON, which any type has).
    """
    per_key = decisions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))
    per_key = materialize(per_key.where("kept < n"), "dropped").select(F.col("doc_id").alias("id"), "kept")
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    rows = docs.select(_key().alias("key"), F.struct(*columns).alias("row"))
    same = F.col("key").eqNullSafe(F.col("id"))
    out = rows.join(per_key.where("kept = 0"), same, "left_anti")
    partly = per_key.where("kept > 0")
    if not partly.isEmpty():
        others = F.struct(*(c for c, name in zip(columns, docs.columns) if name not in ("doc_id", "text")), F.lit(0).alias("none"))
        repeated = docs.select(_key().alias("key"), F.to_json(others).alias("order"), F.struct(*columns).alias("row")).join(partly, same)
        place = F.row_number().over(Window.partitionBy("key").orderBy("order"))
        some = repeated.withColumn("place", place).where(F.col("place") <= F.col("kept")).select("key", "row")
        out = out.join(partly, same, "left_anti").unionByName(some)
    return out.select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language (null text, or no letter in it) go; profiles come from all that are not held out."""
    n, own = language_id.HELD_OUT
    profiles = language_id.learn(docs.where(crc32_mod(F.col("doc_id"), n) != own).select("text", "lang"))
    found = language_id.predict(_keyed(docs), profiles)
    return _without(docs, found.select("doc_id", (F.col("lang_pred") != language_id.UNDETERMINED).alias("keep")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    found = exact_dedup.exact_dedup(_keyed(docs))
    return _without(docs, found.select("doc_id", F.col("kept").alias("keep")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = minhash.near_duplicates(_keyed(docs))
    return _without(docs, found.select("doc_id", F.col("kept").alias("keep")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    found = decontaminate.decontaminate(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id", (~F.col("contaminated")).alias("keep")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
