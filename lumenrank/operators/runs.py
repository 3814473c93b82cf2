"""Comparing retrieval runs: tables, deltas, ranking differences and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.text import thousandths

EPSILON = 1e-9


def compare_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run_id, block, metric texts): three digits, or a dash where there is no value or no query."""
    cells = [F.when(F.col(m).isNotNull() & (F.col("num_queries") > 0), thousandths(F.col(m))).otherwise("-").alias(m) for m in metrics]
    return runs.select("run_id", "split", "kind", "num_queries", *cells)


def deltas(before: DataFrame, after: DataFrame, metric: str, digits: int = 6) -> DataFrame:
    """(query_key, before, after, delta) where both runs have the metric; of repeated keys before, the last (by seq) counts."""
    old = before.where(F.col(metric).isNotNull()).groupBy("query_key").agg(F.max_by(metric, "seq").alias("before"))
    new = after.where(F.col(metric).isNotNull()).select("query_key", F.col(metric).alias("after"))
    return old.join(new, "query_key").withColumn("delta", F.round(F.col("after") - F.col("before"), digits))


def by_metric(runs: DataFrame, metric: str = "ndcg_10", split: str = "train", kind: str = "annotated") -> DataFrame:
    """(run_id, metric) of one split and kind, the best first; runs without a value last."""
    return runs.where((F.col("split") == split) & (F.col("kind") == kind)).select("run_id", metric).orderBy(F.desc_nulls_last(metric), "run_id")


def diff_report(before: DataFrame, after: DataFrame, metric: str, results_before: DataFrame, results_after: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a comparison of two runs prints: all deltas, what the top ``n`` movers gained and lost, and a summary row.

    ``before`` and ``after``: (query_key, seq, metric); results: (query_key, id, rank).
    """
    changes = deltas(before, after, metric)
    top = movers(changes, n)
    keys = top.select("query_key")
    moved = ranking_diff(results_before.join(keys, "query_key", "left_semi"), results_after.join(keys, "query_key", "left_semi"))
    return changes, moved.where("change <> 'moved'"), delta_summary(changes)


def delta_summary(changes: DataFrame, digits: int = 6) -> DataFrame:
    """One row: mean delta (0 of none), how many changed, how many compared."""
    return changes.agg(
        F.round(F.coalesce(F.avg("delta"), F.lit(0.0)), digits).alias("mean_delta"), F.count_if(F.abs("delta") > EPSILON).alias("changed"), F.count(F.lit(1)).alias("compared")
    )


def movers(changes: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest changes; a report's feature."""
    return changes.where(F.abs("delta") > EPSILON).orderBy(F.desc(F.abs("delta")), "query_key").limit(n)


def ranking_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_key, id, change, rank_before, rank_after): gained, lost or moved rows."""
    a = before.select("query_key", "id", F.col("rank").alias("rank_before"))
    b = after.select("query_key", "id", F.col("rank").alias("rank_after"))
    change = F.when(F.col("rank_before").isNull(), "gained").when(F.col("rank_after").isNull(), "lost").otherwise("moved")
    both = a.join(b, ["query_key", "id"], "full")
    return both.where(~F.col("rank_before").eqNullSafe(F.col("rank_after"))).select("query_key", "id", change.alias("change"), "rank_before", "rank_after")


def positions_text(positives: DataFrame) -> DataFrame:
    """(qid, positions, missed): ranks of found positives in order, then ``miss(n)`` where n were missed."""
    sums = positives.groupBy("qid").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.count_if(F.col("rank").isNull()).alias("missed"))
    found = F.transform("ranks", lambda r: r.cast("string"))
    miss = F.when(F.col("missed") > 0, F.array(F.concat(F.lit("miss("), F.col("missed").cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return sums.select("qid", F.array_join(F.concat(found, miss), ",").alias("positions"), "missed")


def arm_contributions(fused: DataFrame) -> DataFrame:
    """(qid, arm, n): rows that each arm had a part in."""
    return fused.select("qid", F.explode(F.map_keys("arms")).alias("arm")).groupBy("qid", "arm").agg(F.count(F.lit(1)).alias("n"))


def worst(records: DataFrame, metric: str, n: int) -> DataFrame:
    """The ``n`` worst queries, in order of metric and query; a report's feature."""
    return records.orderBy(metric, "query_key").limit(n)


def block_text(num: Column, *values: tuple[str, Column]) -> Column:
    """A line of a run's report."""
    parts = [F.format_string("%s %s", F.lit(n), thousandths(v)) for n, v in values]
    return F.concat_ws("  ", F.format_string("%d queries", num), *parts)


def selftest(judged_sources: DataFrame, pooled: DataFrame, by_id: DataFrame, depth: int = 10) -> DataFrame:
    """(qid, retriever, returned, matched, missing): whether every judgment a retriever gave joins back by id."""
    own = judged_sources.where((F.col("rank") <= depth) & F.col("chunk_id").isNotNull()).select("qid", "retriever", F.col("chunk_id").alias("id")).distinct()
    back = own.join(by_id.select("qid", "id", F.lit(1).alias("known")).distinct(), ["qid", "id"], "left")
    misses = back.groupBy("qid", "retriever").agg(F.count_if(F.col("known").isNull()).alias("missing"))
    seen = pooled.where(F.col("rank") <= depth).join(by_id.select("qid", "id", F.lit(1).alias("known")).distinct(), ["qid", "id"], "left")
    cover = seen.groupBy("qid", "retriever").agg(F.count(F.lit(1)).alias("returned"), F.count("known").alias("matched"))
    return cover.join(misses, ["qid", "retriever"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def last_runs(rows: DataFrame, per: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(order)))).where("n = 1").drop("n")
