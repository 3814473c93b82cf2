"""Experiments: many retrieval settings over one set of arm results, scored, queued and ready to be saved.

Every arm is searched once, to the greatest depth that a setting asks for. The settings are a small
table (setting, arm, depth, weight, k) that the results join, so all settings are fused by one
grouped aggregate and ranked by one window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.config import Setting
from lumenrank.operators import pooling, relevance
from lumenrank.operators.fusion import united

#: Means of these are a run's figures.
ANNOTATED = ("ndcg_10", "condensed_ndcg_10", "ndcg_5", "recall_10", "mrr_10", "precision_10", "coverage_10")
GENERATED = ("file_recall", "file_mrr")


def settings_table(spark: SparkSession, settings: Mapping[str, Setting]) -> DataFrame:
    """(setting, arm, depth, weight, k): a row for each arm of each setting."""
    rows = [(name, arm, a.depth, float(s.weights.get(arm, 1.0)), s.k) for name, s in settings.items() for arm, a in s.arms.items()]
    return spark.createDataFrame(rows, "setting string, arm string, depth int, weight double, k int")


def search_arms(settings: Mapping[str, Setting], search: Mapping[str, Callable], queries: DataFrame) -> DataFrame:
    """(qid, arm, ordinal, id, rank, score): each arm once, as deep as any setting needs it."""
    depths: dict[str, int] = {}
    for s in settings.values():
        for name, arm in s.arms.items():
            depths[name] = max(depths.get(name, 0), arm.depth)
    if missing := sorted(set(depths) - set(search)):
        raise ValueError(f"no index for arms {missing}")
    return united({name: search[name](queries, depth) for name, depth in depths.items()})


def fuse_settings(results: DataFrame, settings: Mapping[str, Setting], top_k: int = 10) -> DataFrame:
    """(setting, qid, id, score, rank) of all settings over arm results (qid, arm, id, rank, score)."""
    table = settings_table(results.sparkSession, settings)
    cut = results.join(F.broadcast(table), "arm").where(F.col("rank") <= F.col("depth"))  # settings x arms rows
    part = F.when(F.col("k").isNull(), F.col("score")).otherwise(F.col("weight") / (F.col("k") + F.col("rank")))
    fused = cut.groupBy("setting", "qid", "id").agg(F.round(F.sum(part), 9).alias("score"))
    order = Window.partitionBy("setting", "qid").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


@dataclass
class Experiment:
    """What a run leaves: fused results with gains, one row of metrics for each query, means by split, and what nobody has judged."""

    results: DataFrame
    per_query: DataFrame
    metrics: DataFrame
    unjudged: DataFrame


def run_experiments(
    results: DataFrame, settings: Mapping[str, Setting], asked: DataFrame, gains: DataFrame, by_id: DataFrame, split: DataFrame,
    targets: DataFrame | None = None, sources: DataFrame | None = None, k: int = 10,
) -> Experiment:
    """Score all settings.

    ``asked``: (qid, query_key) of annotated queries; ``gains``: (qid, chunk_key, gain) and ``by_id``: (qid, id,
    chunk_key), their judgments; ``split``: (query_key, split). Generated queries come as ``targets`` (qid,
    query_key, source), with the ``sources`` (id, source) of what is found; without them only annotated queries are scored.
    """
    fused = fuse_settings(results, settings, k)
    judged = fused.join(by_id, ["qid", "id"], "left").join(gains, ["qid", "chunk_key"], "left")
    own = judged.join(asked.select("qid"), "qid", "left_semi")
    per_query = relevance.annotated_metrics(own, gains, k, by=("setting",)).join(asked, "qid").withColumn("kind", F.lit("annotated"))
    if targets is not None:
        names = results.sparkSession.createDataFrame([(n,) for n in settings], "setting string")
        wanted = targets.crossJoin(F.broadcast(names))  # one row for each setting and target
        found = relevance.file_metrics(fused.join(sources, "id"), wanted, k, by=("setting",)).join(targets.select("qid", "query_key"), "qid")
        per_query = per_query.unionByName(found.withColumns({"kind": F.lit("generated"), "num_relevant": F.lit(1).cast("long")}), allowMissingColumns=True)
    else:
        per_query = per_query.withColumns({c: F.lit(None).cast("double") for c in GENERATED})
    per_query = relevance.assigned(per_query, split)
    metrics = relevance.split_means(per_query, [*ANNOTATED, *GENERATED], by=("setting",))
    unjudged = own.where("gain IS NULL").join(asked, "qid").select("setting", "query_key", "id", "rank")
    return Experiment(judged, per_query, metrics, unjudged)


def queued(queue: DataFrame, run: Experiment, keys: DataFrame, judged: DataFrame, run_id: str, now, setting: str) -> DataFrame:
    """The queue of unjudged results after one setting's run; ``keys``: (id, chunk_key) of what is found."""
    found = run.unjudged.where(F.col("setting") == setting).join(keys, "id")
    found = found.select("query_key", F.col("id").cast("string").alias("chunk_id"), "chunk_key", "rank")
    return pooling.merge_queue(queue, found, judged, run_id, now)
