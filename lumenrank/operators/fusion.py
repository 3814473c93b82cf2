"""Reciprocal rank fusion of arm results, and the batch retriever on top of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.config import Arm, Setting, checked_top_k
from lumenrank.operators.dense import dense_search
from lumenrank.operators.lexical import DIGITS, ranked


def united(arms: dict[str, DataFrame], depths: dict[str, int] | None = None) -> DataFrame:
    """(qid, arm, ordinal, id, rank, score) of arm results (qid, id, score, rank), each cut to its depth."""
    parts = []
    for i, (name, rows) in enumerate(arms.items()):
        if depths and name in depths:
            rows = rows.where(F.col("rank") <= depths[name])
        parts.append(rows.select("qid", F.lit(name).alias("arm"), F.lit(i).alias("ordinal"), "id", "rank", "score"))
    return reduce(DataFrame.unionByName, parts)


def fuse(results: DataFrame, k: int = 60, weights: dict[str, float] | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, score, rank, arms): sum of weight / (k + rank), and each arm's rank.

    An arm without a weight has weight 1; weights of other arms are ignored. ``payload``
    columns come from the first arm that has the row. An id that an arm has twice adds both parts,
    and its last rank is kept. One grouped aggregate does it all.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("arm") == name, F.lit(float(w))).otherwise(weight)
    first = [F.min_by(c, "ordinal").alias(c) for c in payload]
    fused = results.groupBy("qid", "id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_list(F.struct("arm", "rank"))).alias("hits"), *first)
    names = F.array_distinct(F.transform("hits", lambda h: h["arm"]))
    last = F.transform(names, lambda n: F.struct(n, F.array_max(F.transform(F.filter("hits", lambda h: h["arm"] == n), lambda h: h["rank"]))))
    payloads = [c for c in fused.columns if c not in ("qid", "id", "score", "hits")]
    fused = fused.select("qid", "id", "score", F.map_from_entries(last).alias("arms"), *payloads)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


def merge(arms: dict[str, DataFrame], setting: Setting, top_k: int | None = None) -> DataFrame:
    """One ranking from the arms' results, cut to ``top_k`` (the setting's where it is None)."""
    depths = {name: arm.depth for name, arm in setting.arms.items()}
    missing = set(depths) - set(arms)
    if missing:
        raise ValueError(f"no results for arms {sorted(missing)}")
    rows = united({n: arms[n] for n in depths}, depths)
    if setting.k is None:
        out = rows.select("qid", "id", "score", "rank", F.create_map("arm", "rank").alias("arms"))
    else:
        out = fuse(rows, setting.k, dict(setting.weights))
    return out.where(F.col("rank") <= (setting.top_k if top_k is None else checked_top_k(top_k)))


class Retriever:
    """Answers a batch of queries with the arms of a setting.

    ``search`` holds for each arm a function (queries, depth) -> (qid, id, score, rank).
    Arms are branches of one plan, and a sweep over settings reuses them.
    """

    def __init__(self, setting: Setting, search: dict):
        self.setting, self.search = setting, search
        for name in setting.arms:
            if name not in search:
                raise ValueError(f"no index for arm {name!r}")

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        arms = {name: self.search[name](queries, arm.depth) for name, arm in self.setting.arms.items()}
        return merge(arms, self.setting, top_k)


def arm_search(arm: Arm, tables: dict[str, DataFrame], encoders: dict, lexical: dict):
    """The search function (queries, depth) of an arm: over its stored vectors (id, vector), or its lexical index.

    ``encoders``: functions from a text column to vectors, by encoder name; ``lexical``: indexes by table.
    """
    if arm.encoder is None:
        return lexical[arm.table].search
    embed, table = encoders[arm.encoder], tables[arm.table]
    return lambda queries, depth: dense_search(queries.select("qid", embed(F.col("query")).alias("vector")), table, depth)


def default_retriever(setting: Setting, tables: dict[str, DataFrame], encoders: dict, lexical: dict) -> Retriever:
    """A retriever with every arm of the setting built from stored tables: make it once and keep it."""
    return Retriever(setting, {name: arm_search(arm, tables, encoders, lexical) for name, arm in setting.arms.items()})


def sweep(results: DataFrame, settings: list[tuple[str, int, int]]) -> DataFrame:
    """(setting, qid, id, score, rank) for (name, depth, k) settings over one set of deep arm results."""
    parts = []
    for name, depth, k in settings:
        parts.append(fuse(results.where(F.col("rank") <= depth), k).drop("arms").withColumn("setting", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


__all__ = ["DIGITS", "Retriever", "arm_search", "default_retriever", "fuse", "merge", "ranked", "sweep", "united"]
