"""Graded relevance: judgments, per-query metrics, splits and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.text import collapse


def gain(score: Column, scheme: str = "exponential") -> Column:
    """2^score - 1, or the score itself."""
    if scheme not in ("exponential", "linear"):
        raise ValueError(f"unknown gain scheme {scheme!r}")
    return (F.pow(F.lit(2.0), score) - 1).cast("int") if scheme == "exponential" else score.cast("int")


def text_key(text: Column) -> Column:
    """Null where there is no text to hash."""
    return F.when(F.length(text) > 0, F.substring(F.sha2(collapse(text), 256), 1, 16))


def with_gains(results: DataFrame, by_id: DataFrame, gains: DataFrame) -> DataFrame:
    """Results (qid, id, rank, text) with chunk_key and gain: a judged id wins over the text's key; null is unjudged.

    ``by_id``: (qid, id, chunk_key); ``gains``: (qid, chunk_key, gain).
    """
    keyed = results.join(by_id.select("qid", "id", F.col("chunk_key").alias("id_key")), ["qid", "id"], "left")
    own = keyed.withColumn("chunk_key", F.coalesce("id_key", text_key(F.col("text")))).drop("id_key")
    return own.join(gains, ["qid", "chunk_key"], "left")


def dcg(gains: Column, rank: Column) -> Column:
    """An aggregate: sum of gain / log2(rank + 1), null gains as none."""
    return F.sum(F.coalesce(gains, F.lit(0)) / F.log2(rank + 1))


def ideal(gains: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(qid, num_relevant, ideal_k...) from all judged positives."""
    order = Window.partitionBy("qid").orderBy(F.desc("gain"), "chunk_key")
    ranks = gains.where("gain > 0").withColumn("r", F.row_number().over(order))
    return ranks.groupBy("qid").agg(
        F.count(F.lit(1)).alias("num_relevant"), *(F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias(f"ideal_{k}") for k in ks)
    )


def annotated_metrics(judged: DataFrame, gains: DataFrame, k: int = 10, small: int = 5, digits: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per query of ``judged`` (qid, rank, gain): ndcg, condensed ndcg, recall, mrr, precision, coverage.

    With ``by``, columns such as the setting, one row for each of their values and query.

    Unjudged rows count as not relevant, but not in the condensed ndcg, where they are left
    out and the ranks close up. Precision divides by k even when fewer rows came back.
    """
    rows = judged.where(F.col("rank") <= k)
    close = F.row_number().over(Window.partitionBy(*by, "qid").orderBy(F.col("gain").isNull().cast("int"), "rank"))
    rows = rows.withColumn("closed", F.when(F.col("gain").isNotNull(), close))
    hit = F.col("gain") > 0
    sums = rows.groupBy(*by, "qid").agg(
        dcg(F.col("gain"), F.col("rank")).alias("dcg"), F.sum(F.when(F.col("rank") <= small, F.coalesce("gain", F.lit(0)) / F.log2(F.col("rank") + 1))).alias("dcg_small"),
        F.coalesce(F.sum(F.col("gain") / F.log2(F.col("closed") + 1)), F.lit(0.0)).alias("dcg_closed"), F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.count("gain").alias("judged"), F.count(F.lit(1)).alias("returned"),
    )
    both = sums.join(ideal(gains, (k, small)), "qid", "left").withColumn("num_relevant", F.coalesce("num_relevant", F.lit(0)))

    def over(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)), digits)

    return both.select(
        *by, "qid", "num_relevant", over(F.col("dcg"), F.col(f"ideal_{k}")).alias(f"ndcg_{k}"), over(F.col("dcg_closed"), F.col(f"ideal_{k}")).alias(f"condensed_ndcg_{k}"),
        over(F.col("dcg_small"), F.col(f"ideal_{small}")).alias(f"ndcg_{small}"), over(F.col("hits"), F.col("num_relevant")).alias(f"recall_{k}"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias(f"mrr_{k}"), F.round(F.col("hits") / k, digits).alias(f"precision_{k}"),
        over(F.col("judged"), F.col("returned")).alias(f"coverage_{k}"),
    )


def positives_with_rank(judged: DataFrame, gains: DataFrame, by_id: DataFrame) -> DataFrame:
    """(qid, chunk_key, id, gain, rank) of each judged positive; rank is null where it was missed."""
    found = judged.groupBy("qid", "chunk_key").agg(F.min("rank").alias("rank"))
    ids = by_id.groupBy("qid", "chunk_key").agg(F.min("id").alias("id"))
    return gains.where("gain > 0").join(ids, ["qid", "chunk_key"], "left").join(found, ["qid", "chunk_key"], "left").select("qid", "chunk_key", "id", "gain", "rank")


def file_metrics(results: DataFrame, targets: DataFrame, k: int = 10, digits: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, qid, file_recall, file_mrr) for targets (qid, source): whether, and how high, the source came back.

    ``targets`` has the ``by`` columns too.
    """
    hits = results.where(F.col("rank") <= k).join(targets.select(*by, "qid", F.col("source").alias("target")), [*by, "qid"])
    first = hits.where(F.col("source") == F.col("target")).groupBy(*by, "qid").agg(F.min("rank").alias("first"))
    all_ = targets.select(*by, "qid").distinct().join(first, [*by, "qid"], "left")
    return all_.select(*by, "qid", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("file_recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("file_mrr"))


def split_keys(keys: DataFrame, seed: int = 17, share: float = 0.7) -> DataFrame:
    """(query_key, stratum, split) of keys (query_key, stratum, ordinal): a stable shuffle cut in each stratum.

    The order is that of md5(seed:key); the cut is rounded half to even; a key in
    several strata belongs to the first.
    """
    own = keys.groupBy("query_key").agg(F.min(F.struct("ordinal", "stratum"))["stratum"].alias("stratum"))
    # Few strata may hold many keys: a key's place is what the hash ranges before its own hold, and its place in that.
    own = own.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "query_key"))).withColumn("range", F.substring("h", 1, 3))
    counts = own.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("stratum")
    before = F.coalesce(F.sum("c").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("stratum", "range", before.alias("base"), F.sum("c").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("h", "query_key"))
    cut = own.withColumn("i", within).join(places, ["stratum", "range"]).withColumn("r", F.col("base") + F.col("i"))
    return cut.select("query_key", "stratum", F.when(F.col("r") <= F.bround(F.col("n") * share), "train").otherwise("val").alias("split"))


def assigned(records: DataFrame, split: DataFrame) -> DataFrame:
    """Records (query_key, ...) with their split; training wins, and the rest is unassigned."""
    one = split.groupBy("query_key").agg(F.min("split").alias("split"))  # train sorts before val
    return records.join(one, "query_key", "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def split_means(records: DataFrame, metrics: list[str], digits: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, split, kind, num_queries, num_scored, means...) over train and val.

    Annotated queries without any relevant item count but are not scored; 0 is the mean of nothing.
    """
    scored = (F.col("kind") != "annotated") | (F.col("num_relevant") > 0)
    means = [F.round(F.coalesce(F.avg(F.when(scored, F.col(m))), F.lit(0.0)), digits).alias(m) for m in metrics]
    return records.where(F.col("split").isin("train", "val")).groupBy(*by, "split", "kind").agg(F.count(F.lit(1)).alias("num_queries"), F.count_if(scored).alias("num_scored"), *means)
