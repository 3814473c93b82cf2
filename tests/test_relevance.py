import math

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import pooling, relevance, runs


def test_metrics_of_a_judged_list(spark):
    judged = spark.createDataFrame([(1, 1, 3), (1, 2, None), (1, 3, 1)], "qid int, rank int, gain int")
    gains = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 3), (1, "d", 0)], "qid int, chunk_key string, gain int")
    got = relevance.annotated_metrics(judged, gains).first()
    ideal = 3 + 3 / math.log2(3) + 0.5
    assert got["ndcg_10"] == pytest.approx((3 + 0.5) / ideal, abs=1e-6)
    assert got["condensed_ndcg_10"] == pytest.approx((3 + 1 / math.log2(3)) / ideal, abs=1e-6)
    assert (got["recall_10"], got["precision_10"], got["mrr_10"], got["coverage_10"]) == (pytest.approx(2 / 3, abs=1e-6), 0.2, 1.0, pytest.approx(2 / 3, abs=1e-6))


def test_nothing_relevant_scores_zero(spark):
    judged = spark.createDataFrame([(1, 1, None)], "qid int, rank int, gain int")
    got = relevance.annotated_metrics(judged, spark.createDataFrame([], "qid int, chunk_key string, gain int")).first()
    assert got["ndcg_10"] == got["recall_10"] == got["mrr_10"] == 0


def test_id_wins_over_text(spark):
    from pyspark.sql import Row

    key = spark.range(1).select(relevance.text_key(F.lit("b  text"))).first()[0]
    rows = spark.createDataFrame([Row(qid=1, id=i, rank=n, text=t) for n, (i, t) in enumerate([("a#0", "b text"), ("x#0", "b text"), ("x#1", "other"), ("x#2", "")], 1)])
    by_id = spark.createDataFrame([(1, "a#0", "ka")], "qid long, id string, chunk_key string")
    gains = spark.createDataFrame([(1, "ka", 3), (1, key, 1)], "qid long, chunk_key string, gain int")
    assert [r["gain"] for r in relevance.with_gains(rows, by_id, gains).orderBy("rank").collect()] == [3, 1, None, None]


def test_positives_keep_missed_ones(spark):
    judged = spark.createDataFrame([(1, 2, "a", 3)], "qid int, rank int, chunk_key string, gain int")
    gains = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 0)], "qid int, chunk_key string, gain int")
    ids = spark.createDataFrame([(1, "a#1", "a"), (1, "a#0", "a")], "qid int, id string, chunk_key string")
    got = relevance.positives_with_rank(judged, gains, ids)
    assert sorted((r["chunk_key"], r["id"], r["rank"]) for r in got.collect()) == [("a", "a#0", 2), ("b", None, None)]
    assert [tuple(r) for r in runs.positions_text(got).collect()] == [(1, "2,miss(1)", 1)]


def test_split_is_stable_and_proportional(spark):
    keys = spark.createDataFrame([(f"a{i}", "annotated", 0) for i in range(20)] + [(f"g{i}", "generated", 1) for i in range(100)] + [("a0", "generated", 1)], "query_key string, stratum string, ordinal int")
    one = {r["query_key"]: r["split"] for r in relevance.split_keys(keys).collect()}
    assert one == {r["query_key"]: r["split"] for r in relevance.split_keys(keys.repartition(3)).collect()}
    assert len(one) == 120 and sum(s == "train" for k, s in one.items() if k[0] == "a") == 14 and sum(s == "train" for s in one.values()) == 84
    assert relevance.assigned(spark.createDataFrame([("zz",)], "query_key string"), relevance.split_keys(keys)).first()["split"] == "unassigned"


def test_ranking_diff_and_deltas(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_key int, id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_key int, id string, rank int")
    assert sorted(tuple(r)[1:] for r in runs.ranking_diff(a, b).collect()) == [("a", "lost", 1, None), ("b", "moved", 2, 1), ("c", "gained", None, 2)]
    before = spark.createDataFrame([("q", 0.1, 0), ("q", 0.5, 1), ("r", None, 0)], "query_key string, m double, seq int")
    changes = runs.deltas(before, spark.createDataFrame([("q", 0.25), ("r", 1.0)], "query_key string, m double"), "m")
    assert [tuple(r) for r in changes.collect()] == [("q", 0.5, 0.25, -0.25)]
    assert tuple(runs.delta_summary(changes).first()) == (-0.25, 1, 1)


def test_compare_dash(spark):
    rows = spark.createDataFrame([("r", "train", "a", 0, 0.5), ("s", "train", "a", 2, None), ("t", "val", "a", 1, 0.12345)], "run_id string, split string, kind string, num_queries int, m double")
    assert [r["m"] for r in runs.compare_table(rows, ["m"]).orderBy("run_id").collect()] == ["-", "-", "0.123"]


def test_foreign_rows(spark):
    raw = ['{"doc_id": 7, "content": "x", "similarity": 0.5, "source": "s"}', '{"chunk_id": "a", "chunk": 3, "score": "n", "doc_metadata": {"source": "m"}, "source": "s"}', "{}"]
    got = pooling.normalise_rows(spark.createDataFrame([(r,) for r in raw], "row string")).collect()
    assert [(r["chunk_id"], r["text"], r["score"], r["metadata"]) for r in got] == [("7", "x", 0.5, {"source": "s"}), ("a", None, None, {"source": "m"}), (None, None, None, {})]


def test_pool_judgments_and_queue(spark):
    rows = spark.createDataFrame([("q", "r1", 0, "1", "t  x", 3, 0.1), ("q", "r2", 1, "9", "t x", 1, 0.2)], "query_key string, retriever string, ordinal int, chunk_id string, text string, rank int, score double")
    got = pooling.pool(rows).first()
    assert got["text"] == "t  x" and got["best_rank"] == 1 and len(got["sources"]) == 2 and got["grade"] is None
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    store = spark.createDataFrame([("q", "k", 1, "t")], "query_key string, chunk_key string, score int, text string").withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    new = spark.createDataFrame([("q", "k", 2, "t"), ("q", "l", 0, "u")], "query_key string, chunk_key string, score int, text string")
    out = {r["chunk_key"]: r for r in pooling.upsert_judgments(store, new, now).collect()}
    assert out["k"]["score"] == 2 and out["k"]["created_at"].day == 1 and out["k"]["updated_at"].day == 2 and out["l"]["created_at"].day == 2
    with pytest.raises(Exception, match="grade out of range"):
        pooling.checked_grades(new.withColumn("score", F.lit(5))).collect()
    queue = spark.createDataFrame([("q", "c1", "k1", 5, ["r0"], None), ("q", "c2", "k2", 2, ["r0"], None)], "query_key string, chunk_id string, chunk_key string, best_rank int, runs array<string>, first_seen_at timestamp")
    found = spark.createDataFrame([("q", "c1", "k1", 3), ("q", "c3", "k3", 1)], "query_key string, chunk_id string, chunk_key string, rank int")
    judged = spark.createDataFrame([("q", "k2")], "query_key string, chunk_key string")
    merged = {r["chunk_id"]: (r["best_rank"], r["runs"]) for r in pooling.merge_queue(queue, found, judged, "r1", now).collect()}
    assert merged == {"c1": (3, ["r0", "r1"]), "c3": (1, ["r1"])}
