"""The graph index against the exact search: recall, share of distances, depth, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import dense
from lumenrank.operators.graph import GraphIndex, build_graph, shard_search, unit


def recall_and_share(spark, rows, asked, path, depth=10, **options):
    index = GraphIndex.store(rows, path, **options)
    true = dense.dense_search(asked, rows, depth).select("qid", "id")
    found = index.search(asked, depth)
    met = true.join(found.select("qid", "id"), ["qid", "id"]).count() / true.count()
    cost = index.search_cost(asked, depth).agg(F.sum("distances").alias("d"), F.sum("rows").alias("n")).first()
    wrong = found.join(dense.dense_search(asked, rows, 4 * depth).select("qid", "id", F.col("score").alias("exact")), ["qid", "id"]).where("abs(score - exact) > 1e-6").count()
    return met, cost["d"] / cost["n"], wrong


@pytest.mark.parametrize("sf", ["sf0.1", "check_s"])
def test_recall_on_the_embeddings(spark, tmp_path, sf):
    """At least nine of the ten best are found with at most a fifth of the distances."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    met, share, wrong = recall_and_share(spark, rows, asked, str(tmp_path / sf))
    assert met >= 0.9 and share <= 0.2 and wrong == 0


def test_shards_are_merged(spark, tmp_path):
    r = np.random.default_rng(4)
    centre = r.standard_normal((40, 24))
    vectors = [(i, [float(x) for x in centre[i % 40] + 0.4 * r.standard_normal(24)]) for i in range(6000)]
    rows = spark.createDataFrame(vectors, "id long, vector array<double>")
    asked = rows.where("id % 97 = 0").select(F.col("id").alias("qid"), "vector")
    met, share, wrong = recall_and_share(spark, rows, asked, str(tmp_path / "g"), shard_rows=2000)
    assert met >= 0.9 and share <= 0.2 and wrong == 0
    assert GraphIndex(spark, str(tmp_path / "g")).shards == 3


def test_depth_gives_so_many_rows(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(8)]) for i in range(600)], "id long, vector array<double>")
    asked = rows.where("id < 5").select(F.col("id").alias("qid"), "vector")
    index = GraphIndex.store(rows, str(tmp_path / "g"))
    assert {r["n"] for r in index.search(asked, 60).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()} == {60}
    assert {r["n"] for r in index.search(asked, 1000).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()} == {600}


def test_odd_vectors_and_nothing(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", [None, 1.0]), ("h", [1.0, 1.0]), ("h2", [1.0, 1.0])], "id string, vector array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [nan, 0.0])], "qid long, vector array<double>")
    got = GraphIndex.store(rows, str(tmp_path / "g")).search(asked, 5).collect()
    assert sorted((r["qid"], r["id"], r["rank"], r["score"]) for r in got) == [(1, "a", 1, 1.0), (1, "h", 2, 0.707107), (1, "h2", 3, 0.707107)]
    empty = GraphIndex.store(rows.limit(0), str(tmp_path / "e"))
    assert empty.search(asked, 5).count() == 0 and empty.search_cost(asked).count() == 0


def test_an_unreachable_row_is_found_by_the_fallback():
    rows = unit(np.random.default_rng(1).standard_normal((30, 4)))
    adjacency, pivots = build_graph(rows)
    place, cost = shard_search(rows, np.full_like(adjacency, -1), pivots, rows[:3], 20, 24)
    assert (place >= 0).all() and (place[:, 0] == np.arange(3)).all() and (cost > 30).all()


def test_many_queries_need_few_passes(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(50)], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("qid"), "vector")
    one = dense.dense_search(asked, rows, 3, block=7)
    two = dense.dense_search(asked, rows, 3, most_bytes=200)
    key = lambda df: sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))
    assert key(one) == key(two) == key(dense.dense_search(asked, rows, 3))
