"""Reports of runs, statuses and shortened lists."""

from pyspark.sql import functions as F

from lumenrank.functions import text
from lumenrank.operators import chat, runs


def test_runs_by_metric_and_their_lines(spark):
    rows = spark.createDataFrame([("a", "train", "annotated", 0.5, 3), ("b", "train", "annotated", None, 0), ("c", "train", "annotated", 0.75, 3), ("d", "val", "annotated", 0.9, 3)], "run_id string, split string, kind string, ndcg_10 double, n int")
    assert [r["run_id"] for r in runs.by_metric(rows).collect()] == ["c", "a", "b"]
    line = rows.where("run_id = 'c'").select(runs.block_text(F.col("n"), ("ndcg", F.col("ndcg_10")), ("mrr", F.lit(1)))).first()[0]
    assert line == "3 queries  ndcg 0.750  mrr 1.000"
    assert [tuple(r) for r in runs.last_runs(rows.select("split", "ndcg_10"), "split", "ndcg_10").orderBy("split").collect()] == [("train", 0.75), ("val", 0.9)]


def test_diff_report(spark):
    metric = "query_key string, seq int, ndcg_10 double"
    before = spark.createDataFrame([("p", 1, 0.2), ("p", 2, 0.5), ("q", 1, 0.5), ("r", 1, 0.1)], metric)
    after = spark.createDataFrame([("p", 1, 0.9), ("q", 1, 0.5), ("s", 1, 1.0)], metric)
    found = "query_key string, id string, rank int"
    old, new = spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("q", "z", 1)], found), spark.createDataFrame([("p", "y", 1), ("p", "w", 2), ("q", "v", 1)], found)
    changes, moved, summary = runs.diff_report(before, after, "ndcg_10", old, new, 1)
    assert sorted(map(tuple, changes.collect())) == [("p", 0.5, 0.9, 0.4), ("q", 0.5, 0.5, 0.0)]
    assert sorted(map(tuple, moved.collect())) == [("p", "w", "gained", None, 2), ("p", "x", "lost", 1, None)]
    assert tuple(summary.first()) == (0.2, 1, 2)


def test_statuses(spark):
    events = spark.createDataFrame([(1, 1, "text"), (1, 2, "done"), (2, 1, "done"), (2, 2, "error"), (3, 1, "tool_call")], "conv_id int, seq int, type string")
    assert sorted(map(tuple, chat.message_status(events).collect())) == [(1, "done"), (2, "error"), (3, "streaming")]


def test_shortened_items_and_query_prompt(spark):
    rows = spark.createDataFrame([([{"text": "abcdef", "n": 1}, {"text": "ab", "n": 2}, {"text": None, "n": 3}],)], "items array<struct<text:string,n:int>>")
    items, prompt = rows.select(text.shortened_items(F.col("items"), 3), text.query_prompt(F.lit("who?"))).first()
    assert [tuple(i) for i in items] == [("abc… [3 more characters]", 1), ("ab", 2), (None, 3)] and prompt == "task: search result | query: who?"


def test_three_digits_are_those_of_printf(spark):
    values = [1.0005, 2.0005, 3.0015, 7.6545, 8.1235, 16.7245, 0.0625, 0.1875, 1.0625, 0.9995, 0.9996, 9.9999, 0.0, -0.0, -1.0005, -2.6545, 1e-9, 5e-324, 123456789.0005, 4503599627370495.5, 12.0]
    values += [n / 2000 for n in range(1, 40_000, 2)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.thousandths(F.col("x")).alias("t")).collect()
    assert [(r["x"], r["t"]) for r in got if r["t"] != f"{r['x']:.3f}"] == []


def test_lines_of_search_and_runs_round_as_their_sql(spark):
    rows = spark.createDataFrame([("a", "train", "annotated", 1.0005, 3)], "run_id string, split string, kind string, m double, num_queries long")
    assert runs.compare_table(rows, ["m"]).first()["m"] == "1.000"
    assert rows.select(runs.block_text(F.col("num_queries"), ("m", F.col("m")))).first()[0] == "3 queries  m 1.000"
