import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenrank.functions import vectors
from lumenrank.operators import experiments, keyed
from lumenrank.config import Arm, Setting
from lumenrank.operators.lexical import LexicalIndex
from lumenrank.sources.tables import KEPT, KeyedTable

from lumenrank.sources import notes, stores
from lumenrank.streaming import ingest


def test_scan_and_chunk(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / f"My note {'ab' * 16}.md").write_text("Hello\r\n\r\nworld")
    (tmp_path / "x.MD").write_text("no")
    (tmp_path / "empty.txt").write_text(" ​ ")
    rows = notes.scan_files(spark, str(tmp_path))
    assert {r["source"] for r in rows.collect()} == {f"sub dir/My note {'ab' * 16}.md", "empty.txt"}
    got = notes.to_chunks(rows).collect()
    assert [(r["title"], r["text"], r["id"][-2:]) for r in got] == [("My note", "Hello\n\nworld", "#0")]


def test_judgments_split_and_queue(spark, tmp_path):
    store = {"version": 1, "queries": {"q": {"query_text": "Q", "annotations": {"k": {"score": 2, "text": "t", "sources": [{"retriever": "r", "chunk_id": "c", "rank": 1}, {"retriever": "s", "chunk_id": None, "rank": 2}]}}}}}
    (tmp_path / "j.json").write_text(json.dumps(store))
    gains, ids = stores.qrels(stores.read_judgments(spark, str(tmp_path / "j.json")))
    assert [tuple(r) for r in gains.collect()] == [("q", "k", 3)] and [tuple(r) for r in ids.collect()] == [("q", "c", "k")]
    split = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "val")], "query_key string, split string")
    stores.write_split(split, str(tmp_path / "s"), 17)
    assert sorted(map(tuple, stores.read_split(spark, str(tmp_path / "s")).collect())) == [("a", "train"), ("b", "train"), ("c", "val")]
    with pytest.raises(Exception, match="(?i)exists"):
        stores.write_split(split, str(tmp_path / "s"), 17)
    assert stores.read_queue(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"query": "x", "source_file": "notes/a.md", "passage": "p"}]}))
    assert tuple(stores.read_generated(spark, str(tmp_path / "g.json"), "notes/").first())[:2] == ("x", "a.md")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "id long, seq long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.keyed_ingest(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r["id"], r["v"]) for r in KeyedTable(spark, str(tmp_path / "table")).read().collect()) == [(1, "new"), (2, "only")]
    chunks = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "stop"), (2, 1, "x", None)], "turn_id long, seq long, content string, finish_reason string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    turns = ingest.fold_turns(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks")))
    q = turns.writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("turns").collect()] == [(1, "ab", "stop")]


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_keyed_table_commits_whole_changes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read() is None
    assert table.upsert(spark.createDataFrame([(i, "a") for i in range(20)], "id long, v string")) == 20
    before = {b: d for b, d in table.state()[1]["buckets"].items()}
    assert table.upsert(spark.createDataFrame([(3, "b"), (99, "b")], "id long, v string")) == 2
    after = table.state()[1]["buckets"]
    assert pairs(table.read()) == sorted([(i, "b" if i == 3 else "a") for i in range(20)] + [(99, "b")])
    assert sum(before.get(b) != d for b, d in after.items()) <= 2  # other buckets are not written again
    # A change that fails leaves the table as it was.
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string")
    with pytest.raises(Exception, match="key twice"):
        table.upsert(bad)
    assert table.read().count() == 21
    for i in range(KEPT + 2):
        table.upsert(spark.createDataFrame([(i, f"n{i}")], "id long, v string"))
    assert len(list((tmp_path / "t").glob("manifest-*.json"))) == KEPT and table.read().count() == 21
    # Of two writers from one state the second fails, and nothing is lost.
    number, manifest = table.state()
    table._commit(number, manifest)
    with pytest.raises(RuntimeError):
        table._commit(number, manifest)
    assert table.read().count() == 21


def test_sync_counts_and_deletes_nothing(spark):
    old = spark.createDataFrame([(1, "o"), (9, "o")], "id int, v string")
    synced, affected = keyed.sync(old, spark.createDataFrame([(1, "n", 0), (2, "n", 0)], "id int, v string, extra int"))
    assert pairs(synced) == [(1, "n"), (2, "n"), (9, "o")] and affected.first()[0] == 2


def test_ingest_job(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}.md", f"T{i}", f"text number {i}") for i in range(6)], "source string, title string, text string")
    folder = str(tmp_path)
    assert ingest.ingest_notes(rows, folder, "qwen", vectors.embed, limit=4) == 4
    assert ingest.ingest_notes(rows, folder, "qwen", vectors.embed, skip_existing=True) == 2
    assert ingest.ingest_notes(rows, folder, "qwen", vectors.embed, title_prefix=True) == 6
    plain, with_title = (KeyedTable(spark, f"{folder}/{t}").read() for t in ("chunks_qwen", "chunks_qwen_title"))
    assert plain.count() == with_title.count() == 6
    both = plain.join(with_title.select("id", F.col("vector").alias("other"), F.col("text").alias("text2")), "id")
    assert both.where("vector <> other AND text = text2").count() == 6


def test_stored_index_answers_like_a_fresh_one(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "zebra" if i % 7 == 0 else "", f"common word{i % 5} text{i}") for i in range(60)], "id string, title string, text string")
    fresh = LexicalIndex.build(docs)
    fresh.save(str(tmp_path / "i"), buckets=3)
    kept = LexicalIndex.open(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "zebra common"), (2, "word3 text8 nothing"), (3, "common")], "qid int, query string")
    assert pairs(kept.search(asked, 5)) == pairs(fresh.search(asked, 5)) and kept.search(asked, 5).count() > 8
    at_once = LexicalIndex.store(docs, str(tmp_path / "j"), buckets=3)
    assert pairs(at_once.search(asked, 5)) == pairs(fresh.search(asked, 5)) and len(list((tmp_path / "j" / "postings").glob("part-*.parquet"))) == 3
    one = kept.search(spark.createDataFrame([(1, "zebra")], "qid int, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,zebra)" in one or "In(term" in one
    plan = kept.search(asked, 5)._jdf.queryExecution().executedPlan().toString()
    sums = plan[plan.index("functions=[sum(", plan.index("WindowGroupLimit")) :].split("BroadcastHashJoin")[0]
    assert "Exchange hashpartitioning(qid" not in sums  # documents are summed up where they lie


def test_experiments_score_queue_and_save(spark, tmp_path):
    def arm(order):
        rows = [(q, i, 1.0 / r, r) for q in (1, 2) for r, i in enumerate(order, 1)]
        table = spark.createDataFrame(rows, "qid int, id string, score double, rank int")
        return lambda queries, depth: table.where(F.col("rank") <= depth)

    settings = {"single": Setting({"x": Arm("t", depth=2)}), "both": Setting({"x": Arm("t"), "y": Arm("t")}, 5, {"y": 3.0})}
    asked = spark.createDataFrame([(1, "q1", "one"), (2, "q2", "two")], "qid int, query_key string, query string")
    results = experiments.search_arms(settings, {"x": arm("abc"), "y": arm("cab")}, asked)
    gains = spark.createDataFrame([(1, "ka", 3), (1, "kc", 0)], "qid int, chunk_key string, gain int")
    by_id = spark.createDataFrame([(1, "a", "ka"), (1, "c", "kc")], "qid int, id string, chunk_key string")
    split = spark.createDataFrame([("q1", "train"), ("q2", "val")], "query_key string, split string")
    targets = spark.createDataFrame([(2, "q2", "fb")], "qid int, query_key string, source string")
    sources = spark.createDataFrame([(i, f"f{i}") for i in "abc"], "id string, source string")
    run = experiments.run_experiments(results, settings, asked.where("qid = 1").drop("query"), gains, by_id, split, targets, sources)
    got = {(r["setting"], r["kind"]): r for r in run.metrics.collect()}
    assert got["single", "annotated"]["ndcg_10"] == 1.0 and got["both", "annotated"]["mrr_10"] == 0.5
    assert got["single", "generated"]["file_mrr"] == 0.5 and got["both", "generated"]["file_mrr"] == round(1 / 3, 6)
    assert pairs(run.unjudged) == [("both", "q1", "b", 3), ("single", "q1", "b", 2)]
    keys = spark.createDataFrame([(i, f"k{i}") for i in "abc"], "id string, chunk_key string")
    judged = spark.createDataFrame([("q1", "ka")], "query_key string, chunk_key string")
    empty = spark.createDataFrame([], stores.QUEUE)
    queue = experiments.queued(empty, run, keys, judged, "r1", F.lit("2024-01-01").cast("timestamp"), "both")
    assert [(r["chunk_id"], r["best_rank"], r["runs"]) for r in queue.collect()] == [("b", 3, ["r1"])]
    stores.write_experiment(run.per_query, run.metrics, experiments.settings_table(spark, settings), "20240101T000000Z", str(tmp_path / "runs"))
    assert {r[0] for r in stores.read_runs(spark, str(tmp_path / "runs")).select("run_id").distinct().collect()} == {"20240101T000000Z-single", "20240101T000000Z-both"}
    with pytest.raises(ValueError):
        experiments.search_arms(settings, {"x": arm("abc")}, asked)


def test_run_files_samples_and_static_rows(spark, tmp_path):
    block = {"annotated": {"num_queries": 2, "ndcg@10": 0.5, "old": None}, "generated": {}}
    for name in ("r1", "r2"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metrics.json").write_text(json.dumps({"run_id": name, "name": "n", "train": block, "val": {"annotated": block["annotated"]}}))
    got = stores.read_metric_files(spark, str(tmp_path / "runs")).collect()
    assert sorted((r["run_id"], r["split"], r["kind"]) for r in got) == sorted((n, s, k) for n in ("r1", "r2") for s, k in (("train", "annotated"), ("train", "generated"), ("val", "annotated")))
    assert {r["metrics"]["ndcg@10"] for r in got if r["kind"] == "annotated"} == {0.5} and all("old" not in r["metrics"] for r in got)
    (tmp_path / "runs" / "r1" / "per_query.jsonl").write_text(json.dumps({"query": "Q", "query_key": "q", "kind": "annotated", "split": "val", "metrics": {"ndcg@10": 1.0}, "results": [{"rank": 1, "id": "a"}], "x": 1}) + "\n")
    assert stores.read_per_query(spark, str(tmp_path / "runs"), "r1").first()["results"][0]["id"] == "a"
    records = [{"query": q, "query_key": q, "kind": "annotated", "split": "train", "metrics": {"ndcg@10": 0.5}, "results": [{"rank": 1, "id": q}]} for q in ("one", "two")]
    (tmp_path / "runs" / "r1" / "per_query.json").write_text(json.dumps(records, indent=2))
    assert [r["results"][0]["id"] for r in stores.read_per_query(spark, str(tmp_path / "runs"), "r1").orderBy("query").collect()] == ["one", "two"]
    notes_ = spark.createDataFrame([(f"n{i}",) for i in range(9)], "source string")
    stores.write_sample(keyed.seeded_sample(notes_, 3, "source", 1), str(tmp_path / "s"), 250)
    row = spark.read.json(str(tmp_path / "s")).first()
    assert row["num_samples"] == 3 == len(row["samples"]) and row["min_characters"] == 250
    made = spark.createDataFrame([("q", "f", "p", "t")], "query string, source_file string, passage string, type string")
    for _ in range(2):
        stores.append_generated(made, str(tmp_path / "g"), "m", 0.5)
    assert spark.read.json(str(tmp_path / "g")).count() == 2
    (tmp_path / "canned.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    asked = spark.createDataFrame([(1,), (2,)], "qid int")
    assert stores.static_results(spark, str(tmp_path / "canned.json"), asked).count() == 4
    assert [(r["qid"], r["rank"], json.loads(r["row"])["id"]) for r in stores.static_results(spark, str(tmp_path / "canned.json"), asked, 1).orderBy("qid").collect()] == [(1, 1, "a"), (2, 1, "a")]


def test_candidates_of_several_sources_are_pooled(spark, tmp_path):
    from lumenrank.operators import pooling
    from lumenrank.operators.candidates import candidates, gathered

    rows = [(str(i), "", f"zebra{i} common text") for i in range(8)]
    chunks = spark.createDataFrame(rows, "id string, title string, text string").withColumn("vector", vectors.embed(F.col("text")))
    (tmp_path / "canned.json").write_text(json.dumps([{"id": "x", "chunk": "zebra3 common text", "score": "high"}, {"id": "y", "text": "other", "similarity": 0.25}]))
    specs = [
        {"name": "words", "type": "fts", "table": "chunks_fts"}, {"name": "dense", "type": "pgvector", "table": "chunks_qwen", "embedder": "qwen"},
        {"name": "canned", "type": "static", "chunks_file": str(tmp_path / "canned.json")},
    ]
    asked = spark.createDataFrame([(1, "zebra3")], "qid int, query string")
    tables = {"chunks_fts": chunks, "chunks_qwen": chunks}
    found = candidates(specs, asked, 2, tables, {"qwen": vectors.embed}, {"chunks_fts": LexicalIndex.build(chunks)})
    got = {(r["retriever"], r["chunk_id"]): (r["rank"], r["score"]) for r in found.collect()}
    assert got["words", "3"][0] == 1 and got["dense", "3"][0] == 1 and got["canned", "x"] == (1, None) and got["canned", "y"] == (2, 0.25)
    top = pooling.pool(found).where("text = 'zebra3 common text'").first()
    assert [s["retriever"] for s in top["sources"]] == ["words", "dense", "canned"] and top["best_rank"] == 1
    with pytest.raises(ValueError):
        candidates([{"name": "r", "type": "remote", "index_id": "i"}], asked, 2, {}, {}, {})
    with pytest.raises(ValueError):
        candidates(specs, asked, 51, tables, {}, {})

    @F.pandas_udf("array<double>")
    def breaks(texts: pd.Series) -> pd.Series:
        raise OSError("no model")

    lexical = {"chunks_fts": LexicalIndex.build(chunks)}
    more = [*specs, {"name": "gone", "type": "static", "chunks_file": str(tmp_path / "gone.json")}, {"name": "far", "type": "remote", "index_id": "i"}]
    rest, errors = gathered(more, asked, 2, tables, {"qwen": breaks}, lexical)
    assert {(r["retriever"], r["chunk_id"]) for r in rest.collect()} == {k for k in got if k[0] != "dense"}
    assert set(errors) == {"dense", "gone", "far"} and "PATH_NOT_FOUND" in errors["gone"] and "no model" in errors["dense"]
    with pytest.raises(RuntimeError, match="no source works"):
        gathered(more[3:], asked, 2, tables, {}, lexical)
    with pytest.raises(ValueError):
        gathered([specs[0], specs[0]], asked, 2, tables, {}, lexical)


def test_an_older_row_of_a_later_batch_does_not_replace(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    put = lambda *rows: table.upsert(spark.createDataFrame(rows, "id long, seq long, v string"), "seq")
    assert put((1, 5, "five"), (1, 4, "four"), (2, 1, "one")) == 2
    assert put((1, 3, "three"), (2, 2, "two")) == 1
    assert put((1, 5, "five again"), (3, 0, "new")) == 2
    assert pairs(table.read().select("id", "seq", "v")) == [(1, 5, "five again"), (2, 2, "two"), (3, 0, "new")]


def test_other_files_are_not_opened(spark, tmp_path):
    """A suffix filter reaches the listing: a file that can't be read does no harm."""
    (tmp_path / "a.md").write_text("A note")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "b.bin").chmod(0)
    (tmp_path / "c.mdx").write_text("no")
    rows = notes.scan_files(spark, str(tmp_path))
    assert [r["source"] for r in rows.collect()] == ["a.md"] and all(f.endswith("a.md") for f in rows.inputFiles())


def test_a_sync_writes_only_buckets_that_differ(spark, tmp_path):
    table, kinds = KeyedTable(spark, str(tmp_path / "t"), buckets=32), "id long, v string, a array<long>, x double"
    rows = spark.range(1000).selectExpr("id", "concat('v', id) AS v", "array(id, null) AS a", "if(id % 3 = 0, null, id / 7) AS x")
    first = table.sync(rows)
    assert first.affected == first.changed == 1000 and len(first.buckets) == 32
    again = table.sync(rows.repartition(3))
    assert tuple(again) == (1000, 0, []) and table.state()[0] == 1
    some = rows.withColumn("v", F.when(F.col("id").isin(5, 6), "other").otherwise(F.col("v"))).where("id <> 9").unionByName(spark.createDataFrame([(2000, "new", None, None)], kinds))
    before = table.state()[1]["buckets"]
    got = table.sync(some)
    assert got.affected == 1000 and got.changed == 3 and 1 <= len(got.buckets) <= 3
    after = table.state()[1]["buckets"]
    assert sorted(int(b) for b in after if after[b] != before.get(b)) == got.buckets
    old, _ = keyed.sync(rows, some)
    key = lambda df: sorted(map(str, df.select("id", "v", "a", "x").collect()))
    assert key(table.read()) == key(old)  # the row that the source lacks stays
    assert tuple(table.sync(some)) == (1000, 0, [])
    table.upsert(spark.createDataFrame([(5, "by hand", None, None)], kinds))
    assert table.sync(some).changed == 1 and key(table.read()) == key(old)
