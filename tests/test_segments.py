"""The segmented lexical index: upkeep against rebuilt indexes, early stop against whole scoring."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators.lexical import LexicalIndex
from lumenrank.operators.segments import SegmentedIndex, tile_hits
from lumenrank.sources.manifests import Manifests

WORDS = [f"w{i}" for i in range(120)]


def note(r, i):
    n = r.choice([0, 1, 5, 30, 80])
    words = [WORDS[min(int(r.expovariate(0.05)), 119)] for _ in range(n)]
    return i, " ".join(words[:3]), " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string")


def asked(spark, r, n=12):
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 3, 8, 20])))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, "unknown words"), (n + 2, "w1 w1 w2")], "qid long, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "id", "score", "rank").collect())


@pytest.mark.parametrize("max_df", [0.15, 1.0])
def test_query_after_upserts_equals_a_rebuilt_index(spark, tmp_path, max_df):
    r = random.Random(5)
    docs = {i: note(r, i) for i in range(300)}
    index = SegmentedIndex.create(frame(spark, list(docs.values())), str(tmp_path / "index"), tile_docs=60)
    queries = asked(spark, r)
    first = {s["name"] for s in index.state()[1]["segments"]}
    files = {str(p): p.stat().st_mtime_ns for s in first for p in (tmp_path / "index" / s).rglob("*.parquet")}
    for step in range(4):
        batch = [note(r, i) for i in r.sample(range(360), 25)]
        docs |= {d[0]: d for d in batch}
        assert index.upsert(frame(spark, batch)) == 25
        if step == 1:
            out = r.sample(sorted(docs), 10)
            index.delete(spark.createDataFrame([(i,) for i in [*out, 9999]], "id long"))
            for i in out:
                docs.pop(i)
    assert files == {str(p): p.stat().st_mtime_ns for s in first for p in (tmp_path / "index" / s).rglob("*.parquet")}  # nothing old is written again
    fresh = LexicalIndex.build(frame(spark, list(docs.values())))
    want = rows(fresh.search(queries, 7, max_df))
    assert rows(index.search(queries, 7, max_df)) == want
    assert {x["id"] for x in index.documents().collect()} == set(docs)
    assert index.merge(fan=2) > 0
    assert rows(SegmentedIndex(spark, str(tmp_path / "index")).search(queries, 7, max_df)) == want
    again = [note(r, i) for i in (1, 2, 500)]
    docs |= {d[0]: d for d in again}
    index.upsert(frame(spark, again))
    assert rows(index.search(queries, 7, max_df)) == rows(LexicalIndex.build(frame(spark, list(docs.values()))).search(queries, 7, max_df))


def test_empty_index_and_batches(spark, tmp_path):
    queries = spark.createDataFrame([(1, "w1")], "qid long, query string")
    index = SegmentedIndex.create(frame(spark, []), str(tmp_path / "empty"))
    assert index.search(queries).count() == 0 and index.upsert(frame(spark, [])) == 0
    index.upsert(frame(spark, [(1, "w1", "w1 w2"), (2, None, None)]))
    assert [(r["id"], r["rank"]) for r in index.search(queries).collect()] == [(1, 1)]
    index.delete(spark.createDataFrame([(1,), (2,)], "id long"))
    assert index.search(queries).count() == 0 and index.documents().count() == 0
    assert index.search(queries.limit(0)).count() == 0


def test_early_stop_gives_whole_results_and_reads_less(spark, tmp_path):
    r = random.Random(9)
    docs = [(i, "", " ".join([*(r.choice(WORDS[:12]) for _ in range(20)), *(r.choice(WORDS[12:]) for _ in range(i % 7))])) for i in range(2000)]
    index = SegmentedIndex.create(frame(spark, docs), str(tmp_path / "index"), tile_docs=500)
    queries = spark.createDataFrame([(i, " ".join(r.sample(WORDS[:12], 2) + r.sample(WORDS[12:], 3))) for i in range(20)], "qid long, query string")
    assert rows(index.search(queries, 5, 1.0)) == rows(LexicalIndex.build(frame(spark, docs)).search(queries, 5, 1.0))
    cost = index.search_cost(queries, 5, 1.0).agg(F.sum("postings").alias("postings"), F.sum("read").alias("read")).first()
    assert cost["read"] < 0.6 * cost["postings"]


def test_tile_hits_keep_every_document_of_the_best(seed=3):
    r = np.random.default_rng(seed)
    for _ in range(300):
        lists = {t: (np.flatnonzero(r.random(80) < r.choice([0.02, 0.3, 0.9])), None) for t in "abcdef"}
        lists = {t: (d, r.integers(1, 5, len(d)) * 0.4) for t, (d, _) in lists.items() if len(d)}
        gone = np.flatnonzero(r.random(80) < 0.1)
        terms = sorted(((t, float(r.random() * r.choice([1, 8]))) for t in "abcdefg"), key=lambda x: -x[1])
        score = np.zeros(80)
        often = np.zeros(80)
        for t, w in terms:
            if t in lists:
                score[lists[t][0]] += w
                often[lists[t][0]] += lists[t][1]
        score = np.where(score > 0, score + often / (1 + often), -1)
        score[gone] = -1
        depth = int(r.integers(1, 12))
        true = sorted((s for s in score if s > 0), reverse=True)
        sure = true[depth - 1] - 0.5 if len(true) >= depth and r.random() < 0.5 else -np.inf
        docs, found, total, read = tile_hits(lists, gone, terms, depth, sure)
        least = true[depth - 1] if len(true) >= depth else 0
        assert {d for d in range(80) if score[d] > 0 and score[d] >= least} <= set(docs.tolist()) and read <= total
        assert np.allclose(score[docs], found)


def test_two_writers_of_one_manifest(spark, tmp_path):
    """Of writers that commit the same number at once exactly one wins, and its manifest is whole."""
    manifests, done, lost = Manifests(spark, str(tmp_path / "m")), [], []

    def write(i):
        try:
            Manifests(spark, str(tmp_path / "m")).commit(1, {"by": i, "text": "x" * 10_000})
            done.append(i)
        except RuntimeError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 7 and manifests.last()[1]["by"] == done[0]
    assert [n for n in manifests.names() if not n.endswith(".crc")] == ["manifest-0000000001.json"]


def test_a_bucket_holds_one_tile(spark, tmp_path):
    """However many tiles there are, so that a task's rows stay those of one tile."""
    r = random.Random(5)
    index = SegmentedIndex.create(frame(spark, [(i, "one", f"w1 w{r.randrange(9)} w2") for i in range(400)]), str(tmp_path / "own"), tile_docs=20)
    segment = index.state()[1]["segments"][0]
    files = spark.read.parquet(f"{index.path}/{segment['name']}/postings").groupBy(F.input_file_name()).agg(F.count_distinct("tile").alias("tiles")).collect()
    assert segment["tiles"] == 20 and [f["tiles"] for f in files] == [1] * 20
    ids = spark.read.parquet(f"{index.path}/{segment['name']}/ids")
    assert ids.count() == 400 and ids.select("tile").distinct().count() == 20
