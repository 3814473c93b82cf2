import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank import config
from lumenrank.operators import dense, files, fusion, keyed, lexical


def docs(spark, rows):
    return spark.createDataFrame([(i, t, b) for i, t, b in rows], "id string, title string, text string")


def search(spark, rows, query, depth=10, **kw):
    asked = spark.createDataFrame([(1, query)], "qid int, query string")
    got = lexical.LexicalIndex.build(docs(spark, rows), kw.pop("analyzer", "simple")).search(asked, depth, **kw)
    return [r["id"] for r in got.orderBy("rank").collect()]


FILLER = [(f"f{i}", "", f"common filler {i}") for i in range(20)]


def test_title_beats_body_and_rare_beats_common(spark):
    assert search(spark, [("b", "", "zebra"), ("a", "zebra", ""), *FILLER], "zebra") == ["a", "b"]
    assert search(spark, [("a", "", "zebra"), ("b", "", "common common common"), *FILLER], "zebra common", 1) == ["a"]


def test_common_terms_are_cut_unless_all_are(spark):
    rows = [("a", "", "zebra"), *FILLER]
    assert search(spark, rows, "zebra common") == ["a"]
    assert len(search(spark, rows, "common")) == 10
    assert search(spark, rows, "unknown") == []
    assert search(spark, rows, "the and of", analyzer="english") == []


def test_lexical_index_is_not_written_directly(spark):
    with pytest.raises(NotImplementedError):
        lexical.LexicalIndex.build(docs(spark, FILLER)).index([])


def test_dense_depth_and_both_forms_agree(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 600, (i % 7) / 7]) for i in range(600)], "id long, vector array<double>")
    asked = spark.createDataFrame([(1000, [1.0, 0.0, 0.0]), (1001, [0.0, 1.0, 0.0])], "qid long, vector array<double>")
    fast = dense.dense_search(asked, rows, 60)
    assert fast.where("qid = 1000").count() == 60
    slow = lexical.ranked(dense.dense_scores(asked, rows), 60)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert sorted(map(tuple, dense.dense_search(asked, rows, 60, block=1).collect())) == sorted(map(tuple, fast.collect()))


def test_dense_handles_null_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r["id"] for r in dense.dense_search(asked, rows, 5).collect()] == [3]


def test_approximate_index_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in base[i % 20] + 0.1 * rng.standard_normal(16)]) for i in range(200)], "id long, vector array<double>")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    exact = {(r["qid"], r["id"]) for r in dense.dense_search(asked, rows, 5).collect()}
    near = {(r["qid"], r["id"]) for r in dense.ApproximateIndex(rows).search(asked, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_approximate_index_on_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (8, None), (7, [1.0])], "qid long, vector array<double>")
    assert [(r["qid"], r["id"]) for r in dense.ApproximateIndex(rows).search(asked, 5).collect()] == [(9, 1)]
    assert dense.ApproximateIndex(rows.limit(0)).search(asked, 5).count() == 0


def test_recall_of_the_approximate_index_on_the_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    exact = {(r["qid"], r["id"]) for r in dense.dense_search(asked, rows, 10).collect()}
    near = {(r["qid"], r["id"]) for r in dense.ApproximateIndex(rows).search(asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_many_queries_are_refused_by_the_readable_form(spark):
    asked = spark.range(dense.QUERY_BLOCK + 1).select(F.col("id").alias("qid"), F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(ValueError):
        dense.dense_scores(asked, asked.select(F.col("qid").alias("id"), "vector"))


def arm(spark, rows):
    return spark.createDataFrame([(1, i, 1.0 / r, r) for i, r in rows], "qid int, id string, score double, rank int")


def test_rrf_golden_values(spark):
    out = fusion.fuse(fusion.united({"a": arm(spark, [("x", 1)]), "b": arm(spark, [("y", 1), ("x", 2)])}), 60)
    got = {r["id"]: r for r in out.collect()}
    assert got["x"]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and got["y"]["score"] == pytest.approx(1 / 61, abs=1e-8)
    assert got["x"]["arms"] == {"a": 1, "b": 2} and got["y"]["arms"] == {"b": 1}


def test_ties_by_id_and_unknown_weights(spark):
    out = fusion.fuse(fusion.united({"a": arm(spark, [("y", 1)]), "b": arm(spark, [("x", 1)])}), 60, {"zzz": 5.0})
    assert [r["id"] for r in out.orderBy("rank").collect()] == ["x", "y"]


def test_an_id_twice_in_an_arm_adds_both_parts(spark):
    out = fusion.fuse(fusion.united({"a": arm(spark, [("x", 1), ("x", 4), ("y", 2)]), "b": arm(spark, [("x", 2)])}), 60)
    got = {r["id"]: r for r in out.collect()}
    assert got["x"]["score"] == pytest.approx(1 / 61 + 1 / 64 + 1 / 62, abs=1e-8) and got["x"]["arms"] == {"a": 4, "b": 2}


def test_merge_and_settings(spark):
    one = config.Setting({"fts": config.ARMS["fts"]}, top_k=2)
    rows = arm(spark, [("a", 1), ("b", 2), ("c", 3)])
    assert fusion.merge({"fts": rows}, one).count() == 2 and fusion.merge({"fts": rows}, one, 3).count() == 3
    with pytest.raises(ValueError):
        config.Setting({n: config.ARMS[n] for n in ("fts", "qwen")})
    with pytest.raises(ValueError):
        fusion.merge({}, one)
    with pytest.raises(ValueError):
        fusion.merge({"fts": rows}, one, 51)
    spec = {"arms": [{"name": "a", "kind": "dense", "table": "chunks_qwen", "embedder": "qwen"}]}
    assert config.setting_from(spec).k is None and config.setting_from(spec | {"fusion": "rrf"}).k == 60
    for bad in ({"embedder": None}, {"embedder": "other"}, {"table": "chunks_bge_m3"}, {"kind": "other"}):
        with pytest.raises(ValueError):
            config.setting_from({"arms": [spec["arms"][0] | bad]})
    with pytest.raises(ValueError):
        config.setting_from(spec | {"fusion": "other"})
    assert len(config.EXPERIMENTS) == 19 and config.EXPERIMENTS["rrf-3arm-dense-heavy"].weights == {"qwen": 1.0, "bge-m3": 1.0, "fts": 0.5}
    for bad in ([{"name": "r", "type": "fts"}], [{"name": "r", "type": "none"}], [{"name": "r", "type": "fts", "table": "t"}] * 2):
        with pytest.raises(ValueError):
            config.pool_sources(bad)


def test_registry():
    r = config.Registry()
    r.add("a", 1)
    with pytest.raises(ValueError):
        r.add("a", 2)
    r.remove("a")
    with pytest.raises(KeyError):
        r.get("a")


def test_keyed(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "n")], "id int, v string")
    assert sorted(map(tuple, keyed.upsert(old, new).collect())) == [(1, "o"), (2, "n"), (3, "n")]
    twice = spark.createDataFrame([(2, "n", 1), (2, "m", 2)], "id int, v string, seq int")
    assert sorted((r["id"], r["v"]) for r in keyed.upsert(old, twice, order="seq").collect()) == [(1, "o"), (2, "m")]
    with pytest.raises(Exception, match="key twice"):
        keyed.upsert(old, twice).collect()
    again = keyed.upsert(keyed.upsert(old, new), new)
    assert again.count() == 3 and keyed.not_stored(new, old).count() == 1


def test_files(spark):
    notes = spark.createDataFrame([("d/a.md", "cat", "dog"), ("d/b.md", "x", "cat"), ("e.md", "y", "z")], "source string, title string, text string")
    assert sorted(map(tuple, files.grep(notes, "cat").collect())) == [("d/a.md", "title"), ("d/b.md", "content")]
    assert {r[0] for r in files.listing(notes).collect()} == {"d", "e.md"} and {r[0] for r in files.listing(notes, "d").collect()} == {"a.md", "b.md"}
    assert files.read_file(notes, "e.md") == "z"
    with pytest.raises(FileNotFoundError):
        files.read_file(notes, "none")
    assert files.inside("/notes/a", "/notes") and not files.inside("/notes-x", "/notes")


def test_catalyst_search_gives_the_rows_of_dense_search_for_any_number_of_queries(spark, monkeypatch):
    """More queries than one broadcast takes, in parts; other lengths, zero, null and not finite vectors score nothing."""
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(6).round(1).tolist()) for i in range(400)] + [(900, [0.0] * 6), (901, None), (902, [float("nan")] + [1.0] * 5), (903, [1.0, 2.0]), (904, [2.0, 1.0])]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = index.where("id % 7 = 0 OR id >= 900").withColumnRenamed("id", "qid")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 20)
    for own in (True, False):
        got = {tuple(x) for x in dense.catalyst_search(asked, index, 10, own, most_bytes=1_000).collect()}
        plain = {tuple(x) for x in dense.dense_search(asked.where("size(vector) = 6"), index, 10, own).collect()}
        assert {g for g in got if g[0] < 900} == {p for p in plain if p[0] < 900} and len({g[0] for g in got}) == 60


def test_dense_search_holds_few_scores_at_once(spark, monkeypatch):
    """The matrix products of an Arrow batch are bounded by ``CELLS``, whatever the number of queries and rows."""
    r = np.random.default_rng(4)
    index = spark.createDataFrame([(i, r.standard_normal(4).tolist()) for i in range(600)], "id long, vector array<double>").coalesce(1)
    asked = index.where("id % 3 = 0").withColumnRenamed("id", "qid")
    want = {tuple(x) for x in dense.dense_search(asked, index, 5, True).collect()}
    monkeypatch.setattr(dense, "CELLS", 1_000)
    assert {tuple(x) for x in dense.dense_search(asked, index, 5, True).collect()} == want and len(want) == 1_000


def test_frequencies_of_asked_terms_need_no_index(spark):
    docs = spark.createDataFrame([(1, "a b", "b c c"), (2, None, None), (3, "", "c d"), (4, "c", "c")], "id long, title string, text string")
    asked = spark.createDataFrame([(1, "c b unknown"), (2, "c")], "qid long, query string")
    terms = lexical.query_terms(asked)
    whole = {tuple(r) for r in lexical.document_frequency(lexical.build_postings(docs)).collect()}
    got = {tuple(r) for r in lexical.asked_frequency(docs, terms).collect()}
    assert got == {w for w in whole if w[0] in ("b", "c")} == {("b", 1), ("c", 3)}


def test_texts_go_to_python_in_small_batches(spark):
    from lumenrank.plans import catalogue

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for name in ("overflow_pack_sentences", "clean_text_nfkc"):
            for key, value in zip(keys, ("10000", "268435456")):
                spark.conf.set(key, value)
            assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
            assert int(spark.conf.get(keys[0])) <= 1_000 and int(spark.conf.get(keys[1])) <= 4_000_000
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_arms_are_searched_once(spark):
    """A plan that reads an arm for several settings scans its stored rows, and no postings."""
    from lumenrank.plans import derived

    files = [f for arm in derived.arms(spark, "/root/testdata/sf0.001").values() for f in arm.inputFiles()]
    assert files and all("/arm-" in f for f in files)
