"""The index of a batch's own terms against the whole one, and the work that it saves."""

import pytest
from pyspark.sql import functions as F

from lumenrank.functions.analysis import simple, spaced
from lumenrank.operators.lexical import BatchIndex, LexicalIndex
from lumenrank.plans import derived
from tests.conftest import SF

DOCS = [
    (1, "Zebra", "Running zebras, ran! The common word"), (2, None, "common zebra"), (3, "", None), (4, "…", "ÀÉ straße ½ x_y İx"), (5, "common", " common\ncommon,, STRASSE straße "), (6, "A title", "nothing here"),
    *((i, "filler" if i % 3 else "", f"common word{i % 5} text{i} runs") for i in range(7, 60)),
]
ASKED = [(1, "zebra common zebra"), (2, "Straße ½ y unknown"), (3, "common"), (4, ""), (5, "the running word3"), (6, None)]


def pairs(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_batch_index_answers_like_the_whole_one(spark, tmp_path, analyzer, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id long, title string, text string").repartition(3)
    asked = spark.createDataFrame(ASKED, "qid int, query string")
    whole, own = LexicalIndex.build(docs, analyzer), BatchIndex.store(docs, asked, str(tmp_path / "own"), analyzer)
    assert own.n_docs == len(DOCS)
    for depth, cut in ((3, 0.15), (50, 1.0), (1, 0.5)):
        assert pairs(own.search(asked, depth, cut)) == pairs(whole.search(asked, depth, cut))
    monkeypatch.setattr("lumenrank.operators.lexical.SCORED_POSTINGS", 1)  # a batch at a time, against the best so far
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert pairs(own.search(asked, 3, 1.0)) == pairs(whole.search(asked, 3, 1.0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert own.search(asked.where("qid = 4")).count() == 0
    with pytest.raises(ValueError, match="not asked for"):
        own.search(spark.createDataFrame([(1, "title")], "qid int, query string"))
    more = BatchIndex.store(docs, asked, str(tmp_path / "whole"), analyzer, most=2)
    assert isinstance(more, LexicalIndex) and pairs(more.search(asked, 5)) == pairs(whole.search(asked, 5))
    empty = BatchIndex.store(docs.limit(0), asked, str(tmp_path / "none"), analyzer)
    assert empty.search(asked).count() == 0


def test_named_queries_keep_the_asked_terms_only(spark):
    """Of a document's words only the passages' are written, and its text is not shuffled to a bucket."""
    index = derived.index(spark, SF)
    asked = {r["w"] for r in derived.queries(spark, SF).select(F.explode(simple(F.col("query"))).alias("w")).collect()}
    assert set(index.only) == asked
    assert index.rows.count() == index.n_docs == derived.notes(spark, SF).count()


def test_spaced_words_are_the_simple_ones(spark):
    texts = [t for _, a, b in DOCS for t in (a, b)] + ["Σας ΣΑΣ", "a\u0085b c d", "😀1²x", "日本語 テスト", "_", "1.5e-3"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(~F.array_remove(F.split(spaced(F.col("text")), " "), "").eqNullSafe(simple(F.col("text")))).count() == 0
