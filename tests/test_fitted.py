"""Texts of any length to one vector: against packing, encoding and averaging by DataFrames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.functions import text as tx
from lumenrank.functions import vectors
from lumenrank.plans import derived
from lumenrank.sources.tables import KeyedTable
from lumenrank.streaming.ingest import ingest_notes
from tests.conftest import SF

TOKENS = 120


class Lengths:
    """A vector that tells of the text and of the calls: length, words, greatest call, calls."""

    def __init__(self):
        self.calls, self.most = 0, 0

    def encode(self, texts):
        self.calls, self.most = self.calls + 1, max(self.most, len(texts))
        assert [len(t) for t in texts] == sorted(len(t) for t in texts)
        return np.array([[len(t), len(t.split()), self.most, self.calls] for t in texts])


def test_equals_pack_encode_mean(spark):
    docs = derived.notes(spark, SF).select("id", "text")
    got = docs.select("id", vectors.embed_fitted(F.col("text"), vectors.HashingEncoder(), TOKENS).alias("vector"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    pieces = docs.select("id", F.posexplode(tx.pack_sentences(F.coalesce("text", F.lit("")), TOKENS)).alias("i", "piece"))
    assert pieces.groupBy("id").count().where("count > 1").count() > 10
    coded = pieces.select("id", "i", vectors.embed(F.col("piece")).alias("vector"))
    want = {r["id"]: r["vector"] for r in vectors.mean_vectors(coded, "id", "vector").collect()}
    rows = {r["id"]: r["vector"] for r in got.collect()}
    assert rows.keys() == want.keys()
    for i in rows:
        np.testing.assert_allclose(rows[i], want[i], atol=1e-12)


@pytest.mark.parametrize("form,column", [("truncate", tx.truncate), ("barbell", tx.barbell)])
def test_other_forms(spark, form, column):
    docs = derived.notes(spark, SF).where("text IS NOT NULL").select("id", "text")
    both = docs.select(vectors.embed_fitted(F.col("text"), vectors.HashingEncoder, TOKENS, form).alias("a"), vectors.embed(column(F.col("text"), TOKENS)).alias("b")).collect()
    for r in both:
        np.testing.assert_allclose(r["a"], r["b"], atol=1e-12)


def test_small_table(spark):
    long = "One sentence here. " * 60
    rows = [(0, None), (1, ""), (2, "short"), (3, long), (4, "\n" * 4000), (5, "x" * 5000), (6, "short")]
    docs = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r["id"]: r["v"] for r in docs.select("id", vectors.embed_fitted(F.col("text"), Lengths, TOKENS, at_once=3).alias("v")).collect()}
    assert got[0][:2] == got[1][:2] == got[4][:2] == [0, 0] and got[2][:2] == got[6][:2] == [5, 1]
    pieces = tx.packed(long, TOKENS - tx.MARGIN)
    assert len(pieces) > 1 and got[3][0] == pytest.approx(np.mean([len(p) for p in pieces]))
    assert max(v[2] for v in got.values()) <= 3  # at most three in a call
    assert docs.limit(0).select(vectors.embed_fitted(F.col("text"), Lengths, TOKENS)).collect() == []
    with pytest.raises(ValueError, match="overflow form"):
        vectors.embed_fitted(F.col("text"), Lengths, TOKENS, "tail")
    with pytest.raises(ValueError, match="too small"):
        vectors.embed_fitted(F.col("text"), Lengths, tx.MARGIN)


def test_wrong_number_of_vectors(spark):
    class Short:
        def encode(self, texts):
            return np.zeros((len(texts) - 1, 2))

    with pytest.raises(Exception, match="another number of vectors"):
        spark.range(3).select(vectors.embed_fitted(F.col("id").cast("string"), Short(), TOKENS)).collect()


def test_ingest_by_fitted_encoder(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "A", "Words of a note. " * 100), ("b.md", "B", "brief")], "source string, title string, text string")
    n = ingest_notes(notes, str(tmp_path), "hashing", lambda t: vectors.embed_fitted(t, vectors.HashingEncoder, TOKENS))
    stored = KeyedTable(spark, f"{tmp_path}/chunks_hashing").read()
    assert n == stored.count() >= 2 and stored.where("size(vector) = 64").count() == n
