import corpus_pipeline
from lumenrank.llm import decontaminate, exact_dedup, language_id, minhash
from lumenrank.llm.common import materialize, scratch
from lumenrank.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.llm.conftest import odd_rows


def test_stages_keep_what_they_should(spark, documents):
    docs = materialize(documents, "docs")
    for (name, stage), dropped in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: language_id.identify(d).where("lang_pred = 'und'").count(), lambda d: exact_dedup.exact_dedup(d).where("NOT kept").count(),
        lambda d: minhash.near_duplicates(d).where("NOT kept").count(), lambda d: decontaminate.decontaminate(d, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count(),
    ), strict=True):
        out = materialize(stage(spark, docs, SF), "stage")
        assert out.columns == documents.columns and out.count() == docs.count() - dropped(docs), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_odd_rows_pass(spark, odd):
    docs = materialize(odd, "odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "odd")
    ids = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    assert ids == [0, 11, 12, 7, None]


def test_of_texts_with_one_id_the_decided_one_goes(spark):
    item = " ".join(f"bench{i}" for i in range(20))
    unique, other, copy = (" ".join(f"{w}{i} word" for i in range(30)) for w in ("u", "o", "c"))
    rows = [(0, copy), (1, copy), (1, unique), (2, "a " + item), (2, other), (3, "12 34"), (3, None), (3, unique + " end of it"), (None, other + "x y z")]
    docs = materialize(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    folder = scratch(spark, "sf")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "docs")
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted([(0, copy), (1, unique), (2, other)], key=str)


def test_columns_may_have_any_name(spark):
    """Names that the stages use themselves, odd ones, and a map, which can't be sorted; of repeated rows the first by the others stays."""
    text = " ".join(f"w{i} word" for i in range(30))
    rows = [(1, text, "en", {"b": 2}, k, 5, 6, 7, 8, 9) for k in (True, False, True)] + [(2, text, "en", None, None, None, None, None, None, None), (3, "other " + text[::-1], "en", {}, True, 1, 1, 1, 1, 1)]
    names = "doc_id long, text string, lang string, m map<string,int>, kept boolean, _key int, _id int, _n int, key int, `a.b` int"
    docs = start = materialize(spark.createDataFrame(rows, names), "docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "docs")
        assert docs.dtypes == start.dtypes
    assert sorted((r["doc_id"], r["m"], r["kept"], r["_key"], r["a.b"]) for r in docs.collect()) == [(1, {"b": 2}, False, 5, 9), (3, {}, True, 1, 1)]


def test_empty_tables_pass(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "none")
        assert docs.count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(odd_rows()) == 17
