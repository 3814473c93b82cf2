"""The trigram index keeps a batch's notes of a trigram in one list, where the notes lie."""

from lumenrank.operators.patterns import PatternIndex, trigram_lists


def test_lists_hold_each_trigram_of_a_text_once():
    texts = ["abcabc", None, "", "ab", "xabc\n😀é", "\x00\x00\x00", "abc"]
    grams, places, ends = trigram_lists(texts)
    got = {(g, p) for i, g in enumerate(grams) for p in places[ends[i] : ends[i + 1]].tolist()}
    assert got == {(t[j : j + 3], i) for i, t in enumerate(texts) for j in range(len(t or "") - 2)}
    assert len(got) == len(places) and len(set(grams)) == len(grams)
    assert trigram_lists([None, ""])[0] == [] and trigram_lists([])[0] == []


def test_store_has_one_row_for_a_trigram_of_a_batch_and_no_shuffle(spark, tmp_path):
    notes = spark.createDataFrame([(f"{i}.md" if i else None, None, "common text") for i in range(90)], "source string, title string, text string").coalesce(1)
    index = PatternIndex.store(notes, str(tmp_path / "grams"))
    assert spark.read.parquet(str(tmp_path / "grams")).count() == 9  # as many as trigrams
    assert index.postings.count() == 9 * 90 and index.postings.where("source IS NULL").count() == 9
    assert len(list((tmp_path / "grams").glob("part-*.parquet"))) == 1
    assert index.grep("commo?n t", matches=100).count() == 90
