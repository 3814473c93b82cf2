import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenrank.functions import analysis, text, vectors


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


def test_clean(spark):
    dirty = ["  a \t b  ", "a\r\nb\rc", "a\u0000​b﻿", "ﬁn", "Ａ", "a b", "é", "a\n\n\n\nb", "", None]
    assert column(spark, dirty, text.clean) == ["a b", "a\nb\nc", "ab", "fin", "A", "a b", "é", "a\n\nb", "", None]


def test_query_key_folds_case_and_space(spark):
    assert column(spark, [" Große\n STRASSE "], text.query_key) == ["grosse strasse"]


def test_chunk_key_without_text(spark):
    got = column(spark, [None, "", " ", "a  b"], lambda c: text.chunk_key(c, F.lit("r"), F.lit("7")))
    assert got[:2] == ["noid:r:7"] * 2
    assert got[2] == "e3b0c44298fc1c14" and len(got[3]) == 16


def test_title_drops_trailing_id(spark):
    assert column(spark, ["Note " + "a1" * 16, "b2" * 16, "plain"], text.title_of) == ["Note", "b2" * 16, "plain"]


def test_overflow_shapes(spark):
    long = "w" * 30
    assert column(spark, ["short", long], lambda c: text.truncate(c, 20)) == ["short", "w" * 12]
    assert column(spark, [long], lambda c: text.barbell(c, 20)) == ["w" * 6 + " " + "w" * 6]


def test_sentences_are_packed_and_cut():
    assert text.packed("a b. c d. e f.", 4) == ["a b. c d.", "e f."]
    assert text.packed("x" * 10 + ". ok.", 2) == ["x" * 6, "x" * 4 + ".", "ok."]
    assert text.packed("\n\n", 2) == []


def test_shortened(spark):
    assert column(spark, ["0123456789abc", "short"], lambda c: text.shortened(c, 10)) == ["0123456789… [3 more characters]", "short"]


def test_chunks_group_sentences_and_fold_the_tail():
    a, b, c = "a" * 39 + ".", "b" * 39 + ".", "c" * 9 + "."
    assert text.chunked(f"{a} {b} {c}", 50, 20, 0) == [a, f"{b} {c}"]
    assert text.chunked("", 50, 20, 0) == [] and text.chunked(" \n ", 50, 20, 0) == []
    assert text.chunked("x" * 300, 100, 10, 0) == ["x" * 100] * 3
    assert text.chunked("one\n\ntwo", 100, 10, 0) == ["one\n\ntwo"]
    with pytest.raises(ValueError):
        text.chunked("x", 10, 10)


def test_chunk_overlap_repeats_the_last_sentence():
    s = [f"Sentence number {i} here." for i in range(6)]
    got = text.chunked(" ".join(s), 60, 10, 30)
    assert len(got) > 2 and all(got[i + 1].startswith(got[i].split(". ")[-1].rstrip(".")[:10]) for i in range(len(got) - 2))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300))
def test_chunks_cover_the_text(t):
    got = text.chunked(t, 40, 5, 10)
    assert all(len(c) <= 40 + 5 + 1 for c in got)
    assert set("".join(t.split())) <= set("".join(got)) or not t.strip()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(2, 60), st.integers(0, 30))
def test_runs_without_separators_are_cut_like_single_characters(n, most, overlap):
    """Brute force: characters are merged one by one, and the overlap of a full chunk is kept."""
    overlap, run = min(overlap, most - 1), "".join(chr(97 + i * 7 % 26) for i in range(n))
    want, held, fresh = [], "", False
    for c in run:
        if len(held) + 1 > most:
            want.append(held)
            held = held[len(held) - overlap :] if overlap else ""
        held, fresh = held + c, True
    if fresh:
        want.append(held)
    assert text.chunked(run, most, 0, overlap) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.! \n", max_size=80), st.integers(1, 6))
def test_packed_sentences_equal_brute_force(t, budget):
    """Sentences in order, each piece as long as it may grow; over-long sentences are cut and stand alone."""
    import math
    import re

    want, grows = [], False
    for sentence in [x for x in re.split(r"(?<=[.!?])\s+|\n+", t) if x]:
        cost = math.ceil(len(sentence) / 3)
        if cost > budget:
            want += [[sentence[i : i + 3 * budget]] for i in range(0, len(sentence), 3 * budget)]
            grows = False
        elif grows and sum(math.ceil(len(x) / 3) for x in want[-1]) + cost <= budget:
            want[-1].append(sentence)
        else:
            want.append([sentence])
            grows = True
    assert text.packed(t, budget) == [" ".join(w) for w in want]


class Letters:
    """A tokenizer of two characters a token."""

    def encode(self, t):
        return [t[i : i + 2] for i in range(0, len(t), 2)]

    def decode(self, ids):
        return "".join(ids)


def test_overflow_by_a_models_tokens(spark):
    most = text.MARGIN + 3
    assert column(spark, ["abcdef", "abcdefghi", None], lambda c: text.by_tokens(c, Letters(), most)) == [["abcdef"], ["abcdef"], None]
    assert column(spark, ["abcdefghi"], lambda c: text.by_tokens(c, Letters(), most, "barbell")) == [["ab ghi"]]
    assert column(spark, ["abcdefghi"], lambda c: text.by_tokens(c, Letters(), most, "split")) == [["abcdef", "ghi"]]
    with pytest.raises(ValueError):
        text.by_tokens(None, Letters(), most, "other")


def test_models_plug_in_by_name():
    import numpy as np

    with pytest.raises(ValueError, match="plug in"):
        vectors.build_encoder("qwen")
    vectors.plug("qwen", lambda: vectors.HashingEncoder(8))
    with pytest.raises(ValueError, match="1024"):
        vectors.build_encoder("qwen")
    vectors.plug("qwen", lambda: vectors.HashingEncoder(1024))
    assert np.shape(vectors.build_encoder("qwen").encode(["x"])) == (1, 1024)
    vectors.ENCODERS.pop("qwen")


def test_stems():
    pairs = {"running": "run", "cats": "cat", "ponies": "poni", "relational": "relat", "generously": "generous", "hopping": "hop", "happy": "happi", "nationality": "nation", "skies": "sky", "agreed": "agre"}
    assert {w: analysis.stem(w) for w in pairs} == pairs


def test_english_drops_stop_words(spark):
    assert column(spark, ["The cats are running"], analysis.english) == [["cat", "run"]]


def test_encoder_is_unit_length_and_named():
    import numpy as np

    v = vectors.build_encoder("hashing", dimensions=16).encode(["a b", ""])
    assert np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any()
    with pytest.raises(ValueError):
        vectors.build_encoder("none")
