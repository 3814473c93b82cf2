"""The trigram index of pattern search against plain search."""

import random
import re

import pytest

from lumenrank.operators import files
from lumenrank.operators.patterns import PatternIndex, needed, trigrams_of
from lumenrank.plans import derived
from tests.conftest import SF


def test_needs_of_patterns():
    assert needed("abcd") == ("and", ("abc", "bcd"))
    assert needed("[Tt]hen") == ("or", (("and", ("The", "hen")), ("and", ("the", "hen"))))
    assert needed("(abc|xyz)+") == ("or", ("abc", "xyz"))
    assert needed("ab(?:c)d*efg") == ("and", ("abc", "efg"))
    assert needed("(ab){2}") == ("and", ("aba", "bab"))
    assert needed("(?s)abc") == "abc"
    deep = "x"
    for _ in range(30):
        deep = f"({deep}){{4}}"
    assert needed(deep) is None or trigrams_of(needed(deep)) == {"xxx"}
    for free in ("ab", "a.c", "abc|x", "(abc)?", "[a-z]{5}", "", r"\w+"):
        assert needed(free) is None, free


@pytest.mark.parametrize("pattern", ["(?i)abc", "(?x)a b c", "abc(?i:def)", r"\Qa.b\Ecde", r"ab\vcd", r"\b{g}abc", "[a[bc]d]efg", "[a-z&&[def]]xyz", "[]a]bcd", "(abc", r"\p{L}abc", "(?U)abc", "(?s-i:abc)", "(?<name>abc)", r"[a\]b[c]defg]", r"(a)\123bcd", r"\0123abc", r"\uD83D\uDE00abc"])
def test_patterns_of_another_meaning_need_nothing(pattern):
    assert needed(pattern) is None


NOTES = [
    ("a.md", "Plain title", "first text about learning"), ("b.md", "Learned things", "computers"), ("b.md", "Learned things", "computers"), ("c.md", None, "a\nb\ncde 😀xyz"),
    ("d.md", "", ""), ("e.md", "ab", None), (None, "learner", "no source"), ("f.md", "title", "xyz" * 2000 + "learnt"),
]


def both(index, notes, pattern, **options):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    assert rows(index.grep(pattern, **options)) == rows(files.grep(notes, pattern, **options)), pattern


def test_small_table(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "source string, title string, text string")
    index = PatternIndex.store(notes, str(tmp_path / "grams"))
    for pattern in ("[Ll]earn", "😀xyz", "a\nb", "b.cde", "(?s)b.cde", "title|computers", "(xyz){4}", "nowhere", "^Plain", "learnt$", "x*"):
        both(index, notes, pattern)
    both(index, notes, "earn", modes=("content",))
    both(index, notes, "earn", modes=("content", "title"), matches=1)
    assert index.share("learnt$") == pytest.approx(1 / 7) and index.share("x*") == 1.0
    empty = PatternIndex.store(notes.limit(0), str(tmp_path / "none"))
    assert empty.grep("learn").collect() == [] and empty.share("learn") == 0.0


def test_one_pass_and_pushed_trigrams(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "source string, title string, text string")
    index = PatternIndex.store(notes, str(tmp_path / "grams"))
    plan = index.candidates("learn")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "ear" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_random_patterns_over_documents(spark, tmp_path):
    """Patterns made of pieces of the texts: the same rows, and for rare pieces few notes are read."""
    notes = derived.notes(spark, SF).select("source", "title", "text").cache()
    index = PatternIndex.store(notes, str(tmp_path / "grams"))
    texts = [r["text"] for r in notes.where("length(text) > 40").orderBy("source").limit(60).collect()]
    draw, shares = random.Random(5), []

    def piece(n):
        text = draw.choice(texts)
        start = draw.randrange(len(text) - n)
        return re.escape(text[start : start + n])

    for n in range(12):
        pattern = [piece(12), f"({piece(5)}|{piece(7)})", f"{piece(4)}.*{piece(4)}", f"{piece(3)}[a-e]?{piece(5)}"][n % 4]
        both(index, notes, pattern)
        assert trigrams_of(needed(pattern)), pattern
        shares.append(index.share(pattern))
    assert min(shares) < 0.1 and sum(shares) / len(shares) < 0.8
    notes.unpersist()
