"""Vector codes and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import fill_in_middle as fim
from lumenrank.llm import vector_codes
from lumenrank.llm.common import materialize
from tests.llm.conftest import odd_rows

VECTORS = "vec_id long, embedding array<float>, label int, codes string, v string, old string, n int, part int"


def vector_rows(n=300, width=16, seed=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.3))) for c in centre[r.randrange(9)]], r.choice([1, 2, 2, 2, None])) for i in range(n)]
    rows += [(7, rows[7][1], 2), (8, rows[3][1], 2), (None, rows[4][1], None), (n, None, 1), (n + 1, [None] * width, 1)]
    rows += [(n + 2, [math.nan] + [0.0] * (width - 1), 1), (n + 3, [math.inf] + [0.0] * (width - 1), None), (n + 4, [], 1), (n + 5, [1.0] * 8, 1)]
    return [(i, v, label, "c", "v", "o", 1, 1) for i, v, label in rows]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label, *_ in rows if v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = 16 // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((x - c) ** 2 for x, c in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for k, members in own.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, label), f, e in zip(kept, found, error))


def test_codes_equal_brute_force(spark):
    got = vector_codes.compress(spark.createDataFrame(vector_rows(), VECTORS).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(vector_rows())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_or_no_vectors(spark, n):
    rows = vector_rows()[:n]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(rows)


def test_large_components_and_uncuttable_vectors(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r["error"] for r in vector_codes.compress(frame, entries=3).collect()} == {0}
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def test_only_changed_parts_are_shuffled(spark):
    """A state in which nothing changed gives no delta; one changed part gives its minus and its plus."""
    rows = [(1, 1, [5, 6, 7, 8], b"\x00\x01", b"\x00\x01", 0), (2, 1, [1, 2, 3, 4], b"\x00\x01", b"\x02\x01", 0)]
    state = spark.createDataFrame(rows, "vec_id long, label int, v array<long>, old binary, codes binary, error long")
    got = {(r["part"], r["entry"]): (r["n"], list(r["sums"])) for r in vector_codes.moved(materialize(state, "test-state"), 2, 3, 2).collect()}
    assert got == {(0, 0): (-1, [-1, -2]), (0, 2): (1, [1, 2])}


def brute_fim(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(prefix), len(middle), text, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), text, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fim_texts():
    r = random.Random(8)
    marks = ["a", "\n", "\n\n", "é", "漢", "\U0001f600", "\r\n", "<", "P", ">", "S>", "<M", " "]
    texts = ["", None, "\n", "\n\n\n", "one line", "x<P>y\nz", "<S>", "a\n<M>", "no end\nhere", "end\n", "<", "P>\n<", "a\n" * 5000, " a\u0085b\rc\n"]
    return [*texts, *("".join(r.choice(marks) for _ in range(r.randrange(1, 30))) for _ in range(300))]


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(i, t, "k", 1, "f") for i, t in enumerate(fim_texts())]
    rows += [rows[8], rows[8], (9, "other text\nof id 9", "k", 1, "f"), (None, "null id\ntwo\nthree", "k", 1, "f"), (None, None, None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n int, form string").repartition(6)
    got = fim.fill_in_middle(frame)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_fim(i, t) for i, t, *_ in rows)
    assert got.where(~fim.restore(F.col("output"), F.col("form")).eqNullSafe(F.col("text"))).count() == 0
    some = fim.fill_in_middle(frame, rate=30)
    assert Counter(tuple(r) for r in some.collect()) == Counter(brute_fim(i, t, 30) for i, t, *_ in rows)


def test_fill_in_middle_odd_rows(odd, none):
    got = fim.fill_in_middle(odd)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_fim(r[0], r[1]) for r in odd_rows())
    digests = fim.digests(got).where("output_sha256 IS NULL OR restored_sha256 IS NULL")
    assert digests.count() == 0 and fim.digests(fim.fill_in_middle(none)).count() == 0


def test_other_units_and_sentinels(spark):
    frame = spark.createDataFrame([(i, "some words of a text that goes on") for i in range(40)], "doc_id long, text string")
    sentinels = ("[pre.]", "[suf.]", "[mid.]")
    got = fim.fill_in_middle(frame, unit=r"\s*\S+", sentinels=sentinels)
    assert got.where(fim.restore(F.col("output"), F.col("form"), sentinels) != F.col("text")).count() == 0
    assert {r["n"] for r in got.collect()} == {8} and got.select("prefix_chars").distinct().count() > 3
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("a", "xay", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame, sentinels=bad)
