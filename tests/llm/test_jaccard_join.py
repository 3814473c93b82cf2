"""The n-gram Jaccard join against brute force, its tiles against random sets, and the dealing of blocks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import bitmaps, common, jaccard_join, linking
from lumenrank.llm.minhash import shingles, word_hashes
from tests.llm.conftest import odd_rows, prose


def brute_sets(rows, each):
    out = []
    for _, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out.append({tuple(w[i : i + each]) for i in range(len(w) - each + 1)} if len(w) >= each else {tuple(w)} if w else set())
    return out


def brute(rows, percent=90, each=3):
    sets, parent = brute_sets(rows, each), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    low = {g: min((rows[m][0] for m in members if rows[m][0] is not None), default=None) for g, members in groups.items()}
    return Counter((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows)))


def edited(words, share, r):
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in words)


def families(seed, count, size, least=2, most=120):
    """Families of edited copies at similarities around the limit, of short and longer texts, beside lines that many share."""
    r = random.Random(seed)
    rows = []
    for _ in range(count):
        base = prose(r.randrange(10**6), r.randrange(least, most)).split(" ")
        rows += [edited(base, r.choice([0, 0.005, 0.01, 0.02, 0.04, 0.1]), r) for _ in range(r.randrange(1, size))]
    line = prose(77, 20)
    rows += [f"{line} {prose(1000 + i, 12)}" for i in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent,each,block", [(90, 3, 256), (90, 3, 4), (70, 2, 8), (100, 3, 4)])
def test_join_equals_brute_force(spark, percent, each, block):
    rows = families(percent + block, 40, 14)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=percent, words_each=each, block=block, tile=block)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, percent, each)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_join_odd_rows(odd, none, sent):
    """Texts are fetched for the same ids whether these are broadcast or met by a shuffle behind a bit filter."""
    assert Counter(tuple(r) for r in jaccard_join.jaccard_join(odd, sent=sent).collect()) == brute(odd_rows())
    assert jaccard_join.jaccard_join(none, sent=sent).count() == 0


def test_large_group_of_copies_and_near_copies(spark):
    """A chain of near copies is one component though its ends are not similar; look-alikes below the limit stay apart."""
    r = random.Random(3)
    words = prose(5, 60).split(" ")
    rows, now = [], list(words)
    for i in range(80):
        rows.append((i, " ".join(now)))
        now[r.choice([0, 1, 58, 59])] = f"c{i}"
        if i % 9 == 8:
            now[30] = f"far{i}"
    rows += [(100 + i, " ".join(words)) for i in range(150)]
    rows += [(400 + i, edited(words, 0.06, r)) for i in range(120)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16, block_bytes=20_000, tile=16)
    assert Counter(tuple(x) for x in got.collect()) == brute(rows)


@pytest.mark.parametrize("percent", [60, 90, 97])
def test_linked_sets_share_a_tile(percent):
    """Pairs right at the limit, of all sizes, always meet; so do those with many weak segments."""
    r, zones = np.random.default_rng(percent), jaccard_join.Zones(percent)
    for _ in range(1500):
        a = int(r.integers(1, 400))
        most = a * 100 // percent
        b = int(r.integers(a, most + 1))
        low = -(-percent * (a + b) // (100 + percent))
        if low > a:
            continue
        both = int(r.integers(low, a + 1)) if r.random() < 0.3 else low
        pool = r.integers(0, 1 << 63, a + b - both, dtype=np.uint64) * np.uint64(2)
        if r.random() < 0.3:
            pool = pool >> np.uint64(r.integers(1, 12))  # crowded in few segments
        if len(np.unique(pool)) < len(pool):
            continue
        one, two = np.sort(pool[:a]), np.sort(pool[a - both :])
        assert linking.similar(one, two, percent / 100)
        assert set(jaccard_join.tile_keys(one, zones)) & set(jaccard_join.tile_keys(two, zones))


def test_bitmaps_never_lose_a_link():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 63, int(r.integers(1, 300)), dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[int(len(base) * 0.03 * k) :], r.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in range(4)]
    sets = sorted((s for s in sets if len(s)), key=len)
    sizes = np.array([len(s) for s in sets])
    maps = bitmaps.bitmaps(sets, bitmaps.width(int(sizes[-1])))
    kept = {(int(i), int(j)) for at, other in bitmaps.candidates(sizes, sizes, maps, maps, 90) for i, j in zip(at, other)}
    linked = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if linking.similar(sets[i], sets[j], 0.9)}
    signed = [bitmaps.signature(s) for s in sets]
    one_by_one = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if bitmaps.may_link(signed[i], signed[j], len(sets[i]), len(sets[j]), 90)}
    assert linked <= one_by_one and len(one_by_one) < len(linked) + 0.05 * len(sets) ** 2
    tile = [{"v": i, "label": i, "size": len(s), "bits": b} for i, (s, b) in enumerate(zip(sets, signed))]
    assert {(i, j) for i, j in linked if i < j} <= set(bitmaps.tile_candidates(tile, 90))
    assert linked <= kept and len(kept) < len(linked) + 0.05 * len(sets) ** 2


def test_size_bands_keep_linked_sizes_together(spark):
    sizes = [(a, b) for a in range(1, 300) for b in range(a, a * 10 // 9 + 1)]
    members = spark.createDataFrame([(1, i, s, i) for i, pair in enumerate(sizes) for s in pair], "bucket long, v long, size long, label long")
    met = jaccard_join.size_bands(members, 90).groupBy("v", "bucket").agg(F.count_distinct("size").alias("k"), F.count(F.lit(1)).alias("n"))
    assert met.where("n > 1").select("v").distinct().count() == len(sizes)


def test_block_pairs_once_and_in_many_tasks(spark):
    """50 blocks of one bucket: every two of them meet once, in strips that go to different tasks."""
    blocks = spark.range(50).selectExpr("7L AS bucket", "id AS part", "50L AS parts", "id AS rows")
    pairs = linking.block_pairs(blocks)
    got = Counter(tuple(sorted(r)) for r in pairs.collect())
    assert got == Counter({(i, j): 1 for j in range(50) for i in range(j)})
    dealt = blocks.selectExpr("floor(part / 8) AS strip", "bucket").distinct().repartition(16, "bucket", "strip").select(F.spark_partition_id().alias("p")).distinct()
    assert dealt.count() >= 4


def test_rows_behind_a_filter(spark):
    docs = spark.range(1000).selectExpr("if(id = 5, null, id) AS doc_id", "string(id) AS text")
    wanted = docs.where("doc_id % 7 = 0 OR doc_id IS NULL").selectExpr("doc_id", "1 AS v")
    for most in (0, 1000):
        got = common.rows_of(docs, wanted, "doc_id", most)
        assert got.columns == ["doc_id", "text", "v"] and sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text").collect())


def test_sets_are_those_of_the_texts():
    assert len(shingles(word_hashes("A b\tC a B c"), 3)) == 3 and len(shingles(word_hashes("one two"), 3)) == 1 and len(shingles(word_hashes(" \n"), 3)) == 0
