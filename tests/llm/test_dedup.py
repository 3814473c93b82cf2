"""Exact and near dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenrank.llm import exact_dedup, minhash
from lumenrank.llm.components import components
from tests.llm.conftest import odd_rows, prose


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), len(groups)


@pytest.mark.parametrize("options", [{}, {"block_chars": 7, "digest_bits": 3}, {"block_chars": 50, "digest_bits": 64}])
def test_exact_equals_brute_force(odd, options):
    if options.get("block_chars") == 7:
        odd = odd.where("length(text) < 1000 OR text IS NULL")
        rows = [r for r in odd_rows() if len(r[1] or "") < 1000]
    else:
        rows = odd_rows()
    got = exact_dedup.exact_dedup(odd, **options).collect()
    want, groups = brute_exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups


def test_exact_on_nothing(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets, parent = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        low = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
        out.update((rows[m][0], low, len(members)) for m in members)
    return out, len(groups)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_near_equals_brute_force(odd, monkeypatch, sent):
    """Texts are fetched for the same ids whether these are broadcast or joined by a shuffle."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", sent)
    got = minhash.near_duplicates(odd).collect()
    want, groups = brute_near(odd_rows())
    assert Counter((r["doc_id"], r["group_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups


def test_large_group_of_near_copies(spark):
    """One group, far larger than a block, and look-alikes below the limit."""
    import random

    r, rows = random.Random(5), []
    base = prose(9, 200).split()
    for i in range(120):
        own = list(base)
        for _ in range(r.randrange(1, 14)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16, tile=16).collect()
    want, _ = brute_near(rows)
    assert Counter((x["doc_id"], x["group_id"], x["group_size"]) for x in got) == want


def test_near_on_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = ids[:300], ids[60:]
    same = (minhash.dart_minhash(a, k=2048) == minhash.dart_minhash(b, k=2048)).mean()
    assert abs(same - 240 / 400) < 0.05
    wa, wb = rng.random(400) * 3 + 0.1, rng.random(400) * 3 + 0.1
    same = (minhash.dart_minhash(ids, wa, 2048) == minhash.dart_minhash(ids, wb, 2048)).mean()
    assert abs(same - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05
    assert len(minhash.dart_minhash(ids[:1], k=120)) == 120


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in range(100, 140))


def test_near_pairs_in_a_family_of_similar_texts(spark):
    """Texts of one template are at 0.77 to each other; each has one partner at 0.82, which many signatures outrank."""
    template = [f"t{i}" for i in range(100)]
    rows = [(2 * i + j, " ".join([f"o{i}x{j}y{k}" for k in range(11)] + [f"s{i}x{k}" for k in range(3)] + template)) for i in range(40) for j in range(2)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8, tile=8).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_every_link_to_a_hub_is_kept(spark):
    """Texts at 0.8 or more to one hub and below to each other are one group, whichever text a bucket starts from."""
    hub = [f"h{i}" for i in range(204)]
    rows = [(0, " ".join(hub))]
    for i in range(150):
        at = (i * 37) % 160
        own = hub[:at] + [f"x{i}y{k}" for k in range(17)] + hub[at + 17 :]
        rows.append((i + 1, " ".join(own)))
    want, groups = brute_near(rows)
    assert groups == 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=32, tile=32).collect()
    assert Counter((x["doc_id"], x["group_id"], x["group_size"]) for x in got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families_near_the_limit(spark, seed):
    """Families whose texts differ from their template by about the limit; brute force decides."""
    import random

    r, rows = random.Random(seed), []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(0, 5)):
                own[r.randrange(len(own))] = f"e{r.randrange(60)}"
            rows.append((len(rows), " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8, tile=8, block_bytes=4_000).collect()
    want, _ = brute_near(rows)
    assert Counter((x["doc_id"], x["group_id"], x["group_size"]) for x in got) == want


def test_blocks_link_each_two_components_once():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    rows = [{"v": bytes([i]), "label": bytes([i // 3]), "shingles": np.sort(rng.choice(pool, 330 + i, replace=False)).tobytes()} for i in range(40)]
    sets = [set(np.frombuffer(x["shingles"], np.uint64).tolist()) for x in rows]
    want = {(min(i, j) // 3, max(i, j) // 3) for i in range(40) for j in range(i) if i // 3 != j // 3 and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    got = minhash.block_links(rows[:25], rows[:25], 0.75) + minhash.block_links(rows[:25], rows[25:], 0.75) + minhash.block_links(rows[25:], rows[25:], 0.75)
    assert {tuple(sorted((a[0] // 3, b[0] // 3))) for a, b in got} == want and want


def test_scratch_is_cleared(spark, odd):
    import os

    from lumenrank.llm.common import clear_scratch, materialize
    from lumenrank.session import shared_folder

    materialize(odd.limit(1), "x")
    folder = f"{shared_folder(spark)}/lumenrank/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.listdir(folder)
    clear_scratch(spark)
    assert not os.path.exists(folder)
