"""Language ID, PII, decontamination, scoring: brute force, held-out accuracy and odd inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import decontaminate, language_id, pii, ppm
from lumenrank.llm.fm_index import FMIndex, suffix_array
from tests.llm.conftest import odd_rows


def test_language_on_held_out_documents(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(documents).collect() if r["held_out"]]
    assert len(got) > 20 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)


def test_language_of_odd_rows(odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 10)} == {"und"}
    assert language_id.identify(none).count() == 0


def brute_grams(t):
    flat = [c if c.isalpha() else None for c in t.lower()]
    runs = [None]
    for c in [*flat, None]:
        if c is not None or runs[-1] is not None:
            runs.append(c)
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(runs) - n + 1):
            gram = tuple(runs[i : i + n])
            if any(gram) and (n < 3 or gram[1]):
                found[gram] += 1
    return found


def brute_code(gram):
    code = 0
    for c in gram:
        code = code << language_id.BITS | (ord(c) if c else language_id.EDGE)
    return code


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB éßИж漢𐐀 .1İ\n"), max_size=40))
def test_grams_are_those_of_the_code_points(text):
    want = {brute_code(g): n for g, n in brute_grams(text).items()}
    assert dict(zip(*(x.tolist() for x in language_id.grams(text)))) == want


def test_out_of_place_distances_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 3_000)
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").collect()[:60]
    totals = defaultdict(Counter)
    for r in rows:
        totals[r["lang"]].update({brute_code(g): n for g, n in brute_grams(r["text"]).items()})
    ranked = {lang: {c: i for i, (c, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:50])} for lang, own in totals.items()}
    profiles = language_id.learn(documents.sparkSession.createDataFrame(rows), most=50)
    assert profiles.languages == sorted(ranked)
    for r in rows[:20]:
        own = [c for c, _ in sorted(((brute_code(g), n) for g, n in brute_grams(r["text"]).items()), key=lambda x: (-x[1], x[0]))[:50]]
        want = [sum(abs(i - ranked[lang][c]) if c in ranked[lang] else 50 for i, c in enumerate(own)) for lang in sorted(ranked)]
        assert profiles.distances(r["text"])[0].tolist() == want


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab@.1290+-() _%é\n", "4929348385146306", "+1 (499) 555-6503", "a.b@c.de", "1.2.3.4"]), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    t = "".join(parts)
    assert pii.base_spans(t) == brute_spans(t)
    pii.candidates(t, pii.base_spans(t))


def random_field(seed):
    r = np.random.default_rng(seed)
    chain, skip = r.normal(size=(pii.LABELS, pii.LABELS)), r.normal(size=(pii.LABELS, pii.LABELS))
    return pii.Field(r.normal(size=(int(pii._OFFSETS[-1]), pii.LABELS)), chain + chain.T, skip + skip.T)


@pytest.mark.parametrize("text", ["call 555 123 4567 or write a@b or 20 30 40 50 60 70", "+1 (499) 555-6503, later (499) 555-6503, 777 888 99 00", "x@y 1234567 z@q.de 7654321 and 12.34.56.78"])
def test_marginals_equal_enumeration_where_the_graph_is_a_tree(text):
    """Sum-product is exact on trees; every labelling is summed here."""
    from itertools import product

    nodes, field = pii.candidates(text, pii.base_spans(text)), random_field(3)
    chain, skip = pii.edges(text, nodes)
    skip = [e for e in skip if e not in chain]
    assert 2 <= len(nodes) and len(chain) + len(skip) == len(nodes) - 1
    want = np.zeros((len(nodes), pii.LABELS))
    for labels in product(range(pii.LABELS), repeat=len(nodes)):
        if any(own >= 0 and own != x for (_, own, _), x in zip(nodes, labels)):
            continue
        total = sum(field.weights[pii._OFFSETS[:-1] + pii.features(text, a, b)].sum(axis=0)[x] for (a, own, b), x in zip(nodes, labels) if own < 0)
        total += sum(table[labels[i], labels[j]] for table, pairs in ((field.chain, pii.edges(text, nodes)[0]), (field.skip, pii.edges(text, nodes)[1])) for i, j in pairs)
        for i, x in enumerate(labels):
            want[i, x] += math.exp(total)
    assert field.marginals(text, nodes) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=2e-3)


def test_pseudo_likelihood_slopes_equal_differences():
    r, field = np.random.default_rng(0), random_field(1)
    x = np.array([pii._OFFSETS[:-1] + [r.integers(n) for n in pii.FEATURE_SIZES] for _ in range(12)])
    around, y, n = r.integers(0, 3, (12, 2, pii.LABELS)).astype(float), r.integers(0, pii.LABELS, 12), r.random(12)
    _, slopes = pii.gradient(field, x, around, y, n)
    for table, slope in zip((field.weights, field.chain, field.skip), slopes):
        for _ in range(5):
            at = (r.integers(table.shape[0]), r.integers(table.shape[1]))
            if table is field.weights:
                at = (x[0, 0], at[1])
            table[at] += 1e-5
            high = pii.gradient(field, x, around, y, n)[0]
            table[at] -= 2e-5
            low = pii.gradient(field, x, around, y, n)[0]
            table[at] += 1e-5
            assert (high - low) / 2e-5 == pytest.approx(slope[at], abs=1e-6)


def test_the_fit_follows_the_data():
    """Skip potentials are learned: where equal values have different labels, the field comes to prefer that."""
    own = tuple(0 for _ in pii.FEATURE_SIZES)
    same = [(own, tuple(int(i == pii.LABELS + k) for i in range(2 * pii.LABELS)), k, 50) for k in range(pii.LABELS)]
    other = [(own, tuple(int(i == pii.LABELS + (k + 1) % pii.LABELS) for i in range(2 * pii.LABELS)), k, 50) for k in range(pii.LABELS)]
    agree, differ = pii.fit(same).skip, pii.fit(other + [(own, tuple(int(i == pii.LABELS + (k - 1) % pii.LABELS) for i in range(2 * pii.LABELS)), k, 50) for k in range(pii.LABELS)]).skip
    assert np.diag(agree).min() >= pii.EQUAL and all(differ[k, (k + 1) % pii.LABELS] > differ[k, k] + 2 for k in range(pii.LABELS))


def test_skip_edges_spread_a_label(spark, odd, none):
    full, bare = "+1 (499) 555-6503", "(499) 555-6503"
    rows = [(i, f"call +1 (499) 555-{6000 + i} or write a{i}@b.example or pay 4929348385146306 from 10.0.0.{i}") for i in range(60)]
    rows += [(100 + i, f"order {10**9 + 7919 * i} of item {10**7 + i}") for i in range(60)]
    rows += [(500, f"ring {full} today and later {bare} again"), (501, f"ring {bare} today"), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[500]["n_phone"] == 1 and got[500]["spans"] == "phone:5:22,phone:39:53"
    assert got[3]["n_email"] == got[3]["n_card"] == got[3]["n_ip"] == got[3]["n_phone"] == 1
    assert not any(got[100 + i]["spans"] for i in range(60)) and got[502]["spans"] == ""
    assert pii.find_pii(odd).count() == len(odd_rows()) and pii.find_pii(none).count() == 0


def test_very_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "@" * 50_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.candidates(t, pii.base_spans(t))


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 600)
    text[rng.integers(0, 600, 30)] = 0
    text[-1] = 0
    order = suffix_array(text)
    assert sorted(order) == list(range(600))
    index = FMIndex(text.astype(np.int64), sample=7)
    for size in (1, 2, 5):
        for _ in range(30):
            p = rng.integers(1, 5, size)
            low, high = index.search(np.concatenate((np.zeros(5 - size, np.int64), p))[None, :], np.array([size]))
            want = [i for i in range(600 - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == want


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    w = word.findall((text or "").translate(low))
    hit, found = set(), set()
    for name, t in items:
        iw = word.findall((t or "").translate(low))
        m = min(13, len(iw))
        for i in range(len(iw) - m + 1 if iw else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == iw[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**9, 60])
def test_decontamination_equals_brute_force(spark, odd, block):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, "One, two: THREE"), (3, ""), (4, None), (5, "unseen words here"), (5, "mu1"), (2, "One, two: THREE")]
    rows = [(1, f"x y {passage.upper()} z"), (2, " ".join(passage.split()[:12])), (3, "a one-two three one two three b"), (4, None), (5, f"{passage} {passage}"), (6, " ".join(passage.split()[5:18]) + " pad" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, frame, block_chars=block).collect()}
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == (n, hit, found)
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert [tuple(s) for s in got[1]["spans"]] == [(4, 4 + len(passage))]
    assert decontaminate.decontaminate(odd, frame, block_chars=block).count() == len(odd_rows())


def test_decontamination_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(odd, empty).collect())
    assert decontaminate.decontaminate(none, empty).count() == 0


def test_scores_equal_brute_force(documents, spark):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(10**6, None), (None, "a b")]
    got = {r["doc_id"]: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), head=50).collect()}
    taught = [(i, t or "") for i, t in rows if zlib.crc32((str(i) if i is not None else "").encode()) % 10]
    words = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for _, t in taught for w in words(t))
    n, v = sum(counts.values()), len(counts)
    trie, order = defaultdict(Counter), ppm.ORDER
    for _, t in taught:
        z = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(z)):
            for k in range(order, -1, -1):
                trie[z[i - k : i]][z[i]] += 1
                if trie[z[i - k : i]][z[i]] > 1:
                    break
    for i, t in rows[:40] + rows[-2:]:
        r = got[i]
        assert r["n_tokens"] == len(words(t)) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in words(t))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), rel=1e-9)
        z, total = b"\xff" * order + (t or "").encode() + b"\xff", 0.0
        for at in range(order, len(z)):
            out = set()
            for k in range(order, -1, -1):
                own = {s: c for s, c in trie.get(z[at - k : at], {}).items() if s not in out}
                if not own:
                    continue
                whole = sum(own.values())
                if z[at] in own:
                    total += math.log10((own[z[at]] - 0.3) / whole)
                    break
                total += math.log10(0.3 * len(own) / whole)
                out |= own.keys()
            else:
                total -= math.log10(256 - len(out))
        assert r["score"] == pytest.approx(total, rel=1e-5, abs=1e-5)


def test_scores_do_not_depend_on_the_grams_of_a_pass(documents):
    docs = documents.select("doc_id", "text")
    whole = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    passes = ppm.score(docs, grams=20_000).collect()
    assert len(passes) == docs.count()
    for r in passes:
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-9)
        assert (r["base_score"], r["n_known"]) == (whole[r["doc_id"]]["base_score"], whole[r["doc_id"]]["n_known"])


def test_more_grams_than_any_bound_are_all_counted(spark, monkeypatch):
    """With tables of a few grams, broadcasts of one word and counts given on at once, no score changes."""
    rows = [(i, f"text {i} of {i * 7919 % 1000} words and {i * 31 % 17} more") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    got = {r["doc_id"]: r for r in ppm.score(docs, head=1, grams=300).collect()}
    assert all(got[i]["score"] == pytest.approx(want[i]["score"], rel=1e-6) and got[i]["base_score"] == pytest.approx(want[i]["base_score"], rel=1e-9) for i, _ in rows)


def test_adaptive_scores_of_rows(odd, none):
    rows = {(r["doc_id"], round(r["score"], 6)) for r in ppm.adaptive_scores(odd.where("text IS NULL OR length(text) < 2000")).collect()}
    assert {(i, round(ppm.adaptive_log10(t or ""), 6)) for i, t, *_ in odd_rows() if len(t or "") < 2000} == rows
    assert ppm.adaptive_scores(none).count() == 0


def test_adaptive_scores_learn():
    assert ppm.adaptive_log10("") < 0
    assert ppm.adaptive_log10("abcabcabc" * 20) / 180 > ppm.adaptive_log10("abcabcabc") / 9


def test_scores_of_odd_rows(odd, none):
    got = ppm.score(odd).collect()
    assert len(got) == len(odd_rows()) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert ppm.score(none).count() == 0


def test_held_out_texts_score_above_the_word_model(spark):
    got = ppm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]
