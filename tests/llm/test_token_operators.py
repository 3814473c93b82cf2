"""Tokens, packing, training order: exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrank.llm import packing, token_counts, tokens, training_order
from lumenrank.llm.common import materialize, scratch
from lumenrank.llm.tokens import default_path, encoder
from tests.llm.conftest import odd_rows


def plain(literal):
    found = tokenizers.Tokenizer.from_file(default_path())
    found.encode_special_tokens = literal
    return found


BY_DEFAULT, LITERAL = plain(False), plain(True)


def ids_of(text, by=LITERAL):
    return by.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "é", "'s", "12", ".", "<|endoftext|>", "漢", "\x1c", "\r\n"]), max_size=20))
def test_ids_are_the_tokenizers(parts):
    t = "".join(parts)
    assert np.frombuffer(encoder(default_path()).encode(t), "<u4").tolist() == ids_of(t, BY_DEFAULT)
    assert np.frombuffer(encoder(default_path(), literal=True).encode(t), "<u4").tolist() == ids_of(t)


def test_other_vocabularies_are_not_cut_to_two_bytes(spark, tmp_path):
    assert tokens.id_type(default_path(), 50256) == "<u2" and tokens.id_type(default_path(), 70_000) == "<u4"
    with pytest.raises(ValueError):
        tokens.narrowed(np.array([1, 70_000], "<u4").tobytes(), "<u2")
    other = default_path().replace("byte_bpe_50k", "word_bpe_49k")
    text = "Some words, and MORE of them <|endoftext|>"
    slow = tokenizers.Tokenizer.from_file(other)
    assert encoder(other)._fast is None
    assert np.frombuffer(encoder(other).encode(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_those_of_a_plain_tokenizer(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", "no such token", "<|endoftext |> <|x|>"]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*ids_of(t, plain(False)), 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_short_pieces_waste_little(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "") for i in range(3000)], "doc_id long, text string")
    got = packing.pack(docs).agg({"sequence_id": "max", "length": "sum"}).first()
    assert got[0] + 1 <= 3000 * packing.UNIT / 2048 + 1


def test_counts_equal_tokenizer(odd, none):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.document_token_counts(materialize(odd, "odd")).collect())
    assert got == Counter((r[0], len(ids_of(r[1]))) for r in odd_rows())
    assert token_counts.document_token_counts(none).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 1, 9, 2, 2], "<u2")
    (tmp_path / "part-000000.bin").write_bytes(ids.tobytes())
    (tmp_path / "part-000001.bin").write_bytes(b"")
    (tmp_path / "part-000002.bin").write_bytes(np.array([9], "<u2").tobytes())
    for block in (2, 4, 6, 1000):
        got = token_counts.count_tokens(spark, str(tmp_path), separator=9, block_bytes=block)
        rows = sorted((r["path"][-10:], r["ordinal"], r["n_tokens"], r["ended"]) for r in got.collect())
        assert rows == [("000000.bin", 0, 2, True), ("000000.bin", 1, 0, True), ("000000.bin", 2, 7, True), ("000000.bin", 3, 2, False), ("000002.bin", 0, 0, True)]


def test_packing_round_trip(odd, none):
    got = packing.pack(odd).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for rows in sequences.values():
        rows.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0 and sum(n for _, n in rows) <= 2048
    want = Counter()
    for i, t, *_ in odd_rows():
        ids = np.array([*ids_of(t), 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert pieces == want
    assert packing.pack(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_holds_the_demand(demand):
    sizes = sorted(demand)
    plan = packing.plan_patterns(sizes, [demand[s] for s in sizes], 64)
    held = Counter()
    for pattern, n in plan:
        assert sum(s * c for s, c in pattern.items()) <= 64
        for s, c in pattern.items():
            held[s] += c * n
    assert held == Counter(demand)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(3.2, 0.8, 20_000), 1, 128).astype(int)
    count = np.bincount(sizes)
    own = [s for s in range(len(count)) if count[s]]
    assert sum(n for _, n in packing.plan_patterns(own, [int(count[s]) for s in own], 128)) <= 1.02 * sizes.sum() / 128


def test_training_order_round_trip(spark, odd, none):
    folder = scratch(spark, "order")
    rows = training_order.materialise(odd.repartition(3), folder, sequence=64, shard_rows=8).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == sorted(r["index"] for r in rows) == list(range(n)) and n > 500
    order = training_order.Permutation(n, "epoch-0")
    assert all(order(np.array([r["index"]]))[0] == r["slot"] == r["shard"] * 8 + r["row"] for r in rows)
    held = training_order.read_slots(folder, 0, n + 5, 64, 8)
    assert held.shape == (n, 64) and (training_order.read_slots(folder, 5, 20, 64, 8) == held[5:25]).all()
    assert all(zlib.crc32(held[r["slot"]].tobytes()) == r["ids_crc32"] for r in rows)
    stream = np.concatenate([held[r["slot"]][: r["n_tokens"]] for r in sorted(rows, key=lambda r: r["index"])])
    docs_back = np.split(stream, np.flatnonzero(stream == training_order.END_ID) + 1)[:-1]
    assert Counter(d.tobytes() for d in docs_back) == Counter(np.array([*ids_of(r[1]), training_order.END_ID], "<u2").tobytes() for r in odd_rows())
    assert training_order.training_order(none).count() == 0


def test_wide_ids_are_written_whole(spark):
    folder = scratch(spark, "order")
    rows = training_order.materialise(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), folder, sequence=8, end_id=70_000).collect()
    assert training_order.read_slots(folder, 0, 1, 8, dtype="<u4")[0].tolist() == [*ids_of("a b c"), *[70_000] * (8 - len(ids_of("a b c")))] and len(rows) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_permutation(n):
    p = training_order.Permutation(n, "k")
    x = p(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()
    assert n < 100 or (training_order.Permutation(n, "other")(np.arange(n)) != x).any()


def wide_tokenizer(folder, end=None):
    """A word vocabulary of over 60,000 ids, in which 50256 is a word."""
    import json

    vocabulary = {"[UNK]": 0} | {f"w{i}": i for i in range(1, 60_001)}
    added = [] if end is None else [{"id": end, "content": "<end>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}}
    path = folder / f"wide{end}.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_an_ordinary_id_ends_no_document(spark, tmp_path):
    path, ended = wide_tokenizer(tmp_path), wide_tokenizer(tmp_path, 60_001)
    docs = spark.createDataFrame([(1, "w5 w50256 w7"), (2, ""), (3, "w50256 w60000")], "doc_id long, text string")
    with pytest.raises(ValueError, match="ordinary id"):
        token_counts.write_token_files(docs, str(tmp_path / "a"), path, separator=50256)
    with pytest.raises(ValueError, match="ordinary id"):
        training_order.materialise(docs, str(tmp_path / "b"), tokenizer_path=path, end_id=50256)
    for p in (path, ended):
        got = token_counts.document_token_counts(docs, p).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 3, 2: 0, 3: 2}
        placed = training_order.materialise(docs, str(tmp_path / f"c{p[-7:-5]}"), tokenizer_path=p, sequence=4, end_id=None)
        assert placed.agg({"n_tokens": "sum"}).first()[0] == 8
    assert tokens.end_of_document(path, None) == tokens.end_of_document(ended, None) == 60_001
    assert tokens.end_of_document(default_path(), None) == token_counts.END_OF_DOCUMENT == training_order.END_ID
