"""Stored sequences of the training order lie in blocks."""

import random

import numpy as np
import pyarrow as pa

from lumenrank.llm import training_order
from lumenrank.llm.tokens import default_path, end_of_document


def test_stored_blocks_take_less_and_lose_nothing(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randrange(0, 900)))) for i in range(120)], "doc_id long, text string").coalesce(2)
    path = default_path()
    rows = training_order._sequences(docs, path, 256, end_of_document(path, None), "<u2").collect()
    packed, stored, apart = pa.Codec("zstd", compression_level=training_order.LEVEL), 0, 0
    places = {}
    for r in rows:
        n = len(r["n_tokens"])
        data = packed.decompress(bytes(r["ids"]), n * 512, asbytes=True)
        assert 1 <= n <= training_order.BLOCK and len(r["doc_ids"]) == n and r["i"] % training_order.BLOCK == 0
        places.setdefault(r["p"], []).extend(range(r["i"], r["i"] + n))
        stored += len(r["ids"])
        apart += sum(len(packed.compress(data[i : i + 512])) for i in range(0, len(data), 512))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert stored < 0.9 * apart
    folder = training_order.scratch(spark, "blocks")
    got = training_order.materialise(docs, folder, sequence=256, shard_rows=32).collect()
    assert len(got) == sum(map(len, places.values())) and sorted(r["slot"] for r in got) == list(range(len(got)))
    held = training_order.read_slots(folder, 0, len(got), 256, 32)
    order = training_order.Permutation(len(got), "epoch-0")
    whole = b"".join(packed.decompress(bytes(r["ids"]), len(r["n_tokens"]) * 512, asbytes=True) for r in sorted(rows, key=lambda r: (r["p"], r["i"])))
    assert (held[order(np.arange(len(got)))] == np.frombuffer(whole, "<u2").reshape(-1, 256)).all()
