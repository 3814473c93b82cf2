"""Stateful streams against their batch forms, for random cuts, orders, repeats and micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import chat
from lumenrank.streaming import stateful

CHUNKS = "turn_id long, seq long, content string, reasoning string, call_index int, call_id string, call_name string, call_arguments string, finish_reason string, error string"


def streamed(spark, tmp_path, rows, schema, fold, name, batches=3, seed=1, **options):
    """Deal rows to micro-batches at random, some of them twice, and run the stream over them; then one more batch of ``after``."""
    r, dealt = random.Random(seed), [[] for _ in range(batches)]
    for row in rows:
        at = r.randrange(batches)
        dealt[at].append(row)
        if r.random() < 0.2:
            dealt[r.randrange(at, batches)].append(row)
    stateful.use_state_store(spark)
    folder = str(tmp_path / name)
    for part in dealt:
        write(spark, part, schema, folder)
    return drained(spark, fold, schema, folder, tmp_path, name, **options)


def write(spark, rows, schema, folder, at="2024-01-01 00:00:00"):
    spark.createDataFrame(rows, schema).withColumn("at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, fold, schema, folder, tmp_path, name, **options):
    """All rows that came out once the stream has taken all files; run again, it goes on where it ended."""
    kinds = spark.createDataFrame([], schema).withColumn("at", F.current_timestamp()).schema
    out = fold(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder), **options)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    ended = query.awaitTermination(100)
    query.stop()
    assert ended and query.exception() is None
    return spark.read.schema(out.schema).parquet(str(tmp_path / f"{name}-out"))


def test_any_cutting_gives_the_frames_of_the_whole(spark, tmp_path):
    r, rows, whole = random.Random(6), [], []
    for stream in range(5):
        body = "".join(r.choice(["data: a é 漢\n\n", "data:b\ndata: c\n\n", ": note\n\n", "id: 1\ndata:\n\n", "\n\n", "data: \U0001f600 x\n\n"]) for _ in range(r.randrange(1, 14))) + r.choice(["", "data: tail", "data"])
        whole.append((stream, body))
        data, cuts = body.encode(), sorted(r.randrange(len(body.encode()) + 1) for _ in range(8))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rows += [(stream, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    got = streamed(spark, tmp_path, rows, "stream_id long, seq long, piece binary, last boolean", stateful.decode_frames, "frames")
    payloads, _ = chat.parse_frames(F.col("body"))
    want = spark.createDataFrame(whole, "stream_id long, body string").select("stream_id", F.posexplode(payloads).alias("ordinal", "payload"))
    assert sorted(map(tuple, got.select("stream_id", "ordinal", "payload").collect())) == sorted(map(tuple, want.collect()))
    assert {x["status"] for x in got.collect()} <= {"frame"}


def chunk(turn, seq, content=None, reasoning=None, call=(None, None, None, None), finish=None, error=None):
    return (turn, seq, content, reasoning, *call, finish, error)


def turns():
    r, rows = random.Random(3), []
    for turn in range(6):
        n = r.randrange(2, 9)
        for seq in range(n):
            kind = r.randrange(3)
            call = (r.randrange(2), r.choice(["", "i"]), r.choice(["", f"f{seq}"]), r.choice(["", "{", "1}", None])) if kind == 2 else (None,) * 4
            rows.append(chunk(turn, seq, r.choice(["", "a", "bé"]) if kind == 0 else None, "r" if kind == 1 else None, call, "stop" if seq == n - 1 else None))
    return rows


def test_messages_equal_the_batch_fold(spark, tmp_path):
    rows = turns()
    late = [chunk(0, 0, "late")]  # a piece that was taken long ago
    got = streamed(spark, tmp_path, [*rows, *late], CHUNKS, stateful.fold_messages, "messages")
    want = chat.fold_chunks(spark.createDataFrame(rows, CHUNKS))
    columns = ["turn_id", "content", "reasoning", "finish_reason", "tool_calls"]
    key = lambda df: sorted((tuple(map(str, x)) for x in df.select(*columns).collect()))
    assert key(got) == key(want) and {x["status"] for x in got.collect()} == {"done"}


def test_errors_end_their_turn_and_idle_keys_end(spark, tmp_path):
    """The other turns go on; what never gets done says so once the watermark has passed, and later pieces of what is done start nothing."""
    rows = [chunk(1, 0, "a"), chunk(1, 1, error="broke"), chunk(1, 2, "late"), chunk(2, 0, "b", finish="stop"), chunk(3, 0, "half"), chunk(3, 2, "gap")]
    got = streamed(spark, tmp_path, rows, CHUNKS, stateful.fold_messages, "errors", batches=1)
    key = lambda df: sorted(map(str, df.select("turn_id", "status", "content", "error").collect()))
    done = [(1, "error", "a", "broke"), (2, "done", "b", None)]
    want = lambda rows: sorted(map(str, spark.createDataFrame(rows, "turn_id long, status string, content string, error string").collect()))
    assert key(got) == want(done)
    write(spark, [chunk(2, 1, "later"), chunk(1, 0, "again")], CHUNKS, str(tmp_path / "errors"))
    write(spark, [chunk(9, 0, "x", finish="stop")], CHUNKS, str(tmp_path / "errors"), "2024-01-03 00:00:00")
    got = drained(spark, stateful.fold_messages, CHUNKS, str(tmp_path / "errors"), tmp_path, "errors")
    assert key(got) == want([*done, (3, "abandoned", "half", None), (9, "done", "x", None)])


@pytest.mark.parametrize("batches", [1, 3])
def test_blocks_equal_the_batch_form(spark, tmp_path, batches):
    r, rows = random.Random(11), []
    for conv in range(4):
        for seq in range(r.randrange(1, 9)):
            call = r.random() < 0.3
            rows.append((conv, seq, "tool_call" if call else "text", None if call else r.choice("abc"), f"t{seq}" if call else None))
        rows.append((conv, 100, r.choice(["done", "error"]), None, None))
    last = {}
    for row in rows:
        last[row[0]] = max(last.get(row[0], -1), row[1] if row[1] < 100 else -1)
    rows = [(c, last[c] + 1 if s == 100 else s, *rest) for c, s, *rest in rows]
    schema = "conv_id long, seq long, type string, text string, name string"
    got = streamed(spark, tmp_path, rows, schema, stateful.fold_blocks, f"blocks{batches}", batches=batches)
    want = chat.message_blocks(spark.createDataFrame(rows, schema))
    columns = ["conv_id", "block", "kind", "text", "name"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
