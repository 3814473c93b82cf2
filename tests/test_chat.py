import json

from pyspark.sql import functions as F

from lumenrank.operators import chat

EVENTS = "conv_id int, seq int, type string, text string, name string, arguments string"


def test_fold_reply_and_blocks(spark):
    cols = "turn_id int, seq int, content string, reasoning string, call_index int, call_id string, call_name string, call_arguments string, finish_reason string, error string"
    rows = [(1, 2, "b", None, None, None, None, None, None, None), (1, 1, "a", "r", None, None, None, None, None, None), (1, 3, None, None, 0, "i", "f", '{"x":', None, None), (1, 4, None, None, 0, "", "", "1}", "tool_calls", None)]
    got = chat.fold_chunks(spark.createDataFrame(rows, cols)).first()
    assert (got["content"], got["reasoning"], got["finish_reason"]) == ("ab", "r", "tool_calls")
    assert tuple(got["tool_calls"][0]) == (0, "i", "f", '{"x":1}')
    events = spark.createDataFrame([(1, 1, "text", "a", None, None), (1, 2, "tool_call", None, "t", "{}"), (1, 3, "text", "b", None, None), (1, 4, "text", "c", None, None)], EVENTS)
    assert chat.final_reply(events).first()["reply"] == "bc"
    assert [(r["kind"], r["text"]) for r in chat.message_blocks(events).orderBy("block").collect()] == [("text", "a"), ("tool_call", ""), ("text", "bc")]


def test_frames_end_at_done_or_error(spark):
    rows = [(1, 1, "text", "a", None, None), (1, 2, "tool_call", None, "t", '{"q": "é"}'), (1, 3, "tool_call", None, "t", "[1]"), (2, 1, "error", "bad", None, None), (2, 2, "text", "late", None, None)]
    got = chat.reply_frames(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "seq").collect()
    data = [json.loads(r["frame"].removeprefix("data: ")) for r in got]
    assert data[:4] == [{"type": "text", "text": "a"}, {"type": "tool_call", "name": "t", "arguments": {"q": "é"}}, {"type": "tool_call", "name": "t", "arguments": {}}, {"type": "done"}]
    assert data[4:] == [{"type": "error", "message": "bad"}]


def test_parse_keeps_the_tail(spark):
    payloads, rest = chat.parse_frames(F.lit("data: a\ndata:b\n\n: c\n\ndata: ta"))
    row = spark.range(1).select(payloads.alias("p"), rest.alias("r")).first()
    assert row["p"] == ["a\nb"] and row["r"] == "data: ta"


def test_compaction_keeps_system_once(spark):
    rows = spark.createDataFrame([(1, t, "system" if t == 0 else "user") for t in range(8)], "conv_id int, turn int, role string")
    assert [r["turn"] for r in chat.compact_history(rows).orderBy("turn").collect()] == [0, 3, 4, 5, 6, 7]


def test_describe_call(spark):
    rows = spark.createDataFrame([("grep", {"pattern": "x"}), ("get_directory_listing", {"path": "."}), ("send_mail", {"to": "me"}), ("read_file", {})], "n string, a map<string,string>")
    assert [r[0] for r in rows.select(chat.describe_call(F.col("n"), F.col("a"))).collect()] == ["Looking for “x” in notes", "Listing the notes folder", "Using send mail: me", "Reading a note"]
