"""Conversations and event streams: folds, pruning, shaping, and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_LAST = 5
# Wording of tool calls, and which argument names them.
DETAIL_KEYS = ("query", "pattern", "filename", "path")
CALL_WORDING = {
    "search_notes": ("Searching notes for “%s”", "Searching notes"),
    "grep": ("Looking for “%s” in notes", "Looking through notes"),
    "read_file": ("Reading %s", "Reading a note"),
    "get_directory_listing": ("Listing %s", "Listing the notes folder"),
}


def _in_order(seq: str, value: Column, keep: Column) -> Column:
    """An aggregate: values of the kept rows as an array in order of ``seq``."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(seq).alias("s"), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """One message per turn from streamed chunks (turn_id, seq, content, reasoning, call_index, call_id, call_name, call_arguments, finish_reason, error).

    Text and reasoning are concatenated (null where there is none); a call's name and id are the
    last given, its arguments concatenated, calls in order of index; the last finish reason
    counts. A chunk with an error fails the job.
    """
    safe = chunks.withColumn("content", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("model error: "), "error"))).otherwise(F.col("content")))
    text = F.array_join(_in_order("seq", F.col("content"), F.col("content").isNotNull()), "")
    thought = F.array_join(_in_order("seq", F.col("reasoning"), F.col("reasoning").isNotNull()), "")
    turns = safe.groupBy("turn_id").agg(
        F.nullif(text, F.lit("")).alias("content"), F.nullif(thought, F.lit("")).alias("reasoning"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason")
    )
    some = lambda c: F.when(F.length(c) > 0, F.col("seq"))
    calls = safe.where("call_index IS NOT NULL").groupBy("turn_id", "call_index").agg(
        F.coalesce(F.max_by("call_id", some("call_id")), F.lit("")).alias("id"), F.coalesce(F.max_by("call_name", some("call_name")), F.lit("")).alias("name"),
        F.array_join(_in_order("seq", F.col("call_arguments"), F.col("call_arguments").isNotNull()), "").alias("arguments"),
    )
    listed = calls.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("call_index", "id", "name", "arguments"))).alias("tool_calls"))
    return turns.join(listed, "turn_id", "left")


def final_reply(events: DataFrame) -> DataFrame:
    """(conv_id, reply): the text after the last tool call, of events (conv_id, seq, type, text)."""
    last = F.max(F.when(F.col("type") == "tool_call", F.col("seq"))).over(Window.partitionBy("conv_id"))
    rows = events.withColumn("last_call", last)
    keep = (F.col("type") == "text") & (F.col("last_call").isNull() | (F.col("seq") > F.col("last_call")))
    return rows.groupBy("conv_id").agg(F.array_join(_in_order("seq", F.col("text"), keep), "").alias("reply"))


def prune_history(messages: DataFrame, stub: Column) -> DataFrame:
    """Tool results that have a summary and did not fail get the stub as content."""
    return messages.withColumn("content", F.when((F.col("role") == "tool") & F.col("summarised") & F.col("ok"), stub).otherwise(F.col("content")))


def compact_history(messages: DataFrame, keep: int = KEEP_LAST) -> DataFrame:
    """The system message and the last ``keep`` messages of each conversation; no row twice."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).where((F.col("back") <= keep) | (F.col("role") == "system")).drop("back")


def split_instructions(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, type, content): system rows as instructions, tool rows as responses, the rest as text parts; empty texts make no part."""
    kind = F.when(F.col("role") == "tool", "tool_call_response").otherwise("text")
    part = F.when(F.col("role") == "system", "instruction").otherwise("message")
    rows = messages.select("conv_id", "turn", part.alias("part"), "role", kind.alias("type"), F.when(F.col("role") == "system", F.coalesce("text", F.lit(""))).otherwise(F.col("text")).alias("content"))
    return rows.where(F.col("role").isin("system", "tool") | (F.length("content") > 0))


def payload(kind: Column, text: Column, name: Column, arguments: Column) -> Column:
    """An event's JSON; arguments that are no JSON object count as an empty one."""
    asked = F.when(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.try_parse_json(arguments)).otherwise(F.parse_json(F.lit("{}")))
    return F.when(kind == "text", F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))).otherwise(
        F.to_json(F.struct(F.lit("tool_call").alias("type"), name.alias("name"), asked.alias("arguments")))
    )


def frame(data: Column) -> Column:
    return F.concat(F.lit("data: "), data, F.lit("\n\n"))


def reply_frames(events: DataFrame) -> DataFrame:
    """(conv_id, seq, frame): a frame per event; then done, or, at the first error, an error frame and no more."""
    first = F.min(F.when(F.col("type") == "error", F.col("seq"))).over(Window.partitionBy("conv_id"))
    rows = events.withColumn("failed", first).where(F.col("failed").isNull() | (F.col("seq") <= F.col("failed")))
    error = F.to_json(F.struct(F.lit("error").alias("type"), F.col("text").alias("message")))
    data = F.when(F.col("type") == "error", error).otherwise(payload(F.col("type"), F.col("text"), F.col("name"), F.col("arguments")))
    frames = rows.select("conv_id", "seq", frame(data).alias("frame"))
    done = rows.groupBy("conv_id").agg(F.max("seq").alias("seq"), F.max("failed").alias("failed")).where("failed IS NULL")
    return frames.unionByName(done.select("conv_id", (F.col("seq") + 1).alias("seq"), frame(F.lit('{"type":"done"}')).alias("frame")))


def parse_frames(buffer: Column) -> tuple[Column, Column]:
    """Payloads of the complete frames of a buffer, and the unfinished tail."""
    frames = F.split(buffer, "\n\n", -1)
    whole = F.slice(frames, 1, F.size(frames) - 1)

    def data(one: Column) -> Column:
        lines = F.filter(F.split(one, "\n", -1), lambda line: line.startswith("data:"))
        return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda line: F.regexp_replace(F.substring(line, 6, 1 << 30), "^ ", "")), "\n"))

    return F.filter(F.transform(whole, data), lambda x: x.isNotNull()), F.element_at(frames, -1)


def message_blocks(events: DataFrame) -> DataFrame:
    """(conv_id, block, kind, text, name): consecutive texts are one block, each tool call is its own."""
    by = Window.partitionBy("conv_id").orderBy("seq")
    starts = ((F.col("type") == "tool_call") | ~F.lag("type").over(by).eqNullSafe(F.col("type"))).cast("int")
    rows = events.where(F.col("type").isin("text", "tool_call")).withColumn("starts", starts).withColumn("block", F.sum("starts").over(by))
    text = F.array_join(_in_order("seq", F.col("text"), F.col("type") == "text"), "")
    return rows.groupBy("conv_id", "block").agg(F.min("type").alias("kind"), text.alias("text"), F.min("name").alias("name"))


def message_status(events: DataFrame) -> DataFrame:
    """(conv_id, status): failed at an error, done at a done, else streaming."""
    has = lambda kind: F.max((F.col("type") == kind).cast("int")) == 1
    return events.groupBy("conv_id").agg(F.when(has("error"), "error").when(has("done"), "done").otherwise("streaming").alias("status"))


def describe_call(name: Column, arguments: Column) -> Column:
    """A line on a tool call; ``arguments`` is map<string,string>."""
    named = F.coalesce(*(F.nullif(arguments[k], F.lit("")) for k in DETAIL_KEYS), F.get(F.filter(F.map_values(arguments), lambda v: F.length(v) > 0), F.lit(0)))
    verb = F.concat(F.lit("Using "), F.replace(name, F.lit("_"), F.lit(" ")))
    out = F.when(named.isNotNull(), F.concat(verb, F.lit(": "), named)).otherwise(verb)
    for tool, (with_, without) in CALL_WORDING.items():
        there = named.isNotNull() & (named != ".") if tool == "get_directory_listing" else named.isNotNull()
        out = F.when(name == tool, F.when(there, F.format_string(with_, named)).otherwise(without)).otherwise(out)
    return out
