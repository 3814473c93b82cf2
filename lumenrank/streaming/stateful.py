"""Stateful streams: frames from a cut byte stream, messages from model chunks, blocks from chat events.

The pieces of a stream (or turn, or conversation) carry a key and consecutive numbers from ``first`` on. They may be cut
anywhere, spread over micro-batches in any way, come out of order and come twice: each is taken once, in order, and what comes
too early waits in state. The results are those of the batch forms ``chat.parse_frames``, ``chat.fold_chunks``
and ``chat.message_blocks`` over the whole input.

State of a key: the next number and a few small values, a map of pieces that came early, and a list of texts, which is only
appended to. When a key is done, its map and list go at once; a mark stays, so that a late piece starts nothing anew, until the
watermark is ``idle_ms`` past the key's last piece. The same timer ends keys that never get done: they give a row that says so. So state
ends empty. Pieces carry their time (``at``); those that are behind the watermark by more than ``delay`` don't count.

The state store must be RocksDB (``use_state_store``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_MS, DELAY = 600_000, "10 minutes"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CALLS = "array<struct<call_index: int, id: string, name: string, arguments: string>>"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _plain(row: dict) -> dict:
    """Values that JSON has; bytes one character each."""
    return {k: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else bytes(v).decode("latin-1") if isinstance(v, bytes | bytearray) else v.item() if hasattr(v, "item") else v for k, v in row.items()}


class Ordered(StatefulProcessor):
    """Takes the pieces of a key once and in order; what to do with one is for ``take``, ``finish`` and ``abandon``."""

    columns: tuple[str, ...] = ()

    def __init__(self, idle_ms: int, first: int):
        self.idle_ms, self.first = idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, done boolean, seen long, small string")
        self.early = handle.getMapState("early", "seq long", "piece string")
        self.parts = handle.getListState("parts", "kind string, name string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.at.get() if self.at.exists() else None
        next_, done, seen, small = (*held[:3], json.loads(held[3])) if held else (self.first, False, 0, {})
        pieces: dict[int, dict] = {}
        for frame in rows:
            for row in frame.to_dict("records"):
                seen = max(seen, int(row["ms"]))
                pieces.setdefault(int(row["seq"]), _plain({c: row[c] for c in self.columns}))
        out: list[dict] = []
        self.fresh: list[tuple] = []
        for seq in sorted(pieces):
            if done or seq < next_:
                continue
            if seq > next_:
                if not self.early.containsKey((seq,)):
                    self.early.updateValue((seq,), (json.dumps(pieces[seq]),))
                continue
            piece: dict | None = pieces[seq]
            while piece is not None and not done:
                done = self.take(small, piece, out)
                next_ += 1
                piece = pieces.get(next_)
                if self.early.containsKey((next_,)):
                    piece = piece or json.loads(self.early.getValue((next_,))[0])
                    self.early.removeKey((next_,))
        if done:
            self.parts.clear()
            self.early.clear()
            small = {}
        elif self.fresh:
            self.parts.appendList(self.fresh)
        self.at.update((next_, done, seen, json.dumps(small)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(seen + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self.at.get() if self.at.exists() else None, []
        self.fresh = []
        if held and not held[1]:
            self.abandon(json.loads(held[3]), out)
        self.at.clear()
        self.early.clear()
        self.parts.clear()
        yield from self._frames(key, out)

    def _frames(self, key, out: list[dict]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), **{c: pd.Series([r[c] for r in out], dtype=object) for c in out[0]}})

    def texts(self) -> list[tuple]:
        """What was put away so far: (kind, name, text)."""
        return [*((tuple(r)) for r in self.parts.get()), *self.fresh] if self.parts.exists() else list(self.fresh)

    def forget(self) -> None:
        self.parts.clear()
        self.fresh = []

    def take(self, small: dict, piece: dict, out: list[dict]) -> bool:
        """Use one piece; whether it was the key's last."""
        raise NotImplementedError

    def abandon(self, small: dict, out: list[dict]) -> None:
        """Say that the key ends without its last piece."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Frames(Ordered):
    columns = ("piece", "last")

    def take(self, small: dict, piece: dict, out: list[dict]) -> bool:
        text = small.get("tail", "") + (piece["piece"] or "")
        *whole, tail = text.split("\n\n")
        for frame in whole:
            lines = [line[5:].removeprefix(" ") for line in frame.split("\n") if line.startswith("data:")]
            if lines:
                out.append(self._row(small, "\n".join(lines).encode("latin-1").decode("utf-8", "replace"), "frame"))
        small["tail"] = tail
        return bool(piece["last"])

    def _row(self, small: dict, payload: str | None, kind: str) -> dict:
        small["n"] = small.get("n", -1) + 1
        return {"ordinal": small["n"], "payload": payload, "status": kind}

    def abandon(self, small: dict, out: list[dict]) -> None:
        out.append(self._row(small, None, "abandoned"))


class _Messages(Ordered):
    columns = ("content", "reasoning", "call_index", "call_id", "call_name", "call_arguments", "finish_reason", "error")

    def take(self, small: dict, piece: dict, out: list[dict]) -> bool:
        if piece["error"] is not None:
            out.append(self._row(small, "error", piece["error"]))
            return True
        if piece["content"]:
            self.fresh.append(("content", "", piece["content"]))
        if piece["reasoning"]:
            self.fresh.append(("reasoning", "", piece["reasoning"]))
        if piece["call_index"] is not None:
            calls = small.setdefault("calls", {})
            call = calls.setdefault(str(int(piece["call_index"])), ["", ""])
            call[:] = piece["call_id"] or call[0], piece["call_name"] or call[1]
            if piece["call_arguments"]:
                self.fresh.append(("arguments", str(int(piece["call_index"])), piece["call_arguments"]))
        if piece["finish_reason"] is not None:
            small["reason"] = piece["finish_reason"]
            out.append(self._row(small, "done", None))
            return True
        return False

    def _row(self, small: dict, status: str, error: str | None) -> dict:
        held: dict[tuple[str, str], list[str]] = {}
        for kind, name, text in self.texts():
            held.setdefault((kind, name), []).append(text)
        joined = {k: "".join(v) for k, v in held.items()}
        calls = [{"call_index": int(i), "id": c[0], "name": c[1], "arguments": joined.get(("arguments", i), "")} for i, c in sorted(small.get("calls", {}).items(), key=lambda x: int(x[0]))]
        return {"content": joined.get(("content", "")), "reasoning": joined.get(("reasoning", "")), "finish_reason": small.get("reason"), "tool_calls": calls or None, "status": status, "error": error}

    def abandon(self, small: dict, out: list[dict]) -> None:
        out.append(self._row(small, "abandoned", None))


class _Blocks(Ordered):
    columns = ("type", "text", "name")

    def take(self, small: dict, piece: dict, out: list[dict]) -> bool:
        kind = piece["type"]
        if kind == "tool_call" or kind != small.get("kind"):
            self._flush(small, out)
        small["kind"] = kind
        if kind in ("done", "error"):
            return True
        if kind == "text" and piece["text"]:
            self.fresh.append(("text", "", piece["text"]))
        if small.get("name") is None or piece["name"] is not None and piece["name"] < small["name"]:
            small["name"] = piece["name"]
        return False

    def _flush(self, small: dict, out: list[dict]) -> None:
        if small.get("kind") in ("text", "tool_call"):
            small["block"] = small.get("block", 0) + 1
            out.append({"block": small["block"], "kind": small["kind"], "text": "".join(t for _, _, t in self.texts()), "name": small.get("name")})
        self.forget()
        small.pop("name", None)

    def abandon(self, small: dict, out: list[dict]) -> None:
        self._flush(small, out)


def _run(pieces: DataFrame, key: str, processor: Ordered, delay: str, out: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", pieces.schema[key].dataType), *T.StructType.fromDDL(out).fields])
    rows = pieces.withWatermark("at", delay).select(key, "seq", "at", F.unix_millis("at").alias("ms"), *processor.columns)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime").withColumnRenamed("key", key)


def decode_frames(pieces: DataFrame, idle_ms: int = IDLE_MS, first: int = 0, delay: str = DELAY) -> DataFrame:
    """(stream_id, ordinal, payload, status) of server-sent frames from (stream_id, seq, at, piece, last); ``piece`` is bytes, cut anywhere, within characters too.

    A payload comes as soon as its frame is whole; frames without data give none. What follows the last whole frame when ``last`` is true is no frame.
    A stream that is ``idle_ms`` behind the watermark gives one row more, with status abandoned.
    """
    return _run(pieces, "stream_id", _Frames(idle_ms, first), delay, "ordinal long, payload string, status string")


def fold_messages(chunks: DataFrame, idle_ms: int = IDLE_MS, first: int = 0, delay: str = DELAY) -> DataFrame:
    """(turn_id, content, reasoning, finish_reason, tool_calls, status, error): a turn's message, once, when all its chunks up to the finish reason have come.

    A chunk with an error ends its turn with status error and what came before it; the other turns go on. A turn that is ``idle_ms`` behind the watermark gives
    what came in order, with status abandoned.
    """
    return _run(chunks, "turn_id", _Messages(idle_ms, first), delay, f"content string, reasoning string, finish_reason string, tool_calls {CALLS}, status string, error string")


def fold_blocks(events: DataFrame, idle_ms: int = IDLE_MS, first: int = 0, delay: str = DELAY) -> DataFrame:
    """(conv_id, block, kind, text, name) from events (conv_id, seq, at, type, text, name): a block comes when the next one starts, at a done or an error, or after ``idle_ms``."""
    return _run(events, "conv_id", _Blocks(idle_ms, first), delay, "block long, kind string, text string, name string")
