"""Streams: keyed ingest, and folding streamed chunks into messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenrank.config import TABLE_PREFIX
from lumenrank.functions.text import titled
from lumenrank.operators.keyed import first_rows, not_stored
from lumenrank.sources.notes import to_chunks
from lumenrank.sources.tables import KeyedTable


def keyed_ingest(rows: DataFrame, table_path: str, checkpoint: str, key: str = "id", order: str = "seq"):
    """Start a query that upserts each micro-batch into a ``KeyedTable``; run again, a batch changes nothing, and a row that is older than the stored one doesn't replace it."""

    def apply(batch: DataFrame, _: int) -> None:
        KeyedTable(batch.sparkSession, table_path, key).upsert(batch, order)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_name(encoder: str, title_prefix: bool = False) -> str:
    """The table of an encoder's vectors."""
    base = TABLE_PREFIX.get(encoder, f"chunks_{encoder.replace('-', '_')}")
    return f"{base}_title" if title_prefix else base


def ingest_notes(
    notes: DataFrame, folder: str, encoder: str, embed, limit: int | None = None, skip_existing: bool = False, title_prefix: bool = False,
) -> int:
    """Chunk notes (source, title, text), embed the chunks and put them into the encoder's table below ``folder``.

    ``embed`` is a function from a text column to vectors; Arrow batches are its unit. ``skip_existing`` leaves out
    chunks whose id is stored, so that a broken-off run goes on; ``limit`` takes the first chunks by source and
    place; ``title_prefix`` embeds the title with the text and stores the text alone. Returns the number of chunks put in.
    """
    table = KeyedTable(notes.sparkSession, f"{folder}/{table_name(encoder, title_prefix)}")
    chunks = to_chunks(notes)
    stored = table.read() if skip_existing else None
    if stored is not None:
        chunks = not_stored(chunks, stored)
    if limit is not None:
        chunks = first_rows(chunks, limit, "source", "chunk_index")
    text = titled(F.col("title"), F.col("text")) if title_prefix else F.col("text")
    return table.upsert(chunks.withColumn("vector", embed(text)))


def fold_turns(chunks: DataFrame) -> DataFrame:
    """(turn_id, content, finish_reason): a turn's text once its finish reason came.

    Input: (turn_id, seq, content, finish_reason). State holds only the unfinished turns' chunks.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, reason = state.get if state.exists else ([], [], None)
        seqs, texts = list(seqs), list(texts)
        for b in batches:
            for row in b.itertuples():
                seqs.append(int(row.seq))
                texts.append(row.content or "")
                reason = row.finish_reason or reason
        if reason is None:
            state.update((seqs, texts, reason))
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"turn_id": [key[0]], "content": ["".join(t for _, t in sorted(zip(seqs, texts)))], "finish_reason": [reason]})

    return chunks.groupBy("turn_id").applyInPandasWithState(
        fold, "turn_id long, content string, finish_reason string", "seqs array<long>, texts array<string>, reason string", "append", GroupStateTimeout.NoTimeout
    )
