"""Training-order materialisation: a keyed permutation of all sequences, written as fixed-stride shards.

Documents become ids (each ends with the end id) and, within an input partition, sequences of
``SEQUENCE`` ids; a partition's last sequence is padded with the end id. Sequences are stored with
their partition and their place in it, and counted; prefix sums over the partitions number them
without gaps. A keyed Feistel network permutes these numbers (where its power-of-four domain
is larger, it is walked until it lands inside), and the permuted number is the
sequence's global slot. Slots are dealt in ranges: shard s holds slots s * SHARD_ROWS and on, in
order, and is rows of one width and nothing else, so anyone who has the key knows the place of
any sequence, and a reader resumes from a slot number.

Scale: texts are tokenised once and sequences shuffled once, by range of slots. Shards have
a fixed size that is a parameter; hot keys can't exist, as the permutation spreads rows.
The driver gets one number for each input partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import discard, id_and_text, materialize, scratch, slices
from lumenrank.llm.storage import committed, read_range
from lumenrank.llm.tokens import default_path, encoder, end_of_document, id_type, narrowed

SEQUENCE = 2048
END_ID = 50256
ROUNDS = 6
#: Rows of a shard; the last has what is left.
SHARD_ROWS = 8_192
#: Sequences are stored and shuffled compressed, at this level.
LEVEL = 6
#: Sequences that are stored together, compressed as one: 16 take an eighth less than apart.
BLOCK = 16
#: Tasks that write shards, at most; each then writes several in order.
WRITERS = 20_000


class Permutation:
    """A keyed bijection of range(n): balanced Feistel network with cycle-walking."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n, self.half = max(1, n), max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        if back:
            for key in reversed(self.keys):
                left, right = right ^ self._round(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (over := np.flatnonzero(out >= self.n)).size:
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def _sequences(docs: DataFrame, path: str, sequence: int, end_id: int, dtype: str) -> DataFrame:
    """(p, i, ids, n_tokens, doc_ids): blocks of up to ``BLOCK`` sequences of input partition p from number i on: their ids, compressed together, and of each how many are real and whose they are."""
    width = sequence * np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, p, packed = encoder(path, literal=True).encode, TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=LEVEL)
        end = np.array([end_id], dtype).tobytes()
        held, owners, done, id_kind = bytearray(), [], 0, None
        pieces: list[bytes] = []
        ids: list[list] = []
        real: list[int] = []

        def out(most: int) -> pa.RecordBatch:
            """The first ``most`` sequences that wait."""
            nonlocal done
            starts = range(0, most, BLOCK)
            ends = pa.array([*starts, most], pa.int32())
            data = pa.array([packed.compress(b"".join(pieces[s : min(s + BLOCK, most)]), asbytes=True) for s in starts], pa.binary())
            counts = pa.ListArray.from_arrays(ends, pa.array(real[:most], pa.int64()))
            own = pa.ListArray.from_arrays(ends, pa.array(ids[:most], pa.list_(id_kind)))
            columns = [pa.array([p] * len(starts), pa.int64()), pa.array([done + s for s in starts], pa.int64()), data, counts, own]
            done += most
            del pieces[:most], ids[:most], real[:most]
            return pa.RecordBatch.from_arrays(columns, ["p", "i", "ids", "n_tokens", "doc_ids"])

        for batch in slices(batches, "text", 4_000_000):
            id_kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data, at = narrowed(encode(text), dtype) + end, 0
                while at < len(data):
                    take = min(len(data) - at, width - len(held))
                    held += data[at : at + take]
                    owners.append(doc)
                    at += take
                    if len(held) == width:
                        pieces.append(bytes(held))
                        ids.append(owners)
                        real.append(sequence)
                        held, owners = bytearray(), []
            if len(pieces) >= BLOCK:
                yield out(len(pieces) // BLOCK * BLOCK)
        if held:
            real.append(len(held) // len(end))
            pieces.append(bytes(held) + end * (sequence - real[-1]))
            ids.append(owners)
        if pieces:
            yield out(len(pieces))

    fields = [("p", T.LongType()), ("i", T.LongType()), ("ids", T.BinaryType()), ("n_tokens", T.ArrayType(T.LongType())), ("doc_ids", T.ArrayType(T.ArrayType(docs.schema["doc_id"].dataType)))]
    return materialize(docs.mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in fields])), "sequences")


def materialise(
    docs: DataFrame, folder: str, key: str = "epoch-0", tokenizer_path: str | None = None, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS, end_id: int | None = None
) -> DataFrame:
    """Write the shards under ``folder``; one row per sequence: slot, shard, row, n_tokens, ids_crc32, index, doc_ids.

    ``n_tokens`` leaves padding out and the checksum keeps it in. ``doc_ids`` are the documents with ids in the sequence, in order.
    The slot of number ``index`` is ``Permutation(rows, key)(index)``. Ids take two bytes where the vocabulary
    and the end id fit, else four; strings of added tokens are ordinary text. Null text is the empty text, one end
    id; an end id that is an ordinary id of the vocabulary raises, and without one it is ``tokens.end_of_document``. Repeated rows and null ids are written each. An empty table writes nothing; other columns are not read.
    """
    path = tokenizer_path or default_path()
    end_id = end_of_document(path, end_id)
    dtype = id_type(path, end_id)
    sequences = _sequences(id_and_text(docs), path, sequence, end_id, dtype)
    counts = sorted((r["p"], r["n"]) for r in sequences.groupBy("p").agg(F.sum(F.size("n_tokens")).alias("n")).collect())  # a row for each input partition
    numbers, before = np.array([p for p, _ in counts], np.int64), np.concatenate(([0], np.cumsum([n for _, n in counts], dtype=np.int64)))
    total = int(before[-1])
    order = Permutation(total, key)
    shards = max(1, -(-total // shard_rows))
    tasks = min(shards, WRITERS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, width = pa.Codec("zstd", compression_level=LEVEL), sequence * np.dtype(dtype).itemsize
        for batch in batches:
            first = before[np.searchsorted(numbers, batch.column("p").to_numpy())] + batch.column("i").to_numpy()
            sizes = batch.column("n_tokens").value_lengths().to_numpy()
            data = batch.column("ids")
            for b, size in enumerate(sizes.tolist()):
                whole = packed.decompress(data[b].as_buffer(), size * width)
                pieces = pa.array([packed.compress(whole.slice(i * width, width), asbytes=True) for i in range(size)], pa.binary())
                index = first[b] + np.arange(size)
                columns = [pa.array(index), pieces, batch.column("n_tokens")[b].values, batch.column("doc_ids")[b].values, pa.array(order(index))]
                yield pa.RecordBatch.from_arrays(columns, ["index", "ids", "n_tokens", "doc_ids", "slot"])

    fields = [("index", T.LongType()), ("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("doc_ids", sequences.schema["doc_ids"].dataType.elementType), ("slot", T.LongType())]
    placed = sequences.mapInArrow(place, T.StructType([T.StructField(n, t) for n, t in fields]))
    shard = F.floor(F.col("slot") / shard_rows).cast("long")
    dealt = placed.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stream, manager, packed, size = None, None, None, pa.Codec("zstd"), sequence * np.dtype(dtype).itemsize
        try:
            for batch in batches:
                slots, crc = batch.column("slot").to_numpy(), []
                data = batch.column("ids")
                for i, s in enumerate((slots // shard_rows).tolist()):
                    if s != shard:
                        if manager:
                            manager.__exit__(None, None, None)
                        shard, manager = s, committed(f"{folder}/shard-{s:08d}.bin")
                        stream = manager.__enter__()
                    piece = packed.decompress(data[i].as_buffer(), size)
                    stream.write(piece)
                    crc.append(zlib.crc32(piece))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("slot"), pa.array(slots // shard_rows), pa.array(slots % shard_rows), batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("index"), batch.column("doc_ids")],
                    ["slot", "shard", "row", "n_tokens", "ids_crc32", "index", "doc_ids"],
                )
            if manager:
                manager.__exit__(None, None, None)
                manager = None
        except BaseException as e:
            if manager:
                manager.__exit__(type(e), e, e.__traceback__)
            raise

    names = [(n, T.LongType()) for n in ("slot", "shard", "row", "n_tokens", "ids_crc32", "index")]
    schema = T.StructType([*(T.StructField(n, t) for n, t in names), placed.schema["doc_ids"]])
    written = materialize(dealt.mapInArrow(write, schema), "shard-rows")
    discard(sequences)
    return written


def read_slots(folder: str, slot: int, rows: int, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS, dtype: str = "<u2") -> np.ndarray:
    """Up to ``rows`` sequences from ``slot`` on, as an array of (rows, sequence); they may lie in several shards, which must exist."""
    width, out = sequence * np.dtype(dtype).itemsize, []
    while rows > 0:
        shard, row = divmod(slot, shard_rows)
        take = min(rows, shard_rows - row)
        data = read_range(f"{folder}/shard-{shard:08d}.bin", row * width, take * width)
        out.append(np.frombuffer(data, dtype).reshape(-1, sequence))
        if len(out[-1]) < take:
            break  # the last shard's end
        slot, rows = slot + take, rows - take
    return np.concatenate(out) if out else np.zeros((0, sequence), dtype)


def training_order(docs: DataFrame) -> DataFrame:
    """``materialise`` into the shared folder, at production parameters."""
    return materialise(docs, scratch(docs.sparkSession, "training-order"))
