"""Packing by cutting-stock column generation.

A document's ids (its tokens, then one end id) are cut into whole sequences and one
remainder. The histogram of piece lengths, rounded up to steps of ``UNIT`` ids where they are
short and of ``STEP`` ids above, is the demand of a cutting-stock problem: a linear program over patterns (multisets of lengths that fit
one sequence) is solved by revised simplex, and an unbounded-knapsack dynamic program
prices new columns until none improves. The rounded-down pattern counts, completed by
first-fit-decreasing patterns for what rounding leaves, say how many sequences of each
pattern to build. Pieces are ranked within their length class, and a piece's rank is its
place in the patterns.

Scale: documents are tokenised once and never shuffled; only one small row for each piece
moves. Only the histogram (at most SHORT / UNIT + 2048 / STEP rows) reaches the driver, and the plan that
goes back is bounded by the number of classes, whatever the input. Ranks come from
(class, bucket) counts, so a length that a third of all pieces share is still ranked by many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import id_and_text, materialize, slices
from lumenrank.llm.tokens import default_path, encoder

SEQUENCE = 2048
#: Lengths are planned in steps of STEP ids, and up to SHORT in steps of UNIT.
STEP, SHORT, UNIT = 16, 64, 4
END_ID = 1
#: Pieces ranked by one task, about.
BUCKET_PIECES = 100_000


def cut_pieces(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole sequences first, then the remainder."""
    path = tokenizer_path or default_path()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in slices(batches, "text", 2_000_000):
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + end
                for at in range(0, len(ids), 4 * sequence):
                    piece = ids[at : at + 4 * sequence]
                    rows.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    docs = id_and_text(docs)
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    return docs.mapInArrow(cut, T.StructType([docs.schema["doc_id"], *long]))


def _best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's best multiset of rising sizes: its value and its counts."""
    fitting = np.searchsorted(size, np.arange(capacity + 1), side="right")
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            total = value[:k] + best[room - size[:k]]
            i = int(total.argmax())
            if total[i] > best[room] + 1e-12:
                best[room], take[room] = total[i], i
    counts, room = np.zeros(len(size)), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
            continue
        counts[take[room]] += 1
        room -= size[take[room]]
    return float(best[capacity]), counts


def _inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; a few hundred rows at most, without threads of a linear-algebra library."""
    n = len(a)
    work = np.hstack((a, np.eye(n)))
    for i in range(n):
        p = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= np.outer(factor, work[i])
    return work[:, n:]


def plan_patterns(size: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: count}, repeats) that hold the whole demand of rising sizes, close to the fewest sequences.

    Column generation: the master's dual prices value the sizes, the knapsack finds the
    pattern of the best reduced cost; it ends when the bound that the prices give is within
    one part in 10,000 of the current value.
    """
    sizes, need = np.array(size, np.int64), np.array(demand, float)
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    nudged = need + 1e-3 * np.random.default_rng(0).random(m)  # no two ratios tie, so the simplex can't cycle
    x = inverse @ nudged
    for step in range(16 * m + 100):
        price = inverse.sum(axis=0)
        value, column = _best_pattern(np.maximum(price, 0), sizes, capacity)
        if value <= 1 + 1e-4:  # price / value is a feasible dual: x.sum() / value bounds the optimum
            break
        move = inverse @ column
        limits = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(limits))
        if not np.isfinite(limits[out]):
            break
        x = x - limits[out] * move
        x[out] = limits[out]
        basis[:, out] = column
        if step % 200 == 199:
            inverse = _inverted(basis)
            x = np.maximum(inverse @ nudged, 0)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
    plan, left = [], need.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        counts = np.round(basis[:, j]).astype(np.int64)
        used = counts > 0
        repeats = min(int(x[j] + 2e-3), int((left[used] // counts[used]).min())) if used.any() else 0
        if repeats > 0:
            plan.append(({int(s): int(c) for s, c in zip(sizes[used], counts[used])}, repeats))
            left -= repeats * counts
    # What rounding leaves: at most a few pieces for each pattern, first fit by decreasing size.
    open_: list[tuple[int, dict[int, int]]] = []
    for i in np.argsort(-sizes, kind="stable"):
        s, n = int(sizes[i]), int(left[i])
        for k, (room, held) in enumerate(open_):
            if not n:
                break
            fit = min(n, room // s)
            if fit:
                held[s] = held.get(s, 0) + fit
                open_[k] = (room - fit * s, held)
                n -= fit
        while n:
            fit = min(n, capacity // s)
            open_.append((capacity - fit * s, {s: fit}))
            n -= fit
    merged: dict[tuple, int] = {}
    for _, held in open_:
        key = tuple(sorted(held.items()))
        merged[key] = merged.get(key, 0) + 1
    return plan + [(dict(k), n) for k, n in merged.items()]


def assign(pieces: DataFrame, sequence: int = SEQUENCE, step: int = STEP) -> DataFrame:
    """Add sequence_id and offset to pieces (a stable table: it is read more than once)."""
    spark = pieces.sparkSession
    unit = math.gcd(UNIT, step, sequence)
    capacity = sequence // unit
    length = F.col("length")
    kind = F.when(length <= SHORT, F.ceil(length / unit)).otherwise(F.least(F.ceil(length / step) * (step // unit), F.lit(capacity))).cast("long")
    histogram = {r[0]: r[1] for r in pieces.groupBy(kind.alias("kind")).count().collect()}  # a row for each class
    sizes = sorted(histogram)
    plan = plan_patterns(sizes, [histogram[s] for s in sizes], capacity)
    rows, at, first = [], dict.fromkeys(sizes, 0), 0
    for held, repeats in plan:
        for s, per in held.items():
            rows.append((s, at[s], at[s] + per * repeats, first, per))
            at[s] += per * repeats
        first += repeats
    slots = spark.createDataFrame(rows, "kind long, from_rank long, to_rank long, first long, per long")
    buckets = max(16, -(-sum(histogram.values()) // BUCKET_PIECES))
    keyed = pieces.withColumn("kind", kind).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = keyed.join(base, ["kind", "bucket"]).withColumn("rank", F.col("base") + within)
    inside = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("kind", "slot_kind")), (F.col("kind") == F.col("slot_kind")) & inside)
    local = F.col("rank") - F.col("from_rank")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(local / F.col("per")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    return placed.withColumn("offset", offset)


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is the empty text, whose only id is the end id. A document's ids lie in
    exactly one piece each; pieces in a sequence have no gaps. Repeated rows are packed
    each on its own; null ids are kept. An empty table gives no rows. Other columns are not read.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, sequence, end_id), "pieces")
    return assign(pieces, sequence, step).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
