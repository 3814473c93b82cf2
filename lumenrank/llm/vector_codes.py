"""Vector codes: product quantisation whose codebooks come from delta-maintained Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. What a round keeps is the assignment of every part (in a table in the shared
folder, beside the vectors) and, for each codebook entry, the running integer sum and count
of its parts. A round assigns all parts to the present codebook and shuffles only what moved: a part
whose assignment changed is subtracted from its old entry and added to the new one, summed
in each task first. As sums are integers, any order of adding gives the same codebook, so a task that
runs again changes nothing.

Scale: a round is a narrow pass over the state, written as Parquet, and a shuffle of at most
parts x entries rows from each task. The codebooks (8 x 16 entries as dealt) go with the task's code.
Only the running sums are held by the driver: their size depends on the codebooks, not on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are held to this magnitude, so that every distance and sum fits 64 bits.
LARGEST = 1 << 27
#: Rows assigned at once in a task.
STEP = 4096


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows whose vector is there, not empty and has finite components only; v has floor(scale * x)."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~odd).select("vec_id", "label", F.transform("x", held).alias("v"))


def assign(parts: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) of rows x parts x width integers; ties go to the lower index."""
    codes = np.empty(parts.shape[:2], np.uint8)
    far = np.empty(parts.shape[:2], np.int64)
    for p, book in enumerate(codebooks):
        for start in range(0, len(parts), STEP):
            own = parts[start : start + STEP, p]
            d = np.empty((len(own), len(book)), np.int64)
            for k, entry in enumerate(book):
                gap = own - entry
                d[:, k] = np.einsum("ij,ij->i", gap, gap)
            best = d.argmin(axis=1)
            codes[start : start + STEP, p] = best
            far[start : start + STEP, p] = d[np.arange(len(own)), best]
    return codes, far


def _integers(column: pa.Array, n_parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n_parts, -1)


def _bytes(column: pa.Array, n_parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n_parts)


def _as_binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assigned(state: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """The state with its codes as ``old`` and those of the present codebook as ``codes``; ``error`` is the summed distance."""
    n_parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, far = assign(_integers(batch.column("v"), n_parts), codebooks)
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), batch.column("codes"), _as_binary(codes), pa.array(far.sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "old", "codes", "error"])

    schema = state.select("vec_id", "label", "v", F.col("codes").alias("old"), "codes").schema.add("error", "long")
    return state.select("vec_id", "label", "v", "codes").mapInArrow(run, schema)


def moved(state: DataFrame, n_parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, sums): what the parts that changed from ``old`` to ``codes`` take from and bring to each entry; no row where nothing moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((n_parts, entries), np.int64)
        sums = np.zeros((n_parts, entries, width), np.int64)
        touched = np.zeros((n_parts, entries), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, codes = _integers(batch.column("v"), n_parts), _bytes(batch.column("codes"), n_parts)
            fresh = pa.compute.is_null(batch.column("old")).to_numpy(zero_copy_only=False)
            old = _bytes(pa.compute.fill_null(batch.column("old"), bytes(n_parts)), n_parts)
            for p in range(n_parts):
                new = fresh | (codes[:, p] != old[:, p])
                for entry, rows, sign in ((codes[new, p], parts[new, p], 1), (old[new & ~fresh, p], parts[new & ~fresh, p], -1)):
                    np.add.at(n[p], entry, sign)
                    np.add.at(sums[p], entry, sign * rows)
                    touched[p, entry] = True
        part, entry = np.nonzero(touched)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    changed = state.where(F.col("old").isNull() | (F.col("old") != F.col("codes"))).select("v", "old", "codes")
    deltas = changed.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return deltas.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def train(state: DataFrame, n_parts: int, entries: int, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    """(state, codebooks) after the rounds and the last assignment; ``state`` has vec_id, label, v and null codes, in the shared folder."""
    first = [r["v"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = len(first[0]) // n_parts
    codebooks = list(np.array(first, np.int64).reshape(len(first), n_parts, width).transpose(1, 0, 2))
    n = np.zeros((n_parts, len(first)), np.int64)
    sums = np.zeros((n_parts, len(first), width), np.int64)
    for _ in range(rounds):
        held, state = state, materialize(_assigned(state, codebooks), "vector-state")
        discard(held)
        for r in moved(state, n_parts, len(first), width).collect():
            n[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array(r["sums"], np.int64)
        # numpy's integer division floors; an entry that nothing is assigned to stays.
        codebooks = [np.where(n[p][:, None] > 0, sums[p] // np.maximum(n[p], 1)[:, None], codebooks[p]) for p in range(n_parts)]
    held, state = state, materialize(_assigned(state, codebooks), "vector-state")
    discard(held)
    return state, codebooks


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Rows without a vector, with an empty one, or with null or non-finite components go. So do vectors of
    another length than the first row's by (vec_id, components); that length must be a multiple of ``parts``.
    With fewer kept rows than ``entries`` there are as many entries as rows. Repeated ids are rows of
    their own, ordered by their components; a null id comes last. Components beyond 2^27 once scaled
    count as 2^27. Null labels are one label. No kept row gives an empty result; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, as a code is a byte")
    kept = kept_vectors(vectors, id_col, vector_col, label_col, scale)
    state = materialize(kept.withColumn("codes", F.lit(None).cast("binary")), "vector-state")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).first()
    if first is None:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if first[0] % parts:
        raise ValueError(f"vectors of {first[0]} components can't be cut into {parts} equal parts")
    same = state.where(F.size("v") == first[0])
    if same.count() < state.count():
        held, state = state, materialize(same, "vector-state")
        discard(held)
    state, codebooks = train(state, parts, entries, rounds)
    by_label = state.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    return state.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The contract in plain SQL: every round from all rows, without deltas."""
    nearest = """
x{r} AS MATERIALIZED (
    SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
    FROM (SELECT id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM p JOIN b{r} USING (part, pos) GROUP BY id, part, entry)
    GROUP BY id, part
)"""
    update = """,
b{s} AS MATERIALIZED (
    SELECT part, entry, pos, coalesce(CAST(floor_sum AS BIGINT), c) AS c FROM b{r} LEFT JOIN (
        SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS floor_sum
        FROM (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p JOIN x{r} USING (id, part) GROUP BY part, entry, pos)
    ) USING (part, entry, pos)
)"""
    steps = ",".join(nearest.format(r=r) + (update.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS (
    SELECT id, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // {parts} AS width FROM k
), p AS MATERIALIZED (
    SELECT id, place // width AS part, place % width AS pos, CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM e
), b0 AS MATERIALIZED (
    SELECT part, id - 1 AS entry, pos, x AS c FROM p WHERE id <= {entries}
),{steps}, h AS (
    SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}
), f AS (
    SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM x{rounds} GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN f USING (id) CROSS JOIN h
"""


ORACLE_SQL = oracle_sql()
