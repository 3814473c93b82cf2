"""Dense retrieval: exact cosine top-k for a batch of queries, and an optional approximate index."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenrank.functions.vectors import cosine, norm
from lumenrank.operators.lexical import DIGITS, ranked

#: Queries multiplied at once.
QUERY_BLOCK = 4_096
#: Scores of a batch of index rows that are held at once, at most; they take some four times their 8 bytes.
CELLS = 2_000_000
#: Bytes of query vectors that are sent to the executors together; more go in further passes over the index.
QUERY_BYTES = 128_000_000


def query_blocks(queries: DataFrame, size: int | None = None, most: int = QUERY_BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """(qids, matrix) of queries (qid, vector) in blocks of bounded bytes; only vectors of ``size`` components (the first one's, if not given), finite and not zero."""
    rows = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL").toLocalIterator()
    qids: list = []
    vectors: list[np.ndarray] = []
    for r in rows:
        vector = np.array(r["vector"], np.float64)  # a null component is not a number
        size = len(vector) if size is None else size
        if len(vector) != size or not np.isfinite(vector).all() or not vector.any():
            continue
        qids.append(r["qid"])
        vectors.append(vector)
        if len(vectors) * size * 8 >= most:
            yield qids, np.array(vectors)
            qids, vectors = [], []
    if vectors:
        yield qids, np.array(vectors)


def dense_scores(queries: DataFrame, index: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score) of all pairs, in Catalyst only: the readable form, for at most ``QUERY_BLOCK`` queries.

    More would be sent to every executor; ``dense_search`` and ``catalyst_search`` take those.
    """
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: use dense_search")
    pairs = index.crossJoin(F.broadcast(queries.select("qid", F.col("vector").alias("query"))))
    if exclude_self:
        pairs = pairs.where(F.col("qid") != F.col("id"))
    return pairs.select("qid", "id", F.round(cosine(F.col("vector"), F.col("query")), DIGITS).alias("score")).where("score IS NOT NULL")


def _components(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(key, components): unit vectors of so many finite components as columns ``name`` 0, 1, and so on, none of them null."""
    vector = F.col("vector").cast("array<double>")
    whole = rows.select(key, vector.alias("vector")).where((F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    whole = whole.withColumn("norm", norm(F.col("vector"))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return whole.select(key, *(F.coalesce(F.get("vector", F.lit(i)) / F.col("norm"), F.lit(0.0)).alias(f"{name}{i}") for i in range(size)))


def _total(terms: list[Column]) -> Column:
    """The sum of terms, as a tree of little depth."""
    while len(terms) > 1:
        terms = [reduce(operator.add, terms[i : i + 8]) for i in range(0, len(terms), 8)]
    return terms[0]


def catalyst_search(queries: DataFrame, index: DataFrame, depth: int = 10, exclude_self: bool = False, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The rows of ``dense_search`` without Python: components are columns, so that a pair's score is compiled arithmetic.

    A part of the index, as large as what its results then let through, is searched first; its ``depth``-th best score for a query is a bound
    for the rest, so that of all pairs only those few that reach it are sorted. Queries go out in parts of bounded
    bytes, and vectors of each length that queries have are searched apart.
    """
    types = [queries.schema["qid"], index.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    sizes = queries.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    rows = max(1, index.count()) if sizes else 0
    slices = max(1, int(rows // math.sqrt(depth * rows))) if rows else 1
    out = None
    for size, n in sizes:
        parts = -(-n * size * 8 // most_bytes)
        for part in range(parts):
            asked = _components(queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part), "qid", size, "q")
            dot = _total([F.col(f"q{i}") * F.col(f"v{i}") for i in range(size)])

            def scored(asked: DataFrame, rows: DataFrame, size: int = size, dot: Column = dot) -> DataFrame:
                pairs = _components(rows, "id", size, "v").crossJoin(F.broadcast(asked))
                pairs = pairs.where(F.col("qid") != F.col("id")) if exclude_self else pairs
                near = pairs.where(dot > F.col("least") - 10.0**-DIGITS)  # rounding costs more than all products
                return near.select("qid", "id", F.round(dot, DIGITS).alias("score"))

            first = scored(asked.withColumn("least", F.lit(-2.0)), index.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == 0))
            least = ranked(first, depth).where(F.col("rank") == depth).select("qid", F.col("score").alias("least"))
            bounded = asked.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
            found = ranked(scored(bounded, index), depth)
            out = found if out is None else out.unionByName(found)
    return queries.sparkSession.createDataFrame([], T.StructType(types)) if out is None else out


def dense_search(queries: DataFrame, index: DataFrame, depth: int = 10, exclude_self: bool = False, block: int = QUERY_BLOCK, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, id, score, rank): the best ``depth`` of index (id, vector) for queries (qid, vector).

    Queries go out together up to a bound of bytes, each such part in one pass over the index; a batch of index rows is one matrix
    product for each block of queries, of at most ``CELLS`` scores, and passes on only its own best ``depth`` that reach those of
    the task's batches before, so the shuffle holds few rows. Zero
    vectors and vectors of another length score nothing.
    """
    spark = index.sparkSession
    types = [queries.schema["qid"], index.schema["id"], T.StructField("score", T.DoubleType())]
    qid_type = to_arrow_type(queries.schema["qid"].dataType)
    out = None
    for asked, matrix in query_blocks(queries, most=most_bytes):
        shared = spark.sparkContext.broadcast((asked, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, matrix = shared.value
            size, qids, units = matrix.shape[1], pa.array(asked, qid_type), _unit(matrix)
            sure = np.full(len(units), -np.inf)  # of each query the least score that its best rows so far have
            for batch in batches:
                column = batch.column("vector")
                good = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == size)
                if not len(good):
                    continue
                ids = batch.column("id").take(pa.array(good))
                rows = _unit(column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                step = max(1, min(block, CELLS // len(rows)))
                for start in range(0, len(units), step):
                    scores = rows @ units[start : start + step].T
                    np.round(scores, DIGITS, out=scores)
                    scores[~np.isfinite(scores)] = -np.inf
                    keep, least = depth + exclude_self, sure[start : start + step]
                    if keep <= len(scores):
                        np.maximum(least, np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep], out=least)
                    row, query = np.nonzero((scores >= least) & (scores > -np.inf))  # ties at the end stay; the final ranking decides them
                    left, right = qids.take(pa.array(query + start)), ids.take(pa.array(row))
                    found = pa.RecordBatch.from_arrays([left, right, pa.array(scores[row, query])], ["qid", "id", "score"])
                    yield found.filter(pc.not_equal(left, right)) if exclude_self else found

        best = index.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, T.StructType(types))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], T.StructType([*types, T.StructField("rank", T.IntegerType())]))
    return ranked(out, depth)


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.where(size > 0, matrix / np.where(size > 0, size, 1), np.nan)


#: Rows that share a bucket of one table, about.
BUCKET_ROWS = 64


class ApproximateIndex:
    """Random-projection buckets on unit vectors; candidates are scored exactly.

    The bits of a bucket grow with the number of rows, so that a query meets a bounded number in each
    table; it also asks the buckets that differ from its own in one bit. Null vectors, zero vectors and
    those of another length are not found; an empty table finds nothing.
    """

    def __init__(self, index: DataFrame, tables: int = 12, bits: int | None = None, seed: int = 7):
        self.index = index.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") > 0)
        first = self.index.select(F.size("vector").alias("size")).first()
        self.size = first["size"] if first else 1
        self.index = self.index.where(F.size("vector") == self.size)
        if bits is None:
            bits = min(20, max(4, (self.index.count() // BUCKET_ROWS).bit_length()))
        self.planes = np.random.default_rng(seed).standard_normal((tables, bits, self.size))
        self.buckets = self._hashed(self.index, "id", False)

    def _hashed(self, df: DataFrame, key: str, probe: bool) -> DataFrame:
        planes = self.planes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, bits, size = planes.shape
            weights = 1 << np.arange(bits, dtype=np.int64)
            for batch in batches:
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                codes = ((np.einsum("tbd,nd->ntb", planes, flat) > 0) * weights).sum(axis=2)
                if probe:
                    codes = codes[:, :, None] ^ np.concatenate(([0], weights))
                codes = codes + (np.arange(tables, dtype=np.int64) << bits).reshape(1, -1, *[1] * probe)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(codes.reshape(len(flat), -1)), pa.list_(pa.int64()))], [key, "codes"])

        hashed = df.select(key, "vector").mapInArrow(run, T.StructType([df.schema[key], T.StructField("codes", T.ArrayType(T.LongType()))]))
        return hashed.select(key, F.explode("codes").alias("code"))

    def search(self, queries: DataFrame, depth: int = 10) -> DataFrame:
        asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == self.size)
        pairs = self.buckets.join(self._hashed(asked, "qid", True), "code").select("qid", "id").distinct()
        scored = pairs.join(self.index, "id").join(asked.select("qid", F.col("vector").alias("query")), "qid")
        found = scored.select("qid", "id", F.round(cosine(F.col("vector"), F.col("query")), DIGITS).alias("score"))
        return ranked(found.where(F.col("score").isNotNull() & ~F.isnan("score")), depth)
