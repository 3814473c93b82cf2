"""Approximate dense retrieval: a navigable small-world graph for each shard of the vectors.

Vectors are dealt to shards of bounded size. A shard's graph is built in one Arrow group: exact neighbour lists
by blocks of matrix products, of which those stay that no nearer neighbour stands for, their reverse edges, and a few
random long edges; a sample of pivots are the places to start from. A shard is stored as one row: ids, vectors, adjacency, pivots.

A search walks every shard for all queries at once. Each query holds a list of max(depth, ef) candidates and
opens the best one not yet opened, until none is left in the list. Scores are exact cosines of the vectors found. A walk that
ends with fewer rows than asked, where the shard has more, falls back to the shard's own matrix product, so ``depth`` rows come whenever there are so many.

Scale: the shards are dealt to tasks, a task's memory is bounded by one shard and a block of queries, and only each shard's best rows
are shuffled. Queries go out in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenrank.operators.dense import query_blocks
from lumenrank.operators.lexical import DIGITS, ranked

#: Rows, and bytes of 64-bit components, in a shard, about.
SHARD_ROWS, SHARD_BYTES = 20_000, 64_000_000
#: Own edges of a node, the neighbours that they are chosen from, and random edges.
DEGREE, NEAR, LONG = 16, 64, 4
#: Candidates that a walk holds, at least.
EF = 16
#: Candidates that are opened from the start.
STARTS = 4
#: Queries that walk together.
WALK = 256


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one, as 32-bit numbers; rows without a length are zero."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.where(size > 0, matrix / np.where(size > 0, size, 1), 0).astype(np.float32)


def build_graph(rows: np.ndarray, degree: int = DEGREE, near: int = NEAR, long: int = LONG, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency, pivots) of unit vectors; adjacency has a row for each, filled with -1."""
    n = len(rows)
    random = np.random.default_rng(seed)
    pivots = np.sort(random.choice(n, max(1, int(n**0.5)), replace=False)).astype(np.int32)
    near = min(near, n - 1)
    if near < 1:
        return np.full((n, 1), -1, np.int32), pivots
    own, other = [], []
    for start in range(0, n, WALK):
        block = rows[start : start + WALK]
        scores = block @ rows.T
        scores[np.arange(len(block)), np.arange(start, start + len(block))] = -2
        best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1, kind="stable"), axis=1)
        to_node = np.take_along_axis(scores, best, axis=1)
        between = rows[best] @ rows[best].transpose(0, 2, 1)
        keep = np.zeros(best.shape, bool)
        for j in range(near):  # a neighbour stays unless one that stays is nearer to it than the node is
            covered = (keep & (between[:, j, :] > to_node[:, j, None])).any(axis=1)
            keep[:, j] = ~covered & (keep.sum(axis=1) < degree)
        at, place = np.nonzero(keep)
        own.append(at + start)
        other.append(best[at, place])
    a, b = np.concatenate(own).astype(np.int64), np.concatenate(other).astype(np.int64)
    edges = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = edges // n, edges % n
    order = np.lexsort((-np.einsum("ij,ij->i", rows[a], rows[b]), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    inside = place < 2 * degree
    adjacency = np.full((n, 2 * degree + long), -1, np.int32)
    adjacency[a[inside], place[inside]] = b[inside]
    for j in range(2 * degree, 2 * degree + long):
        far = random.integers(0, n, n).astype(np.int32)
        fresh = (far != np.arange(n)) & ~(adjacency[:, :j] == far[:, None]).any(axis=1)
        adjacency[fresh, j] = far[fresh]
    return adjacency, pivots


def walk(rows: np.ndarray, adjacency: np.ndarray, pivots: np.ndarray, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances computed): the ``ef`` best rows found for each query, best first, filled with -1; rows and queries are unit vectors."""
    q, n = len(queries), len(rows)
    seen = np.zeros((q, n), bool)
    seen[:, pivots] = True
    cost = np.full(q, len(pivots), np.int64)
    scores = queries @ rows[pivots].T
    k = min(ef, len(pivots))
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.full((q, ef), -1, np.int64)
    score = np.full((q, ef), -np.inf, np.float32)
    opened = np.ones((q, ef), bool)
    place[:, :k], score[:, :k], opened[:, :STARTS] = pivots[top], np.take_along_axis(scores, top, axis=1), False
    opened[:, k:] = True
    active = np.arange(q)
    while len(active):
        waiting = np.where(opened[active], -np.inf, score[active])
        best = waiting.argmax(axis=1)
        going = waiting[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        opened[active, best] = True
        around = adjacency[place[active, best]]
        fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        at, column = np.nonzero(fresh)
        seen[active[at], around[at, column]] = True
        cost[active] += fresh.sum(axis=1)
        found = np.full(around.shape, -np.inf, np.float32)
        found[at, column] = np.einsum("ij,ij->i", queries[active[at]], rows[around[at, column]])
        all_score = np.concatenate((score[active], found), axis=1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :ef]
        place[active] = np.take_along_axis(np.concatenate((place[active], around), axis=1), order, axis=1)
        opened[active] = np.take_along_axis(np.concatenate((opened[active], ~fresh), axis=1), order, axis=1)
        score[active] = np.take_along_axis(all_score, order, axis=1)
    place[score == -np.inf] = -1
    return place, cost


class GraphIndex:
    """A stored graph index of (id, vector).

    Null vectors, zero vectors, those with null or non-finite components and those of another length than most have are not indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.size, self.rows, self.shards = about["size"], about["rows"], about["shards"]

    @classmethod
    def store(cls, index: DataFrame, path: str, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> GraphIndex:
        """Build and save the index with one shuffle of the vectors; its description comes last and makes it whole."""
        spark = index.sparkSession
        x = F.col("vector").cast("array<double>")
        good = index.select("id", x.alias("vector")).where("vector IS NOT NULL AND exists(vector, c -> c <> 0D) AND forall(vector, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
        sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        size, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
        shards = max(1, -(-n // max(1, min(shard_rows, SHARD_BYTES // max(8, 8 * size)))))
        id_type = to_arrow_type(index.schema["id"].dataType)
        rows = good.where(F.size("vector") == size).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        schema = T.StructType(
            [T.StructField("shard", T.IntegerType()), T.StructField("ids", T.ArrayType(index.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "adjacency", "pivots"))]
        )

        def build(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            adjacency, pivots = build_graph(unit(matrix), degree)
            ids = pa.array([table.column("id").to_pylist()], pa.list_(id_type))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), ids, *(pa.array([a.tobytes()], pa.binary()) for a in (matrix, adjacency, pivots))], names=schema.names)

        rows.groupBy("shard").applyInArrow(build, schema).write.option("parquet.block.size", 32_000_000).parquet(f"{path}/shards")
        spark.createDataFrame([(size, n, shards)], "size int, rows long, shards int").coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path)

    def search(self, queries: DataFrame, depth: int = 10, ef: int = EF) -> DataFrame:
        """(qid, id, score, rank): about the best ``depth`` rows for queries (qid, vector), with exact scores.

        Null queries, zero queries and those of another length find nothing.
        """
        found = self._found(queries, depth, ef).where("score IS NOT NULL")
        return ranked(found.select("qid", "id", F.round("score", DIGITS).alias("score")), depth)

    def search_cost(self, queries: DataFrame, depth: int = 10, ef: int = EF) -> DataFrame:
        """(qid, rows, distances): how many of the indexed rows each query was compared with."""
        cost = self._found(queries, depth, ef).where("score IS NULL").groupBy("qid").agg(F.sum("distances").alias("distances"))
        return cost.select("qid", F.lit(self.rows).alias("rows"), "distances")

    def _found(self, queries: DataFrame, depth: int, ef: int) -> DataFrame:
        """(qid, id, score, distances): each shard's best rows, and a row without id and score for what they cost."""
        stored = self.spark.read.parquet(f"{self.path}/shards")
        id_field = stored.schema["ids"].dataType.elementType
        types = [queries.schema["qid"], T.StructField("id", id_field), T.StructField("score", T.DoubleType()), T.StructField("distances", T.LongType())]
        qid_type, id_type, size = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(id_field), self.size
        out = None
        for qids, matrix in query_blocks(queries, size):
            shared = self.spark.sparkContext.broadcast((qids, matrix))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qids, matrix = shared.value
                qids, asked = pa.array(qids, qid_type), unit(matrix)
                for batch in batches:
                    for at in range(batch.num_rows):
                        raw, adjacency, pivots = (np.frombuffer(batch.column(c)[at].as_buffer(), t) for c, t in (("vectors", np.float64), ("adjacency", np.int32), ("pivots", np.int32)))
                        raw = raw.reshape(-1, size)
                        rows, ids = unit(raw), batch.column("ids")[at].values
                        for start in range(0, len(asked), WALK):
                            place, cost = shard_search(rows, adjacency.reshape(len(rows), -1), pivots, asked[start : start + WALK], depth, ef)
                            i, j = np.nonzero(place >= 0)
                            exact = cosines(matrix[i + start], raw[place[i, j]])
                            q = np.arange(start, start + len(cost))
                            yield pa.RecordBatch.from_arrays([qids.take(pa.array(i + start)), ids.take(pa.array(place[i, j])), pa.array(exact), pa.nulls(len(i), pa.int64())], ["qid", "id", "score", "distances"])
                            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.nulls(len(q), id_type), pa.nulls(len(q), pa.float64()), pa.array(cost)], ["qid", "id", "score", "distances"])

            found = stored.select("ids", "vectors", "adjacency", "pivots").mapInArrow(run, T.StructType(types))
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], T.StructType(types))


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", one, two) / (np.linalg.norm(one, axis=1) * np.linalg.norm(two, axis=1))


def shard_search(rows: np.ndarray, adjacency: np.ndarray, pivots: np.ndarray, queries: np.ndarray, depth: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances computed): ``depth`` places for each query, best first; -1 only where the shard has no more rows."""
    place, cost = walk(rows, adjacency, pivots, queries, max(depth, ef))
    want = min(depth, len(rows))
    short = np.flatnonzero((place >= 0).sum(axis=1) < want)
    if len(short):
        scores = queries[short] @ rows.T
        best = np.argpartition(-scores, want - 1, axis=1)[:, :want]
        place[short, :want] = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1, kind="stable"), axis=1)
        cost[short] += len(rows)
    return place[:, :depth], cost

