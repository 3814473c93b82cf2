"""A lexical index that follows upserts, with a top-k search that stops early.

An index is a list of immutable segments. An upsert or a delete writes one more, with the new documents and
marks for the documents of older segments that it replaces; no old segment is written again. Document frequencies are
sums over segments, less the terms of marked documents. ``merge`` puts segments of like size together. A manifest
names what counts, and its appearance is the commit.

In a segment, documents lie in tiles of bounded size, one to a bucket, numbered in a tile by id, and a row of the postings is
a tile's list for a term. A search is one task for each tile (the postings are bucketed by tile, so nothing of them
is shuffled): a query's terms are taken from the heaviest down; once those left can't lift a new document
to the running threshold (the ``depth``-th best score that is sure so far), their lists are only probed at documents still
in the race. The threshold starts at what one tile alone gives. Scores are those of ``lexical.lexical_scores``.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenrank.operators.lexical import BODY_WEIGHT, BROADCAST_TERMS, DIGITS, MAX_DF, SLACK, TITLE_WEIGHT, build_postings, kept_terms, query_terms, ranked, tile_numbers, tiled
from lumenrank.session import stored
from lumenrank.sources.manifests import Manifests

#: Documents in a tile, about.
TILE_DOCS = 16_384
#: The tables of a folder, but for its ids, whose type is the documents'.
TABLES = {
    "postings": "tile int, term string, docs array<int>, title array<int>, body array<int>",
    "df": "term string, df long",
    "gone": "segment string, tile int, doc int",
    "minus": "segment string, term string, df long",
}
#: Segments of like size that a merge puts together.
FAN = 4
#: Manifests, and the folders that only they name, that stay for readers that are under way.
KEPT = 3

HITS = [T.StructField("tile", T.IntegerType()), T.StructField("doc", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("postings", T.LongType()), T.StructField("read", T.LongType())]


def tile_hits(lists: dict[str, tuple[np.ndarray, np.ndarray]], gone: np.ndarray, terms: list[tuple[str, float]], depth: int, sure: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents, scores, postings, read) of a tile for one query.

    ``lists`` has for each term its sorted document numbers and their weighted frequencies, ``terms`` the query's terms and
    weights, heaviest first. At least the best ``depth`` documents with scores of ``sure`` or more come back. ``postings`` counts
    those of the query's terms, ``read`` those added or probed.
    """
    own = [(w, *lists[t]) for t, w in terms if t in lists]
    if not own:
        return np.empty(0, np.int64), np.empty(0), 0, 0
    size = 1 + max(max(int(d[-1]) for _, d, _ in own), int(gone.max()) if len(gone) else 0)
    covered, often = np.zeros(size), np.zeros(size)
    covered[gone] = -np.inf
    rest = np.concatenate((np.cumsum([w for w, _, _ in own][::-1])[::-1], [0.0])) + 1  # 1: the frequency part is below it
    total, read, at = sum(len(d) for _, d, _ in own), 0, 0

    def threshold(docs: np.ndarray | slice) -> float:
        now = covered[docs] + often[docs] / (1 + often[docs])
        return float(np.partition(now, len(now) - depth)[len(now) - depth]) if len(now) >= depth else -np.inf

    for w, docs, f in own:
        if rest[at] + SLACK < sure:
            break
        covered[docs] += w
        often[docs] += f
        read, at = read + len(docs), at + 1
        if rest[at] < rest[0] / 2:
            sure = max(sure, threshold(slice(None)))
    left = np.flatnonzero((covered > 0) & (covered + rest[at] + SLACK >= sure))
    for w, docs, f in own[at:]:
        if not len(left):
            break
        place = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
        hit = docs[place] == left
        covered[left[hit]] += w
        often[left[hit]] += f[place[hit]]
        read, at = read + min(len(left), len(docs)), at + 1
        sure = max(sure, threshold(left))
        left = left[covered[left] + rest[at] + SLACK >= sure]
    score = covered[left] + often[left] / (1 + often[left])
    if len(score) > depth:
        sure = max(sure, float(np.partition(score, len(score) - depth)[len(score) - depth]))
    best = score + SLACK >= sure
    return left[best], score[best], total, read


class SegmentedIndex:
    """A stored index of documents (id, title, text); ids are unique in a batch and not null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    @classmethod
    def create(cls, docs: DataFrame, path: str, analyzer: str = "simple", tile_docs: int = TILE_DOCS) -> SegmentedIndex:
        index = cls(docs.sparkSession, path)
        schema = docs.select("id").schema.jsonValue()
        index._commit(0, {"analyzer": analyzer, "tile_docs": tile_docs, "ids": schema, "segments": [], "changes": []})
        index.upsert(docs)
        return index

    def state(self) -> tuple[int, dict]:
        number, manifest = self.manifests.last()
        if manifest is None:
            raise ValueError(f"no index at {self.path}")
        return number, manifest

    def upsert(self, docs: DataFrame) -> int:
        """Put documents in by id; returns their number. Old segments stay as they are."""
        number, manifest = self.state()
        folder = self._folder(number)
        rows = docs.select("id", "title", "text")
        count, tiles = self._count(rows, manifest)
        if not count:
            return 0
        numbers = self._tile_numbers(tiles)
        numbered = self._numbered(rows, numbers)
        self._write_ids(numbered.select("tile", "doc", "id"), folder)
        postings = build_postings(numbered.select(F.struct("tile", "doc").alias("id"), "title", "text"), manifest["analyzer"])
        self._write_postings(postings.select("id.tile", "id.doc", "term", "tf_title", "tf_body"), folder, tiles)
        return self._replace(number, manifest, folder, count, numbers)

    def delete(self, ids: DataFrame) -> int:
        """Take documents out by id; returns the number of ids given."""
        number, manifest = self.state()
        folder = self._folder(number)
        count = self._write_ids(ids.select(F.lit(0).alias("tile"), F.lit(-1).alias("doc"), "id").distinct(), folder)
        return self._replace(number, manifest, folder, count, [])

    def merge(self, fan: int = FAN) -> int:
        """Put together any ``fan`` or more segments of like size, again and again; returns the number of merges."""
        merges = 0
        while True:
            number, manifest = self.state()
            tiers: dict[int, list[dict]] = {}
            for s in manifest["segments"]:
                tiers.setdefault(int(math.log(max(1, s["docs"]), fan)), []).append(s)
            many = next((t for t in tiers.values() if len(t) >= fan), None)
            if many is None:
                return merges
            self._merge(number, manifest, many)
            merges += 1

    def _merge(self, number: int, manifest: dict, merged: list[dict]) -> None:
        folder, names = self._folder(number), [s["name"] for s in merged]
        live = stored(self._live(manifest).where(F.col("segment").isin(names)), "live")
        count, tiles = self._count(live, manifest)
        if not count:
            self._commit(number, manifest | {"segments": [s for s in manifest["segments"] if s["name"] not in names]})
            return
        numbers = self._tile_numbers(tiles)
        numbered = stored(self._numbered(live.withColumnsRenamed({"tile": "old_tile", "doc": "old_doc"}), numbers), "renumbered")
        self._write_ids(numbered.select("tile", "doc", "id"), folder)
        flat = None
        for s in merged:
            lists = self._postings(s).select(F.lit(s["name"]).alias("segment"), F.col("tile").alias("old_tile"), "term", F.explode(F.arrays_zip("docs", "title", "body")).alias("z"))
            rows = lists.select("segment", "old_tile", F.col("z.docs").alias("old_doc"), "term", F.col("z.title").alias("tf_title"), F.col("z.body").alias("tf_body"))
            flat = rows if flat is None else flat.unionByName(rows)
        moved = flat.join(numbered.select("segment", "old_tile", "old_doc", "tile", "doc"), ["segment", "old_tile", "old_doc"])
        self._write_postings(moved.select("tile", "doc", "term", "tf_title", "tf_body"), folder, tiles)
        segments = [s for s in manifest["segments"] if s["name"] not in names] + [{"name": folder, "docs": count, "tiles": tiles, "first": numbers[0]}]
        self._commit(number, manifest | {"segments": segments})

    def document_frequency(self, manifest: dict | None = None) -> DataFrame:
        """(term, df) over live documents."""
        manifest = manifest or self.state()[1]
        names = [s["name"] for s in manifest["segments"]]
        parts = [self._read(n, "df").select("term", "df") for n in names]
        parts += [self._read(c["folder"], "minus").where(F.col("segment").isin(names)).select("term", (-F.col("df")).alias("df")) for c in manifest["changes"]]
        if not parts:
            return self.spark.createDataFrame([], TABLES["df"])
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def documents(self) -> DataFrame:
        """The ids of live documents."""
        return self._live(self.state()[1]).select("id")

    def search(self, queries: DataFrame, depth: int = 10, max_df: float = MAX_DF) -> DataFrame:
        """(qid, id, score, rank): the best ``depth`` live documents for each query (qid, query), as ``lexical.lexical_search`` on them."""
        manifest = self.state()[1]
        hits = self._hits(manifest, queries, depth, max_df).where("doc IS NOT NULL")
        ids = self._live(manifest)
        found = hits.join(ids, ["segment", "tile", "doc"])
        return ranked(found.select("qid", "id", F.round("score", DIGITS).alias("score")), depth)

    def search_cost(self, queries: DataFrame, depth: int = 10, max_df: float = MAX_DF) -> DataFrame:
        """(qid, postings, read): postings of each query's terms, and how many of them a search adds or probes."""
        hits = self._hits(self.state()[1], queries, depth, max_df).where("doc IS NULL")
        return hits.groupBy("qid").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))

    # Search.

    def _hits(self, manifest: dict, queries: DataFrame, depth: int, max_df: float) -> DataFrame:
        """(qid, segment) and ``HITS``: candidates of each tile, and a row with its counts where doc is null."""
        kept = kept_terms(query_terms(queries, manifest["analyzer"]), self.document_frequency(manifest), self._size(manifest), max_df)
        kept = stored(kept.where("df > 0").select("qid", "term", (F.col("times") * F.col("idf")).alias("weight")).sort("qid"), "asked")
        out, rows = None, kept.toLocalIterator()
        part: dict = {}
        n = 0
        for r in rows:  # whole queries, in parts of a bounded number of terms
            if n >= BROADCAST_TERMS and r["qid"] not in part:
                out = self._union(out, self._part(manifest, queries.schema["qid"], part, depth))
                part, n = {}, 0
            part.setdefault(r["qid"], []).append((r["term"], r["weight"]))
            n += 1
        if part or out is None:
            out = self._union(out, self._part(manifest, queries.schema["qid"], part, depth))
        return out

    @staticmethod
    def _union(one: DataFrame | None, two: DataFrame) -> DataFrame:
        return two if one is None else one.unionByName(two)

    def _part(self, manifest: dict, qid: T.StructField, part: dict, depth: int) -> DataFrame:
        schema = T.StructType([T.StructField("qid", qid.dataType), T.StructField("segment", T.StringType()), *HITS])
        segments = [s for s in manifest["segments"] if s["tiles"]]
        if not part or not segments:
            return self.spark.createDataFrame([], schema)
        asked = [(q, sorted(terms, key=lambda t: (-t[1], t[0]))) for q, terms in part.items()]
        sure = np.full(len(asked), -np.inf)
        largest = max(segments, key=lambda s: s["docs"])
        if sum(s["tiles"] for s in segments) > 1:
            # What one tile holds for sure; a query with fewer hits there starts without a threshold.
            first = self._scored(manifest, largest, asked, sure, depth, schema, largest.get("first", 0)).where("doc IS NOT NULL")
            best = ranked(first.select("qid", F.struct("segment", "tile", "doc").alias("id"), "score"), depth).where(F.col("rank") == depth)
            found = {r["qid"]: r["score"] for r in best.select("qid", "score").collect()}  # a number for each query of the part
            sure = np.array([found.get(q, -np.inf) - SLACK for q, _ in asked])
        out = None
        for s in segments:
            out = self._union(out, self._scored(manifest, s, asked, sure, depth, schema))
        return out

    def _scored(self, manifest: dict, segment: dict, asked: list, sure: np.ndarray, depth: int, schema: T.StructType, tile: int | None = None) -> DataFrame:
        terms = sorted({t for _, own in asked for t, _ in own})
        shared = self.spark.sparkContext.broadcast((asked, sure))
        postings, gone = self._postings(segment), self._gone(manifest).where(F.col("segment") == segment["name"]).select("tile", "doc")
        if len(terms) <= 1_000:
            postings = postings.where(F.col("term").isin(terms))
        else:
            wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
            postings = postings.join(F.broadcast(wanted), "term", "left_semi")
        if tile is not None:
            postings, gone = postings.where(F.col("tile") == tile), gone.where(F.col("tile") == tile)
        name, kind = segment["name"], to_arrow_type(schema["qid"].dataType)
        arrow = pa.schema([("qid", kind), ("segment", pa.string()), ("tile", pa.int32()), ("doc", pa.int32()), ("score", pa.float64()), ("postings", pa.int64()), ("read", pa.int64())])

        def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            queries, start = shared.value
            gone = right.column("doc").to_numpy().astype(np.int64)
            lists = {}
            for row in range(left.num_rows):
                docs, title, body = (np.asarray(left.column(c)[row].values, np.int64) for c in ("docs", "title", "body"))
                lists[left.column("term")[row].as_py()] = docs, TITLE_WEIGHT * title + BODY_WEIGHT * body
            columns: list[list] = [[] for _ in range(5)]
            for i, (_, own) in enumerate(queries):
                docs, scores, total, read = tile_hits(lists, gone, own, depth, start[i])
                for column, values in zip(columns, ([i] * len(docs) + [i], [*docs.tolist(), None], [*scores.tolist(), None], [0] * len(docs) + [total], [0] * len(docs) + [read])):
                    column += values
            qids = pa.array([q for q, _ in queries], kind).take(pa.array(columns[0], pa.int64()))
            n = len(columns[0])
            tiles = pa.array([key[0].as_py()] * n, pa.int32())
            return pa.Table.from_arrays([qids, pa.array([name] * n, pa.string()), tiles, *(pa.array(c, t.type) for c, t in zip(columns[1:], list(arrow)[3:]))], schema=arrow)

        return postings.groupBy("tile").cogroup(gone.groupBy("tile")).applyInArrow(score, schema)

    # Tables of the folders.

    def _read(self, folder: str, name: str) -> DataFrame:
        read = self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read  # an empty table may have no file
        return read.parquet(f"{self.path}/{folder}/{name}")

    def _postings(self, segment: dict) -> DataFrame:
        """(tile, term, docs, title, body) of a segment, as a table bucketed by tile."""
        place = f"{self.path}/{segment['name']}/postings"
        name = f"segment_{hashlib.sha256(place.encode()).hexdigest()[:20]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TABLES['postings']}) USING parquet CLUSTERED BY (tile) SORTED BY (tile, term) INTO {segment['tiles']} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _gone(self, manifest: dict) -> DataFrame:
        """(segment, tile, doc) of all replaced or deleted documents."""
        out = self.spark.createDataFrame([], TABLES["gone"])
        for c in manifest["changes"]:
            out = out.unionByName(self._read(c["folder"], "gone"))
        return out

    def _live(self, manifest: dict) -> DataFrame:
        """(segment, tile, doc, id) of live documents."""
        out = self.spark.createDataFrame([], T.StructType.fromJson(manifest["ids"])).selectExpr("'' AS segment", "0 AS tile", "0 AS doc", "id")
        for s in manifest["segments"]:
            out = out.unionByName(self._read(s["name"], "ids").select(F.lit(s["name"]).alias("segment"), "tile", "doc", "id"))
        return out.join(self._gone(manifest), ["segment", "tile", "doc"], "left_anti")

    @staticmethod
    def _size(manifest: dict) -> int:
        return sum(s["docs"] for s in manifest["segments"]) - sum(n for c in manifest["changes"] for s, n in c["gone"].items() if s in {x["name"] for x in manifest["segments"]})

    @staticmethod
    def _count(rows: DataFrame, manifest: dict) -> tuple[int, int]:
        count = rows.count()
        return count, -(-count // manifest["tile_docs"])

    @staticmethod
    def _folder(number: int) -> str:
        return f"part-{number + 1:010d}-{uuid.uuid4().hex[:8]}"

    def _tile_numbers(self, tiles: int) -> list[int]:
        """A number for each tile, such that a shuffle by it, and the buckets of the postings, hold one tile each."""
        return tile_numbers(self.spark, tiles)

    @staticmethod
    def _numbered(rows: DataFrame, numbers: list[int]) -> DataFrame:
        """``rows`` with their tile, and their number in it by id; dealt out by tile."""
        dealt = tiled(rows, numbers)
        return dealt.withColumn("doc", (F.row_number().over(Window.partitionBy("tile").orderBy("id")) - 1).cast("int"))

    def _write_ids(self, ids: DataFrame, folder: str) -> int:
        ids.write.parquet(f"{self.path}/{folder}/ids")
        return self._read(folder, "ids").count()

    def _write_postings(self, rows: DataFrame, folder: str, tiles: int) -> None:
        """From (tile, doc, term, tf_title, tf_body); rows that are dealt by tile are not shuffled."""
        entry = F.struct("doc", F.col("tf_title").cast("int").alias("t"), F.col("tf_body").cast("int").alias("b"))
        lists = rows.groupBy("tile", "term").agg(F.sort_array(F.collect_list(entry)).alias("z"))
        lists = lists.select("tile", "term", F.col("z.doc").alias("docs"), F.col("z.t").alias("title"), F.col("z.b").alias("body"))
        name = f"writing_{uuid.uuid4().hex[:16]}"
        place = f"{self.path}/{folder}"
        lists.repartition(max(1, tiles), "tile").write.bucketBy(max(1, tiles), "tile").sortBy("tile", "term").format("parquet").option("path", f"{place}/postings").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay, as their place was given
        sizes = self._read(folder, "postings").groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
        sizes.write.parquet(f"{place}/df")

    def _replace(self, number: int, manifest: dict, folder: str, count: int, numbers: list[int]) -> int:
        """Mark what the ids of the new folder replace, and commit."""
        fresh = self._read(folder, "ids").select("id")
        gone = self._live(manifest).join(fresh, "id", "left_semi").select("segment", "tile", "doc")
        gone.write.parquet(f"{self.path}/{folder}/gone")
        gone = self._read(folder, "gone")
        sizes = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
        minus = self.spark.createDataFrame([], TABLES["minus"])
        for s in manifest["segments"]:
            if s["name"] in sizes:
                own = gone.where(F.col("segment") == s["name"]).select("tile", "doc")
                touched = self._postings(s).join(own.select("tile").distinct(), "tile", "left_semi")
                terms = touched.select("tile", "term", F.explode("docs").alias("doc")).join(own, ["tile", "doc"], "left_semi")
                minus = minus.unionByName(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(F.lit(s["name"]).alias("segment"), "term", "df"))
        minus.write.parquet(f"{self.path}/{folder}/minus")
        segments = manifest["segments"] + ([{"name": folder, "docs": count, "tiles": len(numbers), "first": numbers[0]}] if numbers else [])
        changes = manifest["changes"] + ([{"folder": folder, "gone": sizes}] if sizes else [])
        self._commit(number, manifest | {"segments": segments, "changes": changes})
        return count

    def _commit(self, number: int, manifest: dict) -> None:
        names = {s["name"] for s in manifest["segments"]}
        manifest = manifest | {"changes": [c for c in manifest["changes"] if names & set(c["gone"])]}
        self.manifests.commit(number + 1, manifest)
        numbers = self.manifests.numbers()
        for n in numbers[:-KEPT]:
            self.manifests.remove(f"manifest-{n:010d}.json")
        kept = [self.manifests.read(n) for n in numbers[-KEPT:]]
        named = {s["name"] for m in kept for s in m["segments"]} | {c["folder"] for m in kept for c in m["changes"]}
        for name in self.manifests.names():
            if name.startswith("part-") and name not in named and int(name[5:15]) <= numbers[-1]:
                self.manifests.remove(name)
