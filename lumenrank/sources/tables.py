"""Keyed tables in a folder, changed by whole commits.

Rows lie in a fixed number of buckets by a hash of the key. A change writes the touched
buckets to new files and then a manifest that says where each bucket lies now; the manifest's
appearance under its number is the commit. Readers take the highest manifest, so they see the state before or after a change
and never one between, and a crash leaves the old state. Of two writers that start from
one state, the second fails.

A manifest also holds a digest of each bucket's rows and one of all buckets. ``sync`` digests the other table in one pass and goes no
further where they agree; only buckets that differ are read, and only those with changed rows are written.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenrank.operators.keyed import newest, once
from lumenrank.sources.manifests import Manifests

BUCKETS = 64
#: Manifests, and the files that only they name, that stay for readers that are under way.
KEPT = 3


class Synced(NamedTuple):
    """Rows of the other table, how many of them were new or other, and the buckets that were written again."""

    affected: int
    changed: int
    buckets: list[int]


def row_digest(columns: list[str]):
    """sha256 of a row as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}), 256)


def root_digest(digests: dict[str, str]) -> str:
    return hashlib.sha256(",".join(f"{b}={d}" for b, d in sorted(digests.items())).encode()).hexdigest()


class KeyedTable:
    """A table with one row for each key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.manifests = Manifests(spark, self.path)

    def state(self) -> tuple[int, dict]:
        """The number of the last commit (0: none) and its manifest."""
        number, manifest = self.manifests.last()
        return number, manifest or {"buckets": {}, "schema": None, "of": self.buckets, "digests": {}}

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None where nothing was ever written."""
        return self._rows(self.state()[1], only)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        folders = [f"{self.path}/{d}" for b, d in manifest["buckets"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, of: int):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(of)).cast("int")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Put rows in by key; only their buckets are written again. Of rows with one key the last by ``order`` counts.

        With an order, a stored row that is later than the batch's stays, whichever batch comes first. Returns the number of rows that
        were put in, counted while they are written.
        """
        rows = once(rows, self.key) if order is None else newest(rows, self.key, order)
        number, manifest = self.state()
        of = manifest["of"]
        batch = f"part-{number + 1:010d}-{uuid.uuid4().hex[:8]}"
        # The batch is stored first: it is read several times, and may be costly or change.
        rows.withColumn("_bucket", self._bucket(of)).write.parquet(f"{self.path}/{batch}/in")
        fresh = self.spark.read.parquet(f"{self.path}/{batch}/in")
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most one for each bucket
        stored = self._rows(manifest, touched)
        fresh = fresh.drop("_bucket")
        if stored is None:
            merged = fresh.withColumn("_new", F.lit(True))
        elif order is None or order not in stored.columns:
            merged = stored.join(fresh.select(self.key), self.key, "left_anti").withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        else:
            both = stored.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)), allowMissingColumns=True)
            last = Window.partitionBy(self.key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
            merged = both.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
        put = Observation()
        counted = merged.observe(put, F.count_if("_new").alias("rows")).drop("_new")
        counted.withColumn("_bucket", self._bucket(of)).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{batch}/out")
        self.manifests.remove(f"{batch}/in")
        places = manifest["buckets"] | {str(b): f"{batch}/out/_bucket={b}" for b in touched}
        written = self.spark.read.schema(counted.schema).parquet(*(f"{self.path}/{places[str(b)]}" for b in touched)) if touched else counted.limit(0)
        digests = manifest.get("digests", {}) | self._digests(written, of)
        self._commit(number, {"buckets": places, "schema": counted.schema.jsonValue(), "of": of, "digests": digests, "root": root_digest(digests)})
        return put.get["rows"]

    def sync(self, source: DataFrame) -> Synced:
        """Put every row of another table in by key, and say how many rows that has, how many differ and which buckets were written.

        Rows that the source lacks stay. The source is read once for its digests, and again only for buckets that differ.
        """
        number, manifest = self.state()
        if manifest["schema"] is None or StructType.fromJson(manifest["schema"]).names != source.columns:
            count = self.upsert(source)
            return Synced(count, count, sorted(map(int, self.state()[1]["buckets"])))
        of = manifest["of"]
        total = Observation()
        theirs = self._digests(source.observe(total, F.count(F.lit(1)).alias("rows")), of)
        count, ours = total.get["rows"], manifest.get("digests", {})
        if root_digest(theirs) == manifest.get("root"):
            return Synced(count, 0, [])
        differ = [int(b) for b, d in theirs.items() if ours.get(b) != d]
        stored = self._rows(manifest, differ)
        fresh = source.where(self._bucket(of).isin(differ)).withColumn("_digest", row_digest(source.columns))
        same = stored.select(F.col(self.key).alias("_key"), row_digest(source.columns).alias("_same"))
        changed = fresh.join(same, (F.col(self.key) == F.col("_key")) & (F.col("_digest") == F.col("_same")), "left_anti").drop("_digest")
        if changed.isEmpty():  # the buckets differ by rows that the source lacks
            return Synced(count, 0, [])
        put = self.upsert(changed)
        after = self.state()[1]["buckets"]
        return Synced(count, put, sorted(int(b) for b, place in after.items() if manifest["buckets"].get(b) != place))

    def _digests(self, rows: DataFrame, of: int) -> dict[str, str]:
        """Digests by bucket; a bucket without rows has none. The order of rows doesn't matter."""
        hashed = rows.select(self._bucket(of).alias("b"), row_digest(rows.columns).alias("d"))
        low = F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)")
        sums = hashed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("s"), F.sum(F.conv(F.substring("d", 17, 15), 16, 10).cast("decimal(38,0)")).alias("t"))
        return {str(r["b"]): f"{r['n']}:{int(r['s']):x}:{int(r['t']):x}" for r in sums.collect()}  # at most one for each bucket

    def _commit(self, number: int, manifest: dict) -> None:
        self.manifests.commit(number + 1, manifest)
        self._clear()

    def _clear(self) -> None:
        """Delete manifests beyond ``KEPT``, and files that no manifest names."""
        numbers = self.manifests.numbers()
        for n in numbers[:-KEPT]:
            self.manifests.remove(f"manifest-{n:010d}.json")
        named = {d.split("/")[0] for n in numbers[-KEPT:] for d in self.manifests.read(n)["buckets"].values()}
        for name in self.manifests.names():
            if name.startswith("part-") and name not in named and int(name[5:15]) <= numbers[-1]:
                self.manifests.remove(name)
