"""Groups of similar shingle sets from buckets of candidates, without all pairs.

A vertex is a set that some documents share; a bucket holds vertices that may be similar. A bucket
first links its members to its most central member, verified on whole sets, so a group of near copies
costs a link for each member. Buckets that still hold several components are compared across components:
up to ``TILE`` members as a tile of bitmaps, which rule most pairs out, and the others, each once
however many tiles it is in, on whole sets; larger ones in blocks of whole sets. So every two vertices that share a bucket are
either in one component or decided exactly. From those larger buckets the vertices leave before that
whose shingles can't reach the similarity with other components.

Pairs of blocks of a large bucket are dealt to tasks in strips: with P blocks there are about
sqrt(P) strips of as many blocks, each strip is a key of its own, and every block goes to the strips at or before its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.bitmaps import may_link, signature, tile_candidates
from lumenrank.llm.common import BROADCAST_ROWS, discard, materialize, passing, rows_of, slices, small_side
from lumenrank.llm.components import components

BATCH_BYTES = 2_000_000
#: Members of a tile of bitmaps, which then takes about as many bytes as a block of whole sets; larger buckets are compared in blocks.
TILE = 4_096

#: From a text: the name of its set, its buckets, the set's size; None where the text has no set.
Sketcher = Callable[[str], "tuple[bytes, np.ndarray, int] | None"]
#: From a text: the name of its set and the sorted 64-bit hashes of the set's elements.
Reader = Callable[[str], "tuple[bytes, np.ndarray]"]
#: From two blocks of {v, label, shingles} (or the same one twice) and a similarity: links between different components.
Comparer = Callable[[list, list, float], "list[tuple[int, int]]"]


def sketch(docs: DataFrame, sketcher: Sketcher, done: Callable[[], None] = lambda: None) -> DataFrame:
    """(doc_id, name, buckets, size), in the shared folder; name is null where a text has no set. ``done`` runs at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [sketcher(t) or (None, None, 0) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "name", "buckets", "size"])
        done()

    schema = docs.select("doc_id").schema.add("name", T.BinaryType()).add("buckets", T.ArrayType(T.LongType())).add("size", T.LongType())
    return materialize(docs.mapInArrow(run, schema), "sketches")


def vertices(sketched: DataFrame) -> DataFrame:
    """(v, name, one, buckets, size): one row for each set, numbered; ``one`` is a document that has it."""
    sets = sketched.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("one"), F.first("buckets").alias("buckets"), F.max("size").alias("size"))
    return materialize(sets.select(F.monotonically_increasing_id().alias("v"), "name", "one", "buckets", "size"), "vertices")


def bucket_members(found: DataFrame, sent: int) -> DataFrame:
    """(bucket, v, size, n): members of buckets that n > 1 vertices share.

    Most shared buckets hold two, which the smallest and the largest member give at once; only members of larger ones are looked up.
    """
    spread = found.select("v", F.explode("buckets").alias("bucket"))
    counted = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    shared = materialize(counted.where("n > 1"), "shared-buckets")
    two = shared.where("n = 2").select("bucket", F.explode(F.array("lo", "hi")).alias("v"), "n")
    many = shared.where("n > 2").select("bucket", "n")
    if many.count() > sent:
        rest = passing(spread, "bucket", many.select("bucket")).join(many, "bucket")
    else:
        rest = spread.join(F.broadcast(many), "bucket")
    sizes = small_side(found.select("v", "size"), sent)
    members = materialize(two.unionByName(rest.select("bucket", "v", "n")).join(sizes, "v"), "members")
    discard(shared)
    return members


def read_sets(docs: DataFrame, wanted: DataFrame, reader: Reader, sent: int, done: Callable[[], None] = lambda: None) -> DataFrame:
    """(v, size, bits, shingles) for the wanted (v, name, one), each from one document; bits is the set's bitmap. In the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [reader(t) for t in batch.column("text").to_pylist()]
            # An id that stands for several texts brings them all: only the vertex's own text counts.
            own = [f[0] == name for f, name in zip(found, batch.column("name").to_pylist())]
            sets = [f[1].tobytes() if keep else b"" for f, keep in zip(found, own)]
            bits = [signature(f[1]) if keep else None for f, keep in zip(found, own)]
            columns = [batch.column("v"), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["v", "size", "bits", "shingles"]).filter(pa.array(own, pa.bool_()))
        done()

    rows = rows_of(docs, wanted.withColumnRenamed("one", "doc_id"), "doc_id", sent)
    out = rows.select("v", "name", "text").mapInArrow(run, "v long, size long, bits binary, shingles binary")
    return materialize(out.dropDuplicates(["v"]), "shingle-sets")  # repeated rows bring a set twice


def beside(pairs: DataFrame, sets: DataFrame, columns: list[str], sent: int) -> DataFrame:
    """Written pairs (a, b) with the sets' columns, as a_<column> and b_<column>.

    Up to ``sent`` pairs go to the sets by broadcast, so that only the sets of pairs are shuffled; of more pairs the sets pass a filter first.
    """
    one, two = (F.col("v").alias(side) for side in "ab")
    held = [[F.col(c).alias(f"{side}_{c}") for c in columns] for side in "ab"]
    if pairs.count() <= sent:
        given = F.broadcast(pairs)
        return sets.select(one, *held[0]).join(given, "a").join(sets.select(two, *held[1]).join(given, "b"), ["a", "b"])
    sets = passing(sets.select("v", *columns), "v", pairs.select("a").union(pairs.select("b")))
    return pairs.join(sets.select(two, *held[1]), "b").join(sets.select(one, *held[0]), "a")


def sieved(pairs: DataFrame, sets: DataFrame, percent: int, sent: int) -> DataFrame:
    """Those of written pairs (a, b) that their bitmaps can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x, percent) for x in zip(*(batch.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_size", "b_size")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = beside(pairs, sets, ["bits", "size"], sent)
    return rows.select("a", "b", "a_bits", "b_bits", "a_size", "b_size").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, sent: int) -> DataFrame:
    """Those of written pairs (a, b) whose sets are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a_shingles"), batch.column("b_shingles")
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = beside(pairs, sets, ["shingles"], sent)
    return rows.select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a long, b long")


def similar(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct numbers reach the Jaccard similarity."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small) or len(small) < similarity * len(large) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= similarity * (len(one) + len(two) - both) - 1e-9


def leader_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Each bucket's members beside its most central one, as distinct pairs of sizes that can be so similar: central is who meets most others over all its buckets."""
    central = members.groupBy("v").agg(F.sum("n").alias("met"))
    best = F.max(F.struct("met", "v", "size"))
    leaders = members.join(central, "v").groupBy("bucket").agg(best["v"].alias("leader"), best["size"].alias("leader_size"))
    near = F.least("size", "leader_size") >= similarity * F.greatest("size", "leader_size") - 1e-6
    pairs = members.join(materialize(leaders, "leaders"), "bucket").where((F.col("v") != F.col("leader")) & near)
    return pairs.select(F.least("leader", "v").alias("a"), F.greatest("leader", "v").alias("b")).distinct()


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, v, size, label, total, n): the members of buckets with several components; of equal buckets one."""
    named = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    buckets = named.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"),
        F.min("v").alias("v0"), F.max("v").alias("v1"), F.sum(F.shiftright(F.xxhash64("v"), 20)).alias("h"),
    )
    one = buckets.where("lo != hi").groupBy("n", "total", "v0", "v1", "h").agg(F.min("bucket").alias("bucket"))
    return materialize(named.drop("n").join(materialize(one.select("bucket", "n", "total"), "mixed-buckets"), "bucket"), "mixed")


def counted(members: DataFrame) -> DataFrame:
    """``members`` (bucket, v, size, label) with n and total of their buckets, without those of one component."""
    left = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = materialize(left.where("lo != hi").select("bucket", "n", "total"), "mixed-buckets")
    return members.drop("n", "total").join(left, "bucket")


def linkable(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """v of those among ``members`` (v, label) that can have a link to another component's member.

    A set's similarity to any set of other components is at most the share of its shingles
    that those hold at all; one where that is too small has no link and leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, label, held in zip(*(batch.column(c) for c in ("v", "label", "shingles"))):
                own = pa.array(np.frombuffer(held.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.repeat(v, len(own)), pa.repeat(label, len(own)), own], ["v", "label", "s"])

    tokens = materialize(members.join(sets.select("v", "shingles"), "v").mapInArrow(run, "v long, label long, s long"), "tokens")
    across = materialize(tokens.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("s", F.lit(1).alias("hit")), "across")
    held = tokens.select("v", "s").join(across, "s", "left").groupBy("v").agg(F.count("hit").alias("shared"), F.count(F.lit(1)).alias("size"))
    out = materialize(held.where(F.col("shared") >= similarity * F.col("size") - 1e-6).select("v"), "linkable")
    for used in (tokens, across):
        discard(used)
    return out


def tile_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): distinct pairs of members of different components that their bitmaps can't rule out, in buckets of at most a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column("rows"):
                found = tile_candidates(tile.as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    rows = mixed.select("bucket", "v", "label", "size").join(sets.select("v", "bits"), "v")
    tiles = rows.groupBy("bucket").agg(F.collect_list(F.struct("v", "label", "size", "bits")).alias("rows"))
    return tiles.select("rows").mapInArrow(run, "a long, b long").distinct()


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(rows, others): every two blocks of a bucket, from (bucket, part, parts, rows), dealt by (bucket, strip)."""
    width = F.ceil(F.sqrt("parts")).cast("long")
    own = F.floor(F.col("part") / width).cast("long")
    strips = blocks.select("bucket", own.alias("strip"), F.col("part").alias("part1"), "rows")
    others = blocks.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("strip"), F.col("part").alias("part2"), F.col("rows").alias("others"))
    # The strip's few blocks are on the right, where a sort-merge join holds a key's rows.
    return others.join(strips, ["bucket", "strip"]).where("part1 < part2").select("rows", "others")


def blocked_links(mixed: DataFrame, sets: DataFrame, similarity: float, compare: Comparer, block: int, block_bytes: int) -> DataFrame:
    """Links (a, b) across components within buckets; every two members of different components are compared."""
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("total") * 8 / block_bytes)).cast("long")
    rows = mixed.join(sets.select("v", "shingles"), "v").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    blocks = rows.groupBy("bucket", "part").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("v", "label", "shingles")).alias("rows"))
    blocks = materialize(blocks, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("rows"), batch.column("others")):
                one = x.as_py()
                found += compare(one, y.as_py() or one, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    alone = blocks.select("rows", F.lit(None).cast(blocks.schema["rows"].dataType).alias("others"))
    pairs = alone.unionByName(block_pairs(blocks.where("parts > 1")))
    out = materialize(pairs.mapInArrow(run, "a long, b long").distinct(), "links")
    discard(blocks)
    return out


def link(
    docs: DataFrame, found: DataFrame, reader: Reader, compare: Comparer, similarity: float, block: int, block_bytes: int,
    deal: Callable[[DataFrame], DataFrame] = lambda large: large, done: Callable[[], None] = lambda: None, sent: int = BROADCAST_ROWS, tile: int = TILE,
) -> DataFrame:
    """(v, label) for every vertex with a link: the components of all links between vertices that share a bucket.

    ``deal`` may cut large buckets (bucket, v, size, label) further, as long as vertices that can be linked still meet.
    Up to ``sent`` slim rows go to the executors by broadcast.
    """
    members = bucket_members(found, sent)
    if members.isEmpty():
        return found.select("v", F.col("v").alias("label")).limit(0)
    percent = math.floor(similarity * 100 + 1e-9)
    sets = read_sets(docs, members.select("v").distinct().join(found.select("v", "name", "one"), "v"), reader, sent, done)

    def check(pairs: DataFrame) -> DataFrame:
        return materialize(verified(materialize(pairs, "pairs"), sets, similarity, sent), "links")

    links = check(sieved(materialize(leader_pairs(members, similarity), "leader-pairs"), sets, percent, sent))
    mixed = mixed_buckets(members, components(links))
    large = mixed.where(F.col("n") > tile)
    columns = ["bucket", "v", "size", "label", "n", "total"]
    if not large.isEmpty():
        narrowed = large.join(linkable(large.select("v", "label").distinct(), sets, similarity), "v", "left_semi")
        narrowed = counted(deal(narrowed.select("bucket", "v", "size", "label")))
        mixed = materialize(mixed.where(F.col("n") <= tile).select(columns).unionByName(narrowed.select(columns)), "mixed")
        large = mixed.where(F.col("n") > tile)
    links = links.union(check(tile_pairs(mixed.where(F.col("n") <= tile), sets, percent)))
    if not large.isEmpty():
        links = links.union(blocked_links(large, sets, similarity, compare, block, block_bytes))
    labels = components(links)
    for used in (sets, members):
        discard(used)
    return labels


def grouped(sketched: DataFrame, found: DataFrame, labels: DataFrame, by_size: bool = False) -> DataFrame:
    """(doc_id, group_id, group_size, copy), and the size if wanted: a row for each row of ``sketched``.

    group_id is the group's smallest doc_id; a null doc_id never wins against another. ``copy`` numbers the rows of an id within its group
    (and size, if wanted). Documents without a set are groups of their own.
    """
    own = ["doc_id", "size"] if by_size else ["doc_id"]
    named = found.select("name", "v").join(labels, "v", "left").select("name", F.coalesce("label", "v").alias("label"))
    copies = sketched.where("name IS NOT NULL").groupBy("name", *own).agg(F.count(F.lit(1)).alias("copies")).join(named, "name")
    groups = copies.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_size"))
    together = copies.groupBy("label", *own).agg(F.sum("copies").alias("copies"))
    # Most groups are one row; only the others come back by a join, whose sides AQE can split.
    several = materialize(groups.where("group_size > 1"), "groups")
    out = together.join(several, "label", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = out.select(
        *own, F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "copy",
    )
    alone = sketched.where("name IS NULL").select(*own, F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("copy"))
    return out.unionByName(alone)
