"""Exact dedup by deterministic block naming, in DataFrame functions only.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are
sorted and named by their place; then adjacent pairs of names are named again, level
by level, until each document has one integer. Two documents get the same integer if
and only if their normalised texts are equal: names come from comparing whole blocks
and whole pairs, never from a hash alone. A 64-bit digest only carries block names
back to the rows; digests that stand for several blocks are resolved on the full
block, so a digest collision costs time and not correctness.

Scale: blocks and pairs are made distinct on the map side, so a hot group of copies
sends one row per task; names go back by joins whose name side is unique per key,
which AQE can split on the other side. Texts are shuffled once, distinct blocks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import id_and_text, materialize

#: The run of white space that counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 8192


def _blocks(docs: DataFrame, block_chars: int, digest_bits: int, with_text: bool) -> DataFrame:
    norm = docs.select("doc_id", F.regexp_replace("text", WHITE_SPACE, " ").alias("norm"))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.when(F.length("norm") <= block_chars, F.array("norm")).otherwise(
            F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
        )
    )
    if with_text:
        rows = norm.select(F.explode(cut).alias("block"))
    else:
        rows = norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), cut.alias("blocks")).select(
            "doc_id", "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block")
        )
    digest = F.shiftrightunsigned(F.xxhash64("block"), 64 - digest_bits) if digest_bits < 64 else F.xxhash64("block")
    return rows.withColumn("digest", digest)


def _name_blocks(docs: DataFrame, block_chars: int, digest_bits: int) -> DataFrame:
    """Level 0: (doc_id, sha, n_blocks, copies, pos, name), one row per block of each distinct (doc_id, text)."""
    texts = _blocks(docs, block_chars, digest_bits, True)
    # Distinct blocks, sorted in each hash partition; the place in that order is the name.
    named = (
        texts.groupBy("digest", "block").agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("digest", "block")
        .select("digest", F.monotonically_increasing_id().alias("name"))
    )
    named = materialize(named, "block-names")
    per_digest = named.groupBy("digest").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    slim = _blocks(docs, block_chars, digest_bits, False)
    keys = ["doc_id", "sha", "n_blocks", "pos"]
    shared = per_digest.where("n > 1").select("digest")
    if shared.isEmpty():
        rows = slim.select(*keys, "digest").join(named, "digest")
    else:
        # The digest is not enough here: sorted blocks of a digest take its sorted names.
        several = materialize(shared, "shared-digests")
        names = named.join(several, "digest", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_list("name")).alias("names"))
        distinct = texts.join(several, "digest", "left_semi").groupBy("digest", "block").agg(F.count(F.lit(1)).alias("n"))
        ranked = distinct.groupBy("digest").agg(F.sort_array(F.collect_list("block")).alias("sorted"))
        exact = ranked.join(names, "digest").select(
            "digest", F.explode(F.arrays_zip(F.col("sorted").alias("block"), F.col("names").alias("name"))).alias("z")
        ).select("digest", F.col("z.block").alias("block"), F.col("z.name").alias("name"))
        plain = slim.select(*keys, "digest").join(per_digest.where("n = 1").select("digest", "name"), "digest")
        rows = plain.unionByName(slim.join(exact, ["digest", "block"]).select(*keys, "digest", "name"))
    return rows.select(*keys, "name").groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("copies"))


def _name_pairs(level: DataFrame) -> DataFrame:
    """From (doc_id, sha, n_blocks, copies, pos, name) to the same with half the positions."""
    pairs = level.groupBy("doc_id", "sha", "n_blocks", "copies", F.shiftright("pos", 1).alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = materialize(pairs, "pairs")
    named = (
        pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("left", "right")
        .select("left", "right", F.monotonically_increasing_id().alias("name"))
    )
    named = materialize(named, "pair-names")
    return pairs.join(named, ["left", "right"]).select("doc_id", "sha", "n_blocks", "copies", "pos", "name")


def exact_identity(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digest_bits: int = 64
) -> DataFrame:
    """(doc_id, sha, n_blocks, copies, name): (n_blocks, name) is equal exactly where texts are.

    ``copies`` counts repeated input rows of one (doc_id, text).
    """
    level = materialize(_name_blocks(id_and_text(docs, id_col, text_col), block_chars, digest_bits), "level-0")
    ready = level.where("n_blocks = 1").drop("pos")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    level, width = level.where("n_blocks > 1"), 1
    while width < most:
        width *= 2
        level = materialize(_name_pairs(level), "level")
        ready = ready.unionByName(level.where(F.col("n_blocks") <= width).drop("pos"))
        level = level.where(F.col("n_blocks") > width)
    return ready.select("doc_id", "sha", "n_blocks", "copies", "name")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digest_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one
    space. The smallest doc_id of a group stays. Null text is the empty text; empty
    texts form one group. Repeated rows (same id and text) count in group_size and
    only one of them is kept. A null doc_id never wins against another id. An empty
    table gives an empty result; other columns are not read.
    """
    ident = exact_identity(docs, id_col, text_col, block_chars, digest_bits)
    groups = ident.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").cast("long").alias("group_size"))
    # Most groups are one row; only the others come back by a join, whose sides AQE can split.
    several = materialize(groups.where("group_size > 1"), "groups")
    joined = ident.join(several, ["n_blocks", "name"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
