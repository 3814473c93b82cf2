"""Token counts by scanning flat, unindexed token files for separators.

A token file is nothing but little-endian ids, each document's ids followed by one
end-of-document id. Files are cut into blocks; each block is searched for the separator in one
vectorised comparison; and a prefix scan over the blocks of a file (ids before a
block, documents before it, last separator before it) stitches documents that lie across
blocks. Ids after a file's last separator are an unended document.

Scale: blocks are independent tasks of fixed size, so neither a large file nor a
document of many blocks is read by one task; the scan moves one row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import id_and_text, materialize, scratch, slices
from lumenrank.llm.storage import committed, read_range
from lumenrank.llm.tokens import default_path, encoder, end_of_document, id_type, narrowed

#: The default vocabulary's own end of document.
END_OF_DOCUMENT = 50256
BLOCK_BYTES = 4 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, separator: int | None = None, dtype: str | None = None) -> DataFrame:
    """Write one flat file for each partition; (shard, ordinal, doc_id) says whose documents they hold, in order.

    Ids take two bytes where the vocabulary and the separator fit, else four; a narrower ``dtype`` raises at
    the first id that does not fit. Strings of added tokens are ordinary text, so no text holds a separator; one that is
    an ordinary id of the vocabulary raises, and without one it is ``tokens.end_of_document``.
    """
    path = tokenizer_path or default_path()
    separator = end_of_document(path, separator)
    dtype = dtype or id_type(path, separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, ordinal = encoder(path, literal=True).encode, TaskContext.get().partitionId(), 0
        end = np.array([separator], dtype).tobytes()
        first = next(batches, None)
        if first is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with committed(f"{folder}/part-{shard:06d}.bin") as out:
            for batch in slices(rest(), "text", 4_000_000):
                for text in batch.column("text").to_pylist():
                    out.write(narrowed(encode(text), dtype) + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id")], ["shard", "ordinal", "doc_id"])
                ordinal += n

    docs = id_and_text(docs)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("ordinal", T.LongType()), docs.schema["doc_id"]])
    return materialize(docs.mapInArrow(run, schema), "token-file-order")


def count_tokens(spark: SparkSession, folder: str, separator: int = END_OF_DOCUMENT, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens, ended) for every document of the token files under ``folder``; separators don't count.

    An empty file has no documents; two separators in a row end an empty document.
    """
    width = np.dtype(dtype).itemsize
    step = max(1, block_bytes // width) * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where(F.col("length") >= width)
    whole = F.col("length") - F.col("length") % width
    blocks = files.select("path", whole.alias("whole"), F.posexplode(F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(step).cast("long"))).alias("block", "start"))
    blocks = blocks.withColumn("size", F.least(F.lit(step), F.col("whole") - F.col("start")).cast("long"))
    tasks = max(spark.sparkContext.defaultParallelism, 8)
    blocks = materialize(blocks, "token-blocks").repartition(tasks, F.xxhash64("path", "block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(read_range(row["path"], row["start"], row["size"]), dtype)
                at = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (row["path"], row["block"], len(ids), len(at))]
                    + [pa.array([int(at[0]) if len(at) else None], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    ["path", "block", "ids", "ends", "first", "last", "inner"],
                )

    found = materialize(blocks.select("path", "block", "start", "size").mapInArrow(scan, "path string, block long, ids long, ends long, first long, last long, inner array<long>"), "token-scan")
    slim = found.select("path", "block", "ids", "ends", "last")  # the scan over a file's blocks doesn't carry the lengths
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = slim.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    stitched = stitched.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(-1)))
    stitched = materialize(stitched, "token-bases")
    lengths = F.concat(F.array(F.col("base") + F.col("first") - F.col("open") - 1), F.col("inner"))
    whole = stitched.where("ends > 0").select("path", "block", "base", "open", "ordinal").join(found.select("path", "block", "first", "inner"), ["path", "block"])
    ended = whole.select("path", "ordinal", F.posexplode(lengths).alias("i", "n_tokens"))
    ended = ended.select("path", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    totals = found.groupBy("path").agg(F.sum("ids").alias("ids"), F.sum("ends").alias("ordinal"))
    last = stitched.groupBy("path").agg(F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)).alias("last"))
    rest = totals.join(last, "path").select("path", "ordinal", (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def document_token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, shard, ordinal, by way of token files in the shared folder.

    Null text is the empty text with no tokens. Repeated rows and null ids are counted each.
    An empty table gives no rows; other columns are not read.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "token-files")
    order = write_token_files(docs, folder, tokenizer_path)
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "shard", "ordinal")
    path = tokenizer_path or default_path()
    end = end_of_document(path, None)
    counts = count_tokens(spark, folder, end, id_type(path, end)).withColumn("shard", F.regexp_extract("path", r"part-(\d+)\.bin$", 1).cast("int"))
    return order.join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal")
