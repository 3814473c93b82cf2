"""Shared helpers: durable intermediates, bounded batches, word scans."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.session import shared_folder

#: A-Z to a-z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder for each application."""
    return f"{shared_folder(spark)}/lumenrank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything that this application's operators wrote to the shared folder; results that are still read from there go too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lumenrank/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage durably (a lost executor loses nothing), gives Spark real
    sizes for its join choice, and fixes anything that depends on partitioning.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/lumenrank/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch between Spark and Python, at most: texts are long, so the usual 10,000 rows would hold much memory on both sides.
BATCH_ROWS = 1_000
ARROW_BYTES = 4_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut to ``BATCH_ROWS`` and ``ARROW_BYTES``; smaller settings stay.

    Spark reads these settings when a plan runs, after an operator has returned, so they can't be put back here.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = conf.get(key)
        if not (held.lstrip("-").isdigit() and 0 < int(held) <= most):
            conf.set(key, str(most))
    return df


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can't clash; null text is empty."""
    return bounded(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: So many slim rows are sent to the executors, at most (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the filter that is sent in place of more rows; 64 of them are a row, so its size is fixed.
FILTER_BITS = 1 << 26


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (written before, as it is counted), marked for a broadcast join if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def rows_of(docs: DataFrame, wanted: DataFrame, id_col: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``docs`` beside those of ``wanted`` with the same id, a null id included; ``wanted`` has other columns besides the id.

    Up to ``most`` wanted rows are broadcast. Beyond, a bit filter of the wanted ids, of a fixed size, is broadcast first,
    so that only documents which pass it are shuffled to meet the ids.
    """
    wanted = wanted.withColumnRenamed(id_col, "_wanted")
    same = F.col(id_col).eqNullSafe(F.col("_wanted"))
    if wanted.count() <= most:
        return docs.join(F.broadcast(wanted), same).drop("_wanted")
    return passing(docs, id_col, wanted.select("_wanted")).join(wanted, same).drop("_wanted")


def passing(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is no value of the one-column table ``wanted``: those that a broadcast filter of ``FILTER_BITS`` bits lets pass."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    ones = wanted.select(place(wanted.columns[0]).alias("at")).select(F.expr("at div 64").alias("_word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("one"))
    words = ones.groupBy("_word").agg(F.bit_or("one").alias("_bits"))
    placed = rows.withColumn("_at", place(column))
    passed = placed.join(F.broadcast(words), F.expr("_at div 64 = _word")).where("shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1 = 1")
    return passed.drop("_at", "_word", "_bits")


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    _give_back()
