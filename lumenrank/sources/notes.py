"""Reading notes and building chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.functions.text import chunk_id, chunks, clean, title_of

SUFFIXES = ("md", "txt")


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, least_chars: int = 0) -> DataFrame:
    """(source, title, text) of files below a folder, by exact suffix; a missing folder is an error.

    ``source`` is the path below the folder. Files shorter than ``least_chars`` are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:  # other files are not opened
        reader = reader.option("pathGlobFilter", "*.{%s}" % ",".join(suffixes))
    files = reader.load(folder).select("path", "content")
    tail = F.regexp_extract("path", r"([^/]*)$", 1)
    wanted = files.where(tail.rlike(rf"\.({'|'.join(suffixes)})$")) if suffixes else files
    root = F.lit(folder.rstrip("/").removeprefix("file://") + "/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/")
    rows = wanted.select(F.replace(path, root, F.lit("")).alias("source"), F.decode("content", "UTF-8").alias("text"))
    stem = F.regexp_replace(F.regexp_extract("source", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.where(F.length("text") >= least_chars).select("source", title_of(stem).alias("title"), "text")


def to_chunks(notes: DataFrame, most: int = 2000, least: int = 200, overlap: int = 50, normalise: bool = True) -> DataFrame:
    """(id, chunk_index, source, title, text) of notes: cleaned and cut. One narrow plan, no shuffle.

    An empty note has no chunks, so it needs no filter, for which Spark would clean every text twice.
    """
    cleaned = notes.select("source", "title", clean(F.col("text"), normalise).alias("text"))
    rows = cleaned.select("source", "title", F.posexplode(chunks(F.col("text"), most, least, overlap)).alias("chunk_index", "text"))
    return rows.select(chunk_id(F.col("source"), F.col("chunk_index")).alias("id"), "chunk_index", "source", "title", "text")
