"""Reading, listing and searching notes (source, title, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Matches that a search returns for each mode; the search tool's feature.
MATCHES = 50
#: Where a mode searches.
COLUMNS = {"title": "title", "content": "text"}


def inside(path: str, root: str) -> bool:
    """Whether a path is the root or below it (``/notes-x`` is not below ``/notes``)."""
    return path == root.rstrip("/") or path.startswith(root.rstrip("/") + "/")


def read_file(notes: DataFrame, source: str) -> str:
    """The text of one note; an error where there is none."""
    row = notes.where(F.col("source") == source).select("text").first()
    if row is None:
        raise FileNotFoundError(source)
    return row[0]


def listing(notes: DataFrame, folder: str = "") -> DataFrame:
    """(name): the direct children of a folder."""
    prefix = folder.rstrip("/") + "/" if folder else ""
    below = notes.where(F.col("source").startswith(prefix)).select(F.substring("source", len(prefix) + 1, 1 << 30).alias("rest"))
    return below.select(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name")).distinct()


def grep(notes: DataFrame, pattern: str, modes: tuple[str, ...] = ("title", "content"), matches: int = MATCHES) -> DataFrame:
    """(source, mode): notes whose title or text has the pattern, the first ``matches`` new ones of each mode by source.

    A note found in an earlier mode is not found again. The pattern is a Java regular expression.
    """
    mode = F.coalesce(*(F.when(F.col(COLUMNS[m]).rlike(pattern), F.lit(i)) for i, m in enumerate(modes)))
    found = notes.select("source", mode.alias("ordinal")).where("ordinal IS NOT NULL")
    first = found.groupBy("source").agg(F.min("ordinal").alias("ordinal"))
    first = first.withColumn("mode", F.element_at(F.array(*map(F.lit, modes)), F.col("ordinal") + 1))
    order = Window.partitionBy("ordinal").orderBy("source")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= matches).select("source", "mode")
