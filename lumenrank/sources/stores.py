"""Reading and writing the evaluation files: judgments, generated queries, splits, runs and the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumenrank.operators.relevance import gain

_SOURCE = "array<struct<retriever:string,chunk_id:string,rank:int,score:double>>"
JUDGMENTS = (
    "version int, queries map<string,struct<query_text:string,created_at:string,annotations:map<string,struct<score:int,text:string,metadata:map<string,string>,"
    f"sources:{_SOURCE},created_at:string,updated_at:string>>>>"
)
#: Canned rows of a static source, at most: it is a fixture for tests.
CANNED = 10_000
QUEUE = "query_key string, chunk_id string, chunk_key string, best_rank int, runs array<string>, first_seen_at timestamp"


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query_key, query_text, chunk_key, score, text, sources, created_at, updated_at) of a judgment file."""
    raw = spark.read.schema(JUDGMENTS).option("multiLine", True).json(path)
    queries = raw.select(F.explode("queries").alias("query_key", "q"))
    rows = queries.select("query_key", "q.query_text", F.explode("q.annotations").alias("chunk_key", "a"))
    return rows.select("query_key", "query_text", "chunk_key", "a.score", "a.text", "a.sources", "a.created_at", "a.updated_at")


def qrels(judgments: DataFrame, scheme: str = "exponential") -> tuple[DataFrame, DataFrame]:
    """(query_key, chunk_key, gain) and (query_key, id, chunk_key) of judgments."""
    gains = judgments.select("query_key", "chunk_key", gain(F.col("score"), scheme).alias("gain"))
    ids = judgments.select("query_key", "chunk_key", F.explode("sources").alias("s")).where("s.chunk_id IS NOT NULL")
    return gains, ids.select("query_key", F.col("s.chunk_id").alias("id"), "chunk_key").distinct()


def read_generated(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(query, source, passage, type) of a generated-query file; the path prefix goes."""
    schema = "queries array<struct<query:string,source_file:string,passage:string,type:string>>"
    rows = tolerant(spark, path, schema).select(F.explode("queries").alias("r")).select("r.*")
    bare = F.when(F.startswith("source_file", F.lit(prefix)), F.substring("source_file", len(prefix) + 1, 1 << 30)).otherwise(F.col("source_file"))
    return rows.select("query", bare.alias("source"), "passage", "type")


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file, or no rows where it is missing; unreadable content gives nulls."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tolerant_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where it is missing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(query_key, split) of a split file {seed, train, val}."""
    raw = spark.read.schema("seed long, train array<string>, val array<string>").option("multiLine", True).json(path)
    parts = [raw.select(F.explode(s).alias("query_key"), F.lit(s).alias("split")) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


def write_split(split: DataFrame, path: str, seed: int, force: bool = False) -> None:
    """One row {seed, train, val}, lists sorted; an existing split is only replaced by force."""
    lists = {s: F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("query_key")))) for s in ("train", "val")}
    row = split.agg(*(v.alias(k) for k, v in lists.items())).select(F.lit(seed).alias("seed"), "train", "val")
    row.coalesce(1).write.mode("overwrite" if force else "errorifexists").json(path)


def write_run(run_id: str, config: DataFrame, metrics: DataFrame, per_query: DataFrame, folder: str) -> None:
    """A run's three tables, partitioned by run; another run leaves them alone."""
    for name, rows in (("config", config), ("metrics", metrics), ("per_query", per_query)):
        rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{folder}/{name}")


def read_runs(spark: SparkSession, folder: str, name: str = "metrics") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return tolerant(spark, path, QUEUE)


def read_metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, name, split, kind, metrics) of the metrics files ``<folder>/<run>/metrics.json``; metrics by name, without those that are null."""
    blocks = "struct<annotated:map<string,double>,generated:map<string,double>>"
    raw = spark.read.schema(f"run_id string, name string, train {blocks}, val {blocks}").option("multiLine", True).json(f"{folder}/*/metrics.json")
    split = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("own")) for s in ("train", "val"))))
    rows = raw.select("run_id", "name", split.alias("s")).select("run_id", "name", "s.split", "s.own")
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("own")[k].alias("metrics")) for k in ("annotated", "generated"))))
    out = rows.select("run_id", "name", "split", kind.alias("k")).select("run_id", "name", "split", "k.kind", "k.metrics").where("metrics IS NOT NULL")
    return out.withColumn("metrics", F.map_filter("metrics", lambda _, v: v.isNotNull()))


def read_per_query(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The records of one run from ``<folder>/<run>/per_query.json`` (one array), or else ``per_query.jsonl``; unknown fields are left out."""
    schema = "query string, query_key string, kind string, split string, metrics map<string,double>, results array<struct<rank:int,id:string,source:string,score:double,gain:int,judged:boolean>>"
    whole = f"{folder}/{run_id}/per_query.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).option("multiLine", True).json(whole)
    return spark.read.schema(schema).json(f"{whole}l")


def write_experiment(per_query: DataFrame, metrics: DataFrame, settings: DataFrame, stamp: str, folder: str) -> None:
    """All runs of an experiment at once: run ids are the stamp and the setting's name."""
    run_id = F.concat(F.lit(f"{stamp}-"), F.col("setting"))
    for name, rows in (("config", settings), ("metrics", metrics), ("per_query", per_query)):
        rows.withColumn("run_id", run_id).write.mode("append").partitionBy("run_id").parquet(f"{folder}/{name}")


def write_sample(sources: DataFrame, path: str, least_chars: int) -> None:
    """One row {min_characters, num_samples, samples}: a seeded sample of notes, which is bounded by its size parameter."""
    row = sources.agg(F.array_sort(F.collect_list("source")).alias("samples"))
    row.select(F.lit(least_chars).alias("min_characters"), F.size("samples").alias("num_samples"), "samples").coalesce(1).write.mode("overwrite").json(path)


def append_generated(rows: DataFrame, path: str, model: str, temperature: float) -> None:
    """Add generated queries (query, source_file, passage, type), each with its model; finished notes are kept by every append."""
    rows.withColumns({"model": F.lit(model), "temperature": F.lit(temperature)}).write.mode("append").json(path)


def static_results(spark: SparkSession, path: str, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """(qid, rank, row): for every query the same canned rows of a JSON file (one array), all or the first ``top_k``; ``row`` is JSON."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "row"))
    items = items if top_k is None else items.where(F.col("i") < top_k)
    return queries.select("qid").crossJoin(F.broadcast(items.limit(CANNED))).select("qid", (F.col("i") + 1).alias("rank"), "row")
