"""Stream sources, the ingestion pipeline, retries and dead letters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.ingest import child_chunks, chunk_documents, embed_chunks, number_chunks, parent_chunks
from corpuscope.session import cut_lineage, ensure_checkpoint_dir, release, spread
from corpuscope.sources.files import read_paths
from corpuscope.sources.segments import SegmentIndex
from corpuscope.sources.sinks import read_if_exists

TASK_SCHEMA = ("fileMd5 string, filePath string, fileName string, userId string, orgTag string, isPublic boolean, "
               "taskType string, requesterId string")
REINDEX = "REINDEX"
#: bytes of text whose passages, embeddings and rows are made together; what is made on the way is deleted before the next ones
SLICE_BYTES = 1 << 29


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """File stream with a bounded number of files per micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """JSON task values of a topic as a one-column stream; needs the Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("maxOffsetsPerTrigger", offsets_per_trigger).load())
    return raw.select(F.col("value").cast("string").alias("value"))


def parse_tasks(raw: DataFrame) -> DataFrame:
    """Typed ingestion tasks of a JSON ``value`` column, batch or stream; ``valid`` is false without a file id."""
    task = F.from_json("value", TASK_SCHEMA)
    return raw.withColumn("_t", task).select("value", "_t.*").withColumn("valid", F.coalesce(F.col("fileMd5") != "", F.lit(False)))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is available now into parquet in the shared folder, and return what it wrote."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start(f"{base}/out"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over everything available now; the table of the last micro-batch is the result."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def replace(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{base}/out-{batch_id}")

    query = (stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out-{query.lastProgress['batchId']}")


def index_of(spark: SparkSession, base: str) -> SegmentIndex:
    """The index that the ingestion below ``base`` writes: rows of (file_md5, user_id)."""
    return SegmentIndex(spark, f"{base}/index", ("file_md5", "user_id"), ("file_md5", "chunk_id"))


def statuses(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest status of every (file_md5, user_id): status, reason, chunks, tokens, batch."""
    rows = read_if_exists(spark, f"{base}/status")
    if rows is None:
        return None
    newest = rows.groupBy("file_md5", "user_id").agg(F.max(F.struct("batch", "status", "reason", "chunks", "tokens")).alias("_s"))
    return newest.select("file_md5", "user_id", "_s.*")


def _texts_of(tasks: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(fileMd5, text, reason) of the files that new tasks name: read where they lie, or looked up in ``documents`` (fileMd5, text)."""
    if documents is not None:
        found = tasks.select("fileMd5").distinct().join(documents.select("fileMd5", "text"), "fileMd5", "left")
        return found.withColumn("reason", F.when(F.col("text").isNull(), "FILE_NOT_FOUND"))
    named = tasks.groupBy("fileMd5").agg(F.min("filePath").alias("filePath"))
    return named.join(read_paths(tasks.sparkSession, named.select("filePath")), "filePath", "left").select(
        "fileMd5", "text", F.when(F.col("filePath").isNull(), "NO_FILE_PATH").otherwise(F.coalesce("reason", F.when(F.col("text").isNull(), "FILE_NOT_FOUND"))).alias("reason"))


class _Scratch:
    """Tables that are read several times, written once, compressed, to a folder of their own, until they are cleared."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.many = spark, scratch_path(spark, "work"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.many += 1
        df.write.option("compression", "zstd").parquet(f"{self.path}/{self.many}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.many}")

    def clear(self) -> None:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        release(self.spark)


def ingest_batch(tasks: DataFrame, documents: DataFrame | None, base: str, batch_id: int, embedder=None) -> None:
    """One micro-batch: texts of its tasks, passages, parents, embeddings, index rows and a status row per file and owner.

    A task is known by file and owner. One that an earlier batch completed is not worked again, unless it asks for a new index: then its stored passages are embedded anew, and the
    file is read only if there are none. A file is read and parsed once, however many owners have it. Beyond ``SLICE_BYTES`` of text the files are worked in slices, one after the other, so that the disk
    holds the texts, the index and what one slice needs on the way. The index takes a batch once and hides the rows that it replaces; the status of
    a batch is written in one place, so a batch that runs again replaces its own output.
    """
    spark = tasks.sparkSession
    index = index_of(spark, base)
    key = ["fileMd5", "userId"]
    again = F.upper(F.coalesce("taskType", F.lit(""))) == REINDEX
    wanted = (tasks.where("valid").withColumn("userId", F.coalesce("userId", F.lit(""))).groupBy(*key)
              .agg(F.min("filePath").alias("filePath"), F.max("orgTag").alias("orgTag"), F.bool_or(F.coalesce("isPublic", F.lit(False))).alias("isPublic"), F.bool_or(again).alias("again")))
    status = statuses(spark, base)
    if status is not None:
        done = status.where((F.col("status") == "COMPLETED") & (F.col("batch") != batch_id)).select(F.col("file_md5").alias("fileMd5"), F.col("user_id").alias("userId"))
        wanted = wanted.join(done.withColumn("_done", F.lit(True)), key, "left").where("again OR _done IS NULL").drop("_done")
    wanted = cut_lineage(wanted)
    release(spark)
    whole = _Scratch(spark)
    held = index.read()
    reused = None
    if held is not None:
        asked = wanted.where("again").select(F.col("fileMd5").alias("file_md5"), F.col("userId").alias("user_id"))
        reused = whole.keep(held.join(asked, ["file_md5", "user_id"], "left_semi").select(F.col("file_md5").alias("fileMd5"), F.col("user_id").alias("userId"), "chunk_id", "parent_index", "text", "contextual_text"))
        new = cut_lineage(wanted.join(reused.select(*key).distinct(), key, "left_anti"))
    else:
        new = wanted
    read = whole.keep(_texts_of(new, documents))
    release(spark)
    size = sum(df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0 for df in (read, reused) if df is not None)
    slices, written = max(1, -(-size // SLICE_BYTES)), []

    def parts() -> Iterator[DataFrame]:
        for nth in range(slices):
            some = (lambda df: df.where(F.pmod(F.xxhash64("fileMd5"), F.lit(slices)) == nth)) if slices > 1 else (lambda df: df)
            scratch = _Scratch(spark)
            rows = _rows_of(some(read), some(new), some(wanted), some(reused) if reused is not None else None, scratch, embedder)
            yield rows
            written.append(cut_lineage(rows.groupBy("file_md5", "user_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))))
            scratch.clear()

    index.upsert_parts(parts(), f"batch-{batch_id}")
    index.compact()
    made = written[0]
    for more in written[1:]:
        made = made.unionByName(more)
    states = (wanted.select(*key).join(read.select("fileMd5", "reason"), "fileMd5", "left").withColumnsRenamed({"fileMd5": "file_md5", "userId": "user_id"})
              .join(made, ["file_md5", "user_id"], "left"))
    states = states.select(
        "file_md5", "user_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(F.col("chunks") > 0, "COMPLETED").otherwise("FAILED").alias("status"), F.when(F.col("chunks").isNull(), F.coalesce("reason", F.lit("NO_TEXT"))).alias("reason"), F.lit(batch_id).alias("batch"))
    states.drop("batch").write.mode("overwrite").parquet(f"{base}/status/batch={batch_id}")
    whole.clear()


def _rows_of(read: DataFrame, new: DataFrame, wanted: DataFrame, reused: DataFrame | None, scratch: _Scratch, embedder) -> DataFrame:
    """Index rows of some files: of the texts ``read`` for the tasks ``new``, and of passages that are embedded anew. What is read several times is kept in ``scratch``."""
    key = ["fileMd5", "userId"]
    texts = read.where("reason IS NULL AND text IS NOT NULL").select(F.col("fileMd5").alias("doc_id"), "text")
    passages = scratch.keep(chunk_documents(spread(texts, "doc_id")))
    numbered = number_chunks(passages)
    children = scratch.keep(child_chunks(numbered, parent_chunks(numbered)).select("doc_id", "chunk_id", "parent_index", "text", "contextual_text"))
    bodies = children.withColumnRenamed("doc_id", "fileMd5").join(new.select(*key), "fileMd5")
    if reused is not None:
        bodies = bodies.unionByName(reused)
    # equal passages of several owners are embedded once
    once = scratch.keep(bodies.dropDuplicates(["fileMd5", "chunk_id", "contextual_text"]).select(F.col("fileMd5").alias("doc_id"), "chunk_id", "contextual_text", "text"))
    vectors = embed_chunks(once, **({"embedder": embedder} if embedder else {})).select(F.col("doc_id").alias("fileMd5"), "chunk_id", "contextual_text", "embedding", "tokens", "model_version")
    return scratch.keep(bodies.join(vectors, ["fileMd5", "chunk_id", "contextual_text"]).join(wanted.select(*key, "orgTag", "isPublic"), key).select(
        F.col("fileMd5").alias("file_md5"), F.col("userId").alias("user_id"), "chunk_id", "parent_index", "text", "contextual_text", "embedding", "tokens", "model_version",
        F.col("orgTag").alias("org_tag"), F.col("isPublic").alias("is_public")))


def ingestion_stream(tasks: DataFrame, documents: DataFrame | None, base: str, embedder=None):
    """Start the ingestion of a task stream; index and status tables live below ``base``. Without ``documents`` the files that the tasks name are read."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, documents, base, batch_id, embedder)

    return (tasks.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
