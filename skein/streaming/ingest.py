"""Incremental ingest: new files are chunked and upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.ids import chunk_id
from skein.operators.chunking import chunk_text
from skein.sources.store import TableStore


def chunks_of(files: DataFrame, size: int, overlap: int) -> DataFrame:
    keyed = files.withColumn("_key", F.struct("path", "file_hash", "seq"))
    parts = chunk_text(keyed, "_key", "content", size, overlap)
    path, file_hash = F.col("_key.path"), F.col("_key.file_hash")
    return parts.select(chunk_id(path, F.col("chunk_index"), file_hash).alias("id"), path.alias("file_path"), file_hash.alias("file_hash"), F.col("_key.seq").alias("seq"), "chunk_index", "total_chunks", "start_line", "end_line", "token_count", "text_content")


def ingest(spark: SparkSession, source: str, schema: str, store: TableStore, checkpoint: str, size: int = 400, overlap: int = 64) -> StreamingQuery:
    """Reads parquet files of (path, file_hash, seq, content) as they come; a file's chunks replace those of its older
    versions, and replayed batches change nothing. Processes what is there and stops."""

    def write(batch: DataFrame, _: int) -> None:
        new = chunks_of(batch, size, overlap)
        newest = batch.groupBy(F.col("path").alias("file_path")).agg(F.max("seq").alias("newest"))
        every = store.read("chunks").unionByName(new) if store.exists("chunks") else new
        kept = every.join(newest, "file_path", "left").where("newest IS NULL OR seq >= newest").drop("newest")
        store.overwrite("chunks", kept.dropDuplicates(["id"]))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
