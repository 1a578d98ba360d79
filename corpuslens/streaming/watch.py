"""Watching a folder of documents: micro-batches that skip what has not changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, hash, epoch: of every document what its last batch brought."""
    rows = spark.read.schema("doc_id long, hash string, epoch long").parquet(path)
    return rows.groupBy("doc_id").agg(F.max_by("hash", "epoch").alias("hash"), F.max("epoch").alias("epoch"))


def ingest_available(spark: SparkSession, schema: T.StructType, source: str, state: str) -> DataFrame:
    """doc_id, hash of everything that a stream over `source` has ingested up to now; `state` holds the checkpoint and the table.

    Each batch writes documents whose hash differs from the stored one to a folder of its own, so a batch that
    is run again replaces what it wrote. A text that goes back to an earlier one is a change like any other.
    """
    path = f"{state}/documents"
    spark.createDataFrame([], "doc_id long, hash string").write.mode("ignore").parquet(f"{path}/epoch=-1")

    def upsert(batch: DataFrame, epoch: int) -> None:
        known = stored(batch.sparkSession, path).where(F.col("epoch") != epoch)
        rows = batch.select("doc_id", F.sha2("text", 256).alias("hash")).dropDuplicates(["doc_id"])
        rows.join(known, ["doc_id", "hash"], "left_anti").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    # A single file is watched by its folder and name.
    folder, _, name = source.rpartition("/")
    single = spark.read.format("binaryFile").load(source).select("path").limit(1).collect()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(source) if single and f"{name}/" in single[0].path else reader.option("pathGlobFilter", name).parquet(folder)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stored(spark, path).select("doc_id", "hash")
