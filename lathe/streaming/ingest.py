"""Documents that keep arriving: a file stream through the same per-document transforms into the store.

Documents are whole rows, so no watermark or state is needed; a batch that runs twice replaces its own documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lathe.operators.chunks import process
from lathe.plans.rules import schema
from lathe.sources.store import Store

SCHEMA = "document_id string, document_type string, text string"


def stream_documents(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of documents (SCHEMA) as they appear below path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(documents: DataFrame, store_path: str, checkpoint: str, document_type: str) -> StreamingQuery:
    """Chunks documents of one type batch by batch into the store; ends when nothing is left. Documents of other types go to <store>/quarantine with the reason, a folder a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        mine = F.coalesce(F.col("document_type") == document_type, F.lit(False))
        rows = rows.persist()
        try:
            others = rows.where(~mine).withColumn("error", F.concat(F.lit("no schema here for "), F.coalesce("document_type", F.lit("null"))))
            others.write.mode("overwrite").parquet(f"{store_path}/quarantine/batch={number}")  # a batch that runs twice leaves one
            rows = rows.where(mine)
            if not rows.isEmpty():
                store = Store(rows.sparkSession, store_path)
                store.save_chunks(process(rows.select("document_id", "text"), schema(document_type)), rows)
                store.save_documents(rows.select("document_id", "document_type"))
        finally:
            rows.unpersist()

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
