"""Incremental ingest: a file stream of Markdown tables to chunks, exactly once per file, no state kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tomegrid.operators.chunking import chunk_documents_strict

MARKDOWN = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("text", T.StringType())])


def ingest_available(spark: SparkSession, source: str, target: str, checkpoint: str, *, glob: str = "*.parquet") -> DataFrame:
    """Chunk every file that hasn't been ingested yet, append to ``target``, stop; returns what ``target`` holds."""
    stream = spark.readStream.schema(MARKDOWN).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(source)
    query = chunk_documents_strict(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
