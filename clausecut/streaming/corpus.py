"""New documents as a stream. The transformations keep no state, so the batch code serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clausecut.plans.engine import silver


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_each: int = 100) -> DataFrame:
    """Parquet files of documents as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def write_windows(docs: DataFrame, path: str, checkpoint: str, single_line: bool = False) -> StreamingQuery:
    """Windows of new documents, appended once each; ends when all files there now are done."""
    return silver(docs, single_line).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
