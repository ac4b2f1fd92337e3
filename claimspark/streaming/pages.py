"""New pages as they arrive. The job is stateless, so a stream of files and a batch give the same rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.articles import articles

PAGES = "page_id long, url string, html string"


def extract_new(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of (page_id, url, html) that were not read before and appends their articles; ends when all
    that is there has been read, to be run again by whoever schedules it."""
    pages = spark.readStream.schema(PAGES).parquet(source)
    return articles(pages).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
