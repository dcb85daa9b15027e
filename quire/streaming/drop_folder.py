"""New pages in a folder as cleaned chapters, with Structured Streaming. Beyond the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import clean_html
from quire.operators.filters import reason

PAGES = "page_id bigint, url string, html string"


def stream_chapters(spark: SparkSession, folder: str, schema: str = PAGES, **options) -> DataFrame:
    """A stream of page_id, url, text and filter_reason; stateless, so late files need no watermark."""
    pages = spark.readStream.schema(schema).parquet(folder)
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    out = pages.select("page_id", "url", title.alias("title"), clean_html(F.col("html")).alias("text"))
    return out.withColumn("filter_reason", reason(F.lit(1), F.col("title"), F.col("text"), **options))


def write_chapters(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; each file is taken once, also after a restart."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
