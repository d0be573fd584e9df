"""Page files as a stream: each new batch of a document's pages runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import PAGE


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """(doc, file, raw, page fields) of JSON files as they arrive under ``folder``/<doc>/."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    df = raw.select(path.alias("path"), F.col("value").alias("raw"), F.from_json("value", PAGE).alias("p")).select("path", "raw", "p.*")
    return df.withColumn("doc", F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))


def run_batches(pages: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``each`` (pages, batch id) for every batch; a batch that is replayed has the same id."""
    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
