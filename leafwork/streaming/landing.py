"""A landing folder of raw pages as a stream: glyphs to spans to a census of styles, a file batch at a time.

Parsing needs no state; the census keeps one row a style. Files are whole documents, so that what looks at a whole document
(the glyphs that stand for spaces) can run within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwork.functions import geom
from leafwork.sources import readers


def stream_spans(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Glyphs of raw pages as they land."""
    return readers.glyphs(spark.readStream.schema(readers.RAW).option("maxFilesPerTrigger", files).json(folder))


def census(spark: SparkSession, folder: str, checkpoint: str, table: str) -> StreamingQuery:
    """Characters of each style over all files so far, in an in-memory table."""
    style = geom.style_key(F.col("font"), F.col("size"), F.col("color"), F.col("flags"))
    counts = stream_spans(spark, folder).groupBy(style.alias("style")).agg(F.count("*").alias("chars"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
