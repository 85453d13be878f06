"""Track files as a stream.

Most operators are stateless and take a streaming table as they are: headers,
selections in time and space, the reference join and the polygon join with a
static side that fits a broadcast. Here are the two ends of such a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from ..sources.readers import as_tracks


def stream_tracks(spark: SparkSession, path: str, schema, format: str = "csv") -> DataFrame:
    """New track files below ``path`` as they arrive. The schema is required."""
    reader = spark.readStream.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    return as_tracks(reader.format(format).load(path))


def append_parquet(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append what is there now to ``path``, exactly once, and stop.

    Progress is kept under the shared folder by ``name``, so a restarted job
    goes on where the last one ended.
    """
    progress = f"{shared_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", progress).trigger(availableNow=True).start(path)
    )
