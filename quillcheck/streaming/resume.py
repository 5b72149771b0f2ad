"""Going on with a corpus that arrives in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(
    spark: SparkSession, source: str, schema, output: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000
) -> DataFrame:
    """Run ``step`` over the parquet files that earlier runs have not seen, then stop.

    The checkpoint remembers the files, and the parquet sink commits each batch once, so a
    run that breaks off is taken up where it stopped. Returns the whole output so far.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        step(arriving)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(output)
