"""Runs a streaming query over what a source holds now and gives its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..staging import shared_dir


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that the stream gives for all input there is, written by its sink in the shared folder."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{top}/out")

    def last(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{top}/out")

    q = stream.writeStream.foreachBatch(last).option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")
