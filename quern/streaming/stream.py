"""An entity as a stream (an extension): documents appended after the start arrive in later batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.entities import Entities
from quern.plans.schema import field


def read_stream(entities: Entities, max_files: int | None = None) -> DataFrame:
    r = entities.spark.readStream.schema(entities.stored)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(entities.path).select(*[field(F.col(f"`{f.name}`"), f).alias(f.name) for f in entities.schema.fields])


def copy_stream(source: Entities, target: Entities, checkpoint: str):
    """Append all that is in source, and was not copied before, to target.

    Batches are appended as any other write (a file sink's own log would hide files that others wrote); a batch
    that is run again after a failure is appended again, so keys may repeat."""
    return read_stream(source).writeStream.foreachBatch(lambda df, _: target.append_now(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
