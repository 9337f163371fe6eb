"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import io
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: ASCII whitespace as the operators' contracts define it.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"

#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: what the session names.  Only where it names none and driver and executors are
    one process (tests), one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        path = jsc.getCheckpointDir().get()
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context: their Python path may not have it.  And make
    Arrow batches smaller than Spark's default, so that Python workers hold fewer texts at a time."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    at = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(at)  # executors fetch it with their tasks
    sc._quern_shipped = True


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quern-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans that are no longer referenced."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # the JVM objects are let go by a thread
        spark.sparkContext._jvm.System.gc()


def map_pandas(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas, but integers stay integers where some are null (as floats, large ids would lose digits)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(b.to_pandas(types_mapper=kinds.get) for b in batches):
            yield pa.RecordBatch.from_pandas(out, fields, preserve_index=False)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """df with columns that Python works out from each Arrow batch; all others pass as they are.  A column of
    df by the name of a new one gives way to it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    added = df.sparkSession.createDataFrame([], schema).schema
    names = {x.lower() for x in added.names}
    own = [x for x in df.columns if x.lower() not in names]
    fields = to_arrow_schema(added)
    result = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in [*(df.schema[c] for c in own), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = f(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(new[x.name], x.type) for x in fields)], names=[*own, *added.names])

    return df.mapInArrow(run, result)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of an id's decimal text, modulo m: the folds of the labelled operators."""
    return F.crc32(c.cast("string").cast("binary")) % m
