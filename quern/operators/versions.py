"""Updates and histories (an extension): documents are appended with a version, never rewritten.

A version is claimed by making a file of its number, so writers at the same time have different ones.  Rows of a key
in one upsert follow each other by ``_seq``, which is stored with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.entities import Entities
from quern.plans.schema import build, key_of
from quern.sources.database import Database

VERSION, SEQ, CLAIMS = "_version", "_seq", "_versions"
RANGES = 32


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The row of the highest version of each key.  Partial maxima are taken before the shuffle, so a hot key costs one row a task."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*version)).alias("_row"))
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def history(df: DataFrame, key: str, *version: str, number: str = "ver", ranges: int = RANGES) -> DataFrame:
    """All rows, numbered within their key from the oldest.  The first version column is a number; it is cut
    into ranges, rows are numbered within key and range, and what a key has in earlier ranges is added: a hot key's
    rows are in as many tasks."""
    cuts = df.agg(F.percentile_approx(version[0], [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<long>")
    rows = df.withColumn("_range", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(version[0]))), F.lit(-1)))
    n = rows.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_r")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*version))
    out = rows.withColumn("_own", own).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias(number))


class VersionedEntities:
    """An entity whose documents can be updated by key."""

    def __init__(self, db: Database, name: str, schema: object):
        self.db, self.document = db, build(schema)
        self.key = key_of(self.document)
        more = [T.StructField(VERSION, T.LongType(), True), T.StructField(SEQ, T.LongType(), True)]
        self.entities: Entities = db.entities(name, T.StructType([*self.document.fields, *more]))

    def _claim(self) -> int:
        """The next version, for this writer alone.  Claims before the last one are cleared away."""
        fs, folder = self.db._file_system(f"{self.entities.path}/{CLAIMS}")
        fs.mkdirs(folder)
        taken = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder))
        mine = taken[-1] + 1 if taken else 1
        while not self.db._write_once(f"{self.entities.path}/{CLAIMS}/{mine}", ""):
            mine += 1
        for n in taken[:-1]:
            fs.delete(self.db._file_system(f"{self.entities.path}/{CLAIMS}/{n}")[1], False)
        return mine

    def upsert(self, values: DataFrame) -> None:
        self.entities.insert(values.withColumn(VERSION, F.lit(self._claim()).cast("long")).withColumn(SEQ, F.monotonically_increasing_id()))

    def current(self) -> DataFrame:
        return latest(self.entities.get_all(), self.key, VERSION, SEQ).drop(VERSION, SEQ)

    def histories(self) -> DataFrame:
        return history(self.entities.get_all(), self.key, VERSION, SEQ).drop(VERSION, SEQ)
