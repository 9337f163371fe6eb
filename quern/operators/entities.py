"""A typed handle on one entity: scan and append."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.schema import SchemaError, absent, field, key_of, nullable, paths_of, readable

if TYPE_CHECKING:
    from quern.sources.database import Database

FIELDS = "_fields"  # Spark's scans pass over names that begin with an underscore


def _plain(value: object) -> object:
    """A dataclass as nested dicts, in the order of its fields."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    return [_plain(x) for x in value] if isinstance(value, list) else value


class Entities:
    def __init__(self, db: Database, name: str, path: str, schema: T.StructType):
        self.db, self.spark, self.name, self.path, self.schema = db, db.spark, name, path, schema
        self.stored = nullable(schema)

    # --- catalog ---

    def create(self) -> None:
        self._note_fields()  # first: data without its names would read as defaults
        self.spark.createDataFrame([], self.stored).write.mode("append").parquet(self.path)

    def _known_fields(self) -> dict[str, str]:
        """Paths and types that were ever written."""
        fs, p = self.db._file_system(f"{self.path}/{FIELDS}")
        if not fs.exists(p):
            return {}
        return dict(sorted(r["value"].split("\t") for r in self.spark.read.text(f"{self.path}/{FIELDS}").distinct().collect()))

    def _note_fields(self) -> None:
        """Keep the names that were ever written, at any depth: files alone cannot tell a name's case from another's cheaply."""
        known = self._known_fields()
        new = [(f"{p}\t{t}",) for p, t in paths_of(self.stored).items() if p not in known]
        if new:
            self.spark.createDataFrame(new, "value string").coalesce(1).write.mode("append").text(f"{self.path}/{FIELDS}")

    # --- scan ---

    def get_all(self) -> DataFrame:
        """All documents, in no order.  Lazy; every call lists the files anew, so it sees what was appended before it."""
        # names are case-sensitive: one that is stored in another case only is not stored
        known = self._known_fields()
        df = self.spark.read.schema(readable(self.stored, known)).parquet(self.path)
        return df.select(*[(field(F.col(f"`{f.name}`"), f, known, f.name) if f.name in known else absent(f)).alias(f.name, metadata=f.metadata) for f in self.schema.fields])

    # --- append ---

    def _frame(self, values: DataFrame | Iterable[object]) -> DataFrame:
        """The values as a frame of the stored schema; a null key fails when it is written."""
        k = key_of(self.schema)
        if isinstance(values, DataFrame):
            lost = [n for n in self.schema.names if n not in values.columns]
            if lost:
                raise SchemaError(f"{self.name}: the frame lacks {', '.join(lost)}")
            df = values.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.stored.fields])
            guard = F.when(F.col(f"`{k}`").isNull(), F.raise_error(F.lit(f"{self.name}: the key {k} is null"))).otherwise(F.col(f"`{k}`"))
            return df.select(*[guard.alias(n) if n == k else F.col(f"`{n}`") for n in df.columns])
        rows = []
        for v in values:
            if v is None or isinstance(v, (str, list, int)):
                raise SchemaError(f"{self.name}: a document is an object, not {v!r}")
            row = v.asDict(recursive=True) if isinstance(v, T.Row) else _plain(v)
            if row.get(k) is None:
                raise SchemaError(f"{self.name}: the key {k} is null")
            rows.append({n: row.get(n) for n in self.schema.names})
        return self.spark.createDataFrame(rows, self.stored)

    def insert(self, values: DataFrame | Iterable[object]) -> None:
        """Append documents (a frame, or an iterable of dataclass instances, Rows or dicts) in one write.

        Keys need not be unique.  Inside a transaction the write waits for its commit."""
        df = self._frame(values)
        if self.db.transactions.current is not None:
            self.db.transactions.stage(self, df)
            return
        with self.db.transaction() as t:
            t.stage(self, df)

    def append_now(self, df: DataFrame) -> None:
        self._note_fields()
        df.write.mode("append").parquet(self.path)

    # --- declared, without effect ---

    def update_by_id(self, value: object, key: object) -> None:
        """Checks the value as ``insert`` would; stores nothing.  See operators.versions for updates that do."""
        self._frame([value])

    def save(self) -> None:
        """Does nothing: inserts are stored when their transaction commits."""

    def get_histories(self) -> DataFrame:
        """Always empty.  See operators.versions for histories."""
        return self.spark.createDataFrame([], self.stored)
