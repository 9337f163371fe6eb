"""A database is a folder; each entity in it is a Parquet dataset of its own."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from quern.operators.entities import Entities
from quern.plans.schema import build
from quern.plans.transaction import Transaction, TransactionManager


class EntityNotFound(KeyError):
    """No entity has that name."""


class EntityExists(ValueError):
    """An entity has that name already."""


CREATED = "_created"  # when the database was made


def folder_of(name: str) -> str:
    """A file name that keeps the case of an entity's name even where file systems don't."""
    if not name:
        raise ValueError("an entity needs a name")
    return re.sub(r"[^a-z0-9_\-]", lambda m: "".join(f"%{b:02x}" for b in m[0].encode()), name)


def scratch(spark: SparkSession, name: str = "db") -> str:
    """A new folder that all executors reach, for databases that need not last."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Database:
    def __init__(self, spark: SparkSession, path: str):
        """Open or create the database at a path of any file system that Spark reads."""
        self.spark, self.path, self.transactions = spark, path.rstrip("/"), TransactionManager()
        self._fs, p = self._file_system(self.path)
        self._fs.mkdirs(p)
        self._write_once(f"{self.path}/{CREATED}", datetime.now(timezone.utc).isoformat())

    def _file_system(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write_once(self, path: str, text: str) -> bool:
        """Make a small file unless there is one; of several that try at once, one does."""
        p = self._file_system(path)[1]
        if self._fs.exists(p):
            return False
        try:
            out = self._fs.create(p, False)
        except Py4JJavaError:
            if self._fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    @property
    def created_at(self) -> datetime:
        file = self._fs.open(self._file_system(f"{self.path}/{CREATED}")[1])
        try:
            return datetime.fromisoformat(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _at(self, name: str) -> str:
        return f"{self.path}/{folder_of(name)}"

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._file_system(self._at(name))[1]))

    def names(self) -> list[str]:
        return sorted(unquote(s.getPath().getName()) for s in self._fs.listStatus(self._file_system(self.path)[1]) if s.isDirectory())

    def entities(self, name: str, schema: object) -> Entities:
        """The entity of that name, created empty if there is none; schema is how this handle reads and writes."""
        return self.get(name, schema) if self.exists(name) else self.create(name, schema)

    def create(self, name: str, schema: object) -> Entities:
        """A new, empty entity; it is an error if there is one of that name."""
        if self.exists(name):
            raise EntityExists(name)
        handle = Entities(self, name, self._at(name), build(schema))
        handle.create()
        return handle

    def get(self, name: str, schema: object) -> Entities:
        if not self.exists(name):
            raise EntityNotFound(name)
        return Entities(self, name, self._at(name), build(schema))

    def transaction(self) -> Transaction:
        return self.transactions.begin()
