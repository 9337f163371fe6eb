"""Queries over the entity engine, and their SQL.

Each stores a whole driver table as an entity in a database of its own and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import documents as D
from quern.operators.entities import Entities
from quern.operators.versions import VersionedEntities, history, latest
from quern.plans.schema import SchemaError
from quern.plans.transaction import TransactionNotFound, TransactionOrder
from quern.sources.database import Database, EntityExists, EntityNotFound, scratch
from quern.sources.pagefile import export_entities, import_entity
from quern.streaming.stream import copy_stream

I, L, S = T.IntegerType(), T.LongType(), T.StringType()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_key(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.name != key, {"key": True} if f.name == key else {}) for f in schema.fields])


def _stored(spark: SparkSession, sf_dir: str, name: str, key: str, times: int = 1) -> Entities:
    df = _table(spark, sf_dir, name)
    e = Database(spark, scratch(spark)).entities(name, _with_key(df.schema, key))
    for _ in range(times):
        e.insert(df)
    return e


def get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "customer", "c_custkey").get_all()


def insert_append_dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "nation", "n_nationkey", 2).get_all()


def read_unknown_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey", 2)
    return e.db.get("nation", T.StructType([T.StructField("n_name", S)])).get_all()


def read_missing_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey", 2)
    reader = T.StructType([T.StructField("n_nationkey", I, False, {"key": True}), T.StructField("age", I, False), T.StructField("note", S)])
    return e.db.get("nation", reader).get_all()


def read_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    return e.db.get("nation", T.StructType([T.StructField("n_nationkey", L, False, {"key": True}), T.StructField("n_regionkey", T.DoubleType())])).get_all()


def read_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    return e.db.get("nation", T.StructType([T.StructField("n_nationkey", I, False, {"key": True}), T.StructField("N_NAME", S)])).get_all()


def read_nested_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested name stored in another case only is not stored; one beside it is."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Region")).alias("of"), F.array(F.struct(F.col("n_name").alias("Tag"))).alias("tags"))
    e = Database(spark, scratch(spark)).entities("nation", _with_key(df.schema, "n_nationkey"))
    e.insert(df)
    inner = T.StructType([T.StructField("NAME", S), T.StructField("Region", I)])
    reader = T.StructType([T.StructField("n_nationkey", I, False, {"key": True}), T.StructField("of", inner), T.StructField("tags", T.ArrayType(T.StructType([T.StructField("tag", S)])))])
    out = e.db.get("nation", reader).get_all()
    return out.select("n_nationkey", F.col("of.NAME").alias("upper"), F.col("of.Region").alias("region"), F.size("tags").alias("n_tags"), F.col("tags")[0]["tag"].alias("tag"))


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> Entities:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))
    docs = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("head"), "lines")
    e = Database(spark, scratch(spark)).entities("orders", _with_key(docs.schema, "o_orderkey"))
    e.insert(docs)
    return e


def nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _orders_with_lines(spark, sf_dir).get_all()
    return docs.select("o_orderkey", F.col("head.o_orderstatus").alias("o_orderstatus"), F.explode("lines").alias("l")).select("o_orderkey", "o_orderstatus", "l.l_linenumber", "l.l_quantity")


def array_filter_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _orders_with_lines(spark, sf_dir).get_all()
    kept = F.filter("lines", lambda x: x["l_linenumber"] != 1)
    more = F.concat(kept, F.array(F.struct(F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))))
    return docs.select("o_orderkey", F.size(more).cast("long").alias("n_lines"), F.aggregate(more, F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


def increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field raised by one, stored as a new entity and read again."""
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    to = e.db.entities("later", e.schema)
    to.insert(e.get_all().withColumn("n_regionkey", F.col("n_regionkey") + 1))
    return to.get_all()


def identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    return e.get_all().select(D.identifier(e.schema), "n_name")


def doc_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    return e.get_all().select("n_nationkey", D.document_size(e.schema).alias("doc_bytes"))


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "nation", "n_nationkey")
    return e.get_all().select("n_nationkey", F.lower(F.hex(D.document_bytes(e.schema))).alias("doc_hex"))


def pagefile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities written to one page file, and one of them imported again."""
    e = _stored(spark, sf_dir, "nation", "n_nationkey", 20)
    df = _table(spark, sf_dir, "region")
    other = e.db.entities("region", _with_key(df.schema, "r_regionkey"))
    other.insert(df)
    at = f"{scratch(spark, 'pages')}.db"
    export_entities(at, other, e)
    return import_entity(Database(spark, scratch(spark)), at, "nation", e.schema).get_all()


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is raised where the catalog, a transaction or a key forbids a step."""
    df = _table(spark, sf_dir, "region")
    db = Database(spark, scratch(spark))
    schema = _with_key(df.schema, "r_regionkey")
    e = db.create("region", schema)

    def out_of_order() -> None:
        outer, _ = db.transaction(), db.transaction()
        try:
            outer.commit()
        finally:
            while db.transactions.current is not None:
                db.transactions.current.rollback()

    steps = {
        "create twice": lambda: db.create("region", schema), "get what is not there": lambda: db.get("Region", schema), "commit the outer one first": out_of_order,
        "stage without a transaction": lambda: db.transactions.stage(e, df), "a null key": lambda: e.insert([{"r_regionkey": None, "r_name": "x"}]), "no object": lambda: e.insert([5]),
    }
    rows = []
    for name, step in steps.items():
        try:
            step()
            rows.append((name, "nothing"))
        except (EntityExists, EntityNotFound, TransactionNotFound, TransactionOrder, SchemaError) as x:
            rows.append((name, type(x).__name__))
    return spark.createDataFrame(rows, "step string, raised string")


def to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored(spark, sf_dir, "nation", "n_nationkey").get_all().select("n_nationkey", "n_name")
    return df.select(D.to_json(df).alias("js"))


def transaction_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner commit stays when the outer transaction is rolled back."""
    df = _table(spark, sf_dir, "region")
    db = Database(spark, scratch(spark))
    e = db.entities("region", _with_key(df.schema, "r_regionkey"))
    outer = db.transaction()
    e.insert(df)
    with db.transaction():
        e.insert(df)
        e.insert(df)
    outer.rollback()
    return e.get_all()


def update_by_id_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir, "region", "r_regionkey")
    e.update_by_id({"r_regionkey": 1, "r_name": "elsewhere"}, 1)
    e.save()
    return e.get_all()


def get_histories_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "region", "r_regionkey").get_histories()


def ext_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_stored(spark, sf_dir, "events", "event_id").get_all().select("user_id", "event_id", "event_type"), "user_id", "event_id")


def ext_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(_stored(spark, sf_dir, "events", "event_id").get_all().select("user_id", "event_id"), "user_id", "event_id")


def ext_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    v = VersionedEntities(Database(spark, scratch(spark)), "customer", _with_key(df.schema, "c_custkey"))
    v.upsert(df)
    v.upsert(df.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)))
    return v.current()


def ext_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored(spark, sf_dir, "nation", "n_nationkey").get_all()
    v = df.select(D.as_variant(df).alias("v"))
    return v.select(F.variant_get("v", "$.n_nationkey", "int").alias("n_nationkey"), F.try_variant_get("v", "$.n_name", "string").alias("n_name"))


def ext_stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _stored(spark, sf_dir, "orders", "o_orderkey")
    target = source.db.entities("copy", source.schema)
    copy_stream(source, target, f"{source.db.path}-stream").awaitTermination()
    return target.get_all()


QUERIES = {
    f.__name__: f
    for f in (
        get_all, insert_append_dup_keys, read_unknown_skipped, read_missing_default, read_widened, read_case_sensitive, read_nested_case, nested_roundtrip, array_filter_concat, identifier, doc_size,
        doc_bytes, pagefile_roundtrip, errors, increment, to_json, transaction_nesting, update_by_id_stub, get_histories_stub, ext_latest, ext_history, ext_update, ext_variant, ext_stream_copy,
    )
}

ORACLES = {
    "get_all": "SELECT * FROM customer",
    "insert_append_dup_keys": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "read_unknown_skipped": "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation",
    "read_missing_default": "SELECT n_nationkey, 0::INT AS age, NULL::VARCHAR AS note FROM nation UNION ALL SELECT n_nationkey, 0, NULL FROM nation",
    "read_widened": "SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey FROM nation",
    "read_case_sensitive": 'SELECT n_nationkey, NULL::VARCHAR AS "N_NAME" FROM nation',
    "read_nested_case": "SELECT n_nationkey, NULL::VARCHAR AS upper, n_regionkey AS region, 1::INT AS n_tags, NULL::VARCHAR AS tag FROM nation",
    "increment": "SELECT n_nationkey, n_name, (n_regionkey + 1)::INT AS n_regionkey FROM nation",
    "doc_bytes": "SELECT n_nationkey, lower('07' || printf('%02x', n_nationkey) || '0000001303000000' || '0b000000' || hex(encode('n_nationkey')) || '07' || printf('%02x', n_nationkey) || '000000' || '06000000' || hex(encode('n_name')) || '02' || printf('%02x', strlen(n_name)) || '000000' || hex(encode(n_name)) || '0b000000' || hex(encode('n_regionkey')) || '07' || printf('%02x', n_regionkey) || '000000') AS doc_hex FROM nation",
    "pagefile_roundtrip": "SELECT nation.* FROM nation, range(20)",
    "errors": "SELECT * FROM (VALUES ('create twice', 'EntityExists'), ('get what is not there', 'EntityNotFound'), ('commit the outer one first', 'TransactionOrder'), ('stage without a transaction', 'TransactionNotFound'), ('a null key', 'SchemaError'), ('no object', 'SchemaError')) t(step, raised)",
    "nested_roundtrip": "SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "array_filter_concat": "SELECT o_orderkey, count(*) FILTER (WHERE l_linenumber <> 1) + 1 AS n_lines, coalesce(sum(l_quantity) FILTER (WHERE l_linenumber <> 1), 0) + 1.0::DOUBLE AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "identifier": "SELECT n_nationkey AS _id, n_name FROM nation",
    "doc_size": "SELECT n_nationkey, (65 + strlen(n_name))::INT AS doc_bytes FROM nation",
    "to_json": "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name})::VARCHAR AS js FROM nation",
    "transaction_nesting": "SELECT * FROM region UNION ALL SELECT * FROM region",
    "update_by_id_stub": "SELECT * FROM region",
    "get_histories_stub": "SELECT * FROM region WHERE false",
    "ext_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "ext_history": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS ver FROM events",
    "ext_update": "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer",
    "ext_variant": "SELECT n_nationkey, n_name FROM nation",
    "ext_stream_copy": "SELECT * FROM orders",
}
