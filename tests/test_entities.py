from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.documents import document_bytes, document_size, to_json
from quern.operators.versions import VersionedEntities, history
from quern.plans.schema import SchemaError, build, key_of
from quern.plans.transaction import TransactionNotFound, TransactionOrder
from quern.sources.database import Database, EntityExists, EntityNotFound, folder_of
from quern.streaming.stream import copy_stream
from tests_support import GOLDEN, Passport, Person, Tag


PEOPLE = [
    Person(1, "Oleksandr", 29, Passport("ST-111111"), [Tag("tag1"), Tag("tag2")]),
    Person(2, "Kate", 28, Passport("ST-222222"), [Tag("tag1"), Tag("tag2")]),
]
K = {"key": True}


def struct(*fields):
    return T.StructType([T.StructField(n, t, null, meta) for n, t, null, meta in fields])


def test_round_trip_sizes_and_json(db):
    e = db.entities("parsons", Person)
    e.insert(PEOPLE)
    rows = {r["Id"]: r for r in e.get_all().collect()}
    assert rows[1]["Name"] == "Oleksandr" and rows[2]["Passport"]["Code"] == "ST-222222" and [t["Name"] for t in rows[1]["Tags"]] == ["tag1", "tag2"]
    assert {r[0]: r[1] for r in e.get_all().select("Id", document_size(e.schema)).collect()} == {1: 151, 2: 146}
    js = e.get_all().where("Id = 2").select(to_json(e.get_all())).first()[0]
    assert js == '{"Id":2,"Name":"Kate","Age":28,"Passport":{"Code":"ST-222222"},"Tags":[{"Name":"tag1"},{"Name":"tag2"}]}'


def test_nulls_are_kept_and_sizes_follow_utf8(db):
    e = db.entities("p", Person)
    e.insert([Person(1, "é", 1, None, None), {"Id": 2, "Name": None, "Age": None, "Passport": {"Code": None}, "Tags": [None, {"Name": None}]}, Person(3, "", 0, None, [])])
    rows = {r["Id"]: r for r in e.get_all().collect()}
    assert rows[1]["Passport"] is None and rows[1]["Tags"] is None and rows[3]["Tags"] == []
    assert rows[2]["Age"] == 0 and rows[2]["Name"] is None and rows[2]["Tags"][0] is None and rows[2]["Passport"]["Code"] is None
    sizes = {r[0]: r[1] for r in e.get_all().select("Id", document_size(e.schema)).collect()}
    base = 5 + 5 + sum(4 + len(n) for n in ("Id", "Name", "Age", "Passport", "Tags")) + 5
    assert sizes[1] == base + 7 + 5 + 1 + 1


def test_no_row_is_lost_whatever_its_size(db):
    e = db.entities("many", Person)
    e.insert([Person(i, "x") for i in range(300)])
    e.insert([Person(1000 + i, "y" * 1000) for i in range(60)])
    e.insert([Person(9999, "z" * 9000)])
    assert e.get_all().count() == 361 and e.get_all().agg(F.max(F.length("Name"))).first()[0] == 9000


def test_scans_see_earlier_appends_and_duplicates_stay(db):
    e = db.entities("p", Person)
    assert e.get_all().count() == 0
    e.insert(PEOPLE)
    first = e.get_all().count()
    e.insert(PEOPLE)
    assert (first, e.get_all().count()) == (2, 4)


def test_reader_schema_decides(db):
    db.entities("p", Person).insert(PEOPLE)
    narrow = db.get("p", struct(("Name", T.StringType(), True, {}), ("Passport", T.StructType([T.StructField("Code", T.StringType()), T.StructField("Country", T.StringType()), T.StructField("Pages", T.IntegerType(), False)]), True, {}), ("Height", T.IntegerType(), False, {}), ("Weight", T.IntegerType(), False, {"default": 70}), ("Extra", T.StringType(), True, {})))
    r = narrow.get_all().where("Name = 'Kate'").first()
    assert (r["Passport"]["Code"], r["Passport"]["Country"], r["Passport"]["Pages"], r["Height"], r["Weight"], r["Extra"]) == ("ST-222222", None, 0, 0, 70, None)
    wide = db.get("p", struct(("Age", T.LongType(), True, {}),)).get_all()
    assert sorted(r[0] for r in wide.collect()) == [28, 29]
    assert [r[0] for r in db.get("p", struct(("NAME", T.StringType(), True, {}),)).get_all().collect()] == [None, None]
    with pytest.raises(Exception):
        db.get("p", struct(("Name", T.IntegerType(), True, {}),)).get_all().collect()


def test_filters_and_columns_reach_the_scan(db):
    e = db.entities("p", Person)
    e.insert(PEOPLE)
    plan = e.get_all().where("Id > 1").select("Name")._jdf.queryExecution().toString()
    assert "GreaterThan(Id,1)" in plan and "ReadSchema: struct<Id:int,Name:string>" in plan


def test_keys(db):
    with pytest.raises(SchemaError):
        key_of(struct(("a", T.IntegerType(), True, {})))
    with pytest.raises(SchemaError):
        key_of(struct(("a", T.ArrayType(T.IntegerType()), True, K)))
    assert key_of(struct(("a", T.StringType(), True, K), ("b", T.IntegerType(), True, K))) == "a"
    e = db.entities("s", struct(("a", T.StringType(), False, K), ("b", T.IntegerType(), True, {})))
    with pytest.raises(SchemaError):
        e.insert([{"a": None, "b": 1}])
    with pytest.raises(Exception, match="null"):
        e.insert(db.spark.createDataFrame([(None, 1)], "a string, b int"))
    with pytest.raises(SchemaError):
        e.insert([None])
    assert e.get_all().count() == 0 and db.transactions.current is None


def test_schemas_that_cannot_be():
    @dataclasses.dataclass
    class Bad:
        x: dict

    for s in (T.StructType([]), struct(("a", T.StructType([]), True, {})), struct(("a", T.IntegerType(), True, {}), ("A", T.IntegerType(), True, {})), struct(("m", T.MapType(T.StringType(), T.StringType()), True, {})), Bad, 5):
        with pytest.raises(SchemaError):
            build(s)


def test_arrays_of_arrays_and_wider_types(db):
    s = struct(("k", T.LongType(), False, K), ("aa", T.ArrayType(T.ArrayType(T.IntegerType())), True, {}), ("d", T.DecimalType(20, 0), True, {}), ("b", T.BooleanType(), False, {}))
    e = db.entities("w", s)
    from decimal import Decimal

    e.insert([{"k": 1, "aa": [[1, None], None, []], "d": Decimal(2**63), "b": None}])
    r = e.get_all().first()
    assert r["aa"] == [[1, None], None, []] and r["d"] == 2**63 and r["b"] is False


def test_catalog(db):
    a, b = db.entities("Persons", Person), db.entities("persons", Person)
    a.insert(PEOPLE)
    assert (a.get_all().count(), b.get_all().count()) == (2, 0) and db.names() == ["Persons", "persons"]
    assert db.exists("persons") and not db.exists("PERSONS") and folder_of("a/b c") == "a%2fb%20c"
    with pytest.raises(EntityNotFound):
        db.get("none", Person)
    assert Database(db.spark, db.path).entities("Persons", Person).get_all().count() == 2


def test_transactions(db):
    e, f = db.entities("p", Person), db.entities("q", Person)
    with pytest.raises(TransactionNotFound):
        db.transactions.stage(e, e.get_all())
    with db.transaction():
        e.insert(PEOPLE)
        f.insert(PEOPLE)
        assert e.get_all().count() == 0
    assert (e.get_all().count(), f.get_all().count()) == (2, 2)
    outer = db.transaction()
    e.insert(PEOPLE)
    inner = db.transaction()
    e.insert(PEOPLE)
    with pytest.raises(TransactionOrder):
        outer.commit()
    assert e.get_all().count() == 2  # checked before anything is written
    inner.commit()
    outer.rollback()
    assert e.get_all().count() == 4
    with pytest.raises(RuntimeError), db.transaction():
        e.insert(PEOPLE)
        raise RuntimeError("no")
    assert e.get_all().count() == 4 and db.transactions.current is None


def test_stubs_versions_and_streams(db):
    e = db.entities("p", Person)
    e.insert(PEOPLE)
    e.update_by_id(Person(1, "other"), 1)
    e.save()
    assert e.get_histories().count() == 0 and e.get_all().where("Name = 'other'").count() == 0
    with pytest.raises(SchemaError):
        e.update_by_id(None, 1)
    v = VersionedEntities(db, "v", Person)
    v.upsert(e.get_all())
    v.upsert(e.get_all().where("Id = 1").withColumn("Age", F.col("Age") + 1))
    assert {r["Id"]: r["Age"] for r in v.current().collect()} == {1: 30, 2: 28}
    assert sorted((r["Id"], r["ver"], r["Age"]) for r in v.histories().collect()) == [(1, 1, 29), (1, 2, 30), (2, 1, 28)]
    to = db.entities("copy", Person)
    for more, n in (([], 2), ([], 2), (PEOPLE, 4)):  # nothing twice, then what is new
        if more:
            e.insert(more)
        copy_stream(e, to, f"{db.path}-stream").awaitTermination()
        assert to.get_all().count() == n


def test_binary_form_is_the_golden_one(db):
    e = db.entities("parsons", Person)
    e.insert(PEOPLE)
    got = {r["Id"]: bytes(r["b"]) for r in e.get_all().select("Id", document_bytes(e.schema).alias("b")).collect()}
    assert [got[1], got[2]] == GOLDEN
    odd = db.entities("odd", struct(("k", T.StringType(), False, K), ("n", T.IntegerType(), True, {}), ("aa", T.ArrayType(T.ArrayType(T.IntegerType())), True, {}), ("o", T.StructType([T.StructField("é", T.StringType())]), True, {})))
    odd.insert([{"k": "é", "n": -2, "aa": [[1, None], None, []], "o": {"é": None}}, {"k": "", "n": None, "aa": None, "o": None}])
    from quern.sources.pagefile import document

    rows = odd.get_all().select(document_bytes(odd.schema).alias("b"), document_size(odd.schema).alias("n")).collect()
    assert [document(bytes(r["b"])) for r in sorted(rows, key=lambda r: -r["n"])] == [{"k": "é", "n": -2, "aa": [[1, None], None, []], "o": {"é": None}}, {"k": "", "n": None, "aa": None, "o": None}]
    assert all(len(r["b"]) == r["n"] for r in rows)
    with pytest.raises(SchemaError):
        document_bytes(struct(("k", T.LongType(), False, K)))


def test_names_are_case_sensitive_at_every_depth(db):
    deep = T.StructType([T.StructField("A", T.StructType([T.StructField("B", T.IntegerType(), False)])), T.StructField("L", T.ArrayType(T.StructType([T.StructField("X", T.IntegerType())])))])
    w = db.entities("w", struct(("k", T.IntegerType(), False, K), ("d", deep, True, {})))
    w.insert([{"k": 1, "d": {"A": {"B": 5}, "L": [{"X": 7}, None]}}, {"k": 2, "d": {"A": None, "L": None}}, {"k": 3, "d": None}])
    other = T.StructType([T.StructField("A", T.StructType([T.StructField("b", T.IntegerType(), False, {"default": 9})])), T.StructField("L", T.ArrayType(T.StructType([T.StructField("x", T.IntegerType())]))), T.StructField("l", T.StringType())][:2])
    rows = {r["k"]: r["d"] for r in db.get("w", struct(("k", T.IntegerType(), False, K), ("d", other, True, {}))).get_all().collect()}
    assert rows[1].asDict(True) == {"A": {"b": 9}, "L": [{"x": None}, None]} and rows[2].asDict(True) == {"A": None, "L": None} and rows[3] is None
    same = db.get("w", w.schema).get_all()
    assert {r["k"]: r["d"]["A"]["B"] for r in same.where("d.A.B IS NOT NULL").collect()} == {1: 5}


def test_creation(db):
    from datetime import datetime, timezone

    assert abs((datetime.now(timezone.utc) - db.created_at).total_seconds()) < 600 and Database(db.spark, db.path).created_at == db.created_at
    db.create("p", Person)
    with pytest.raises(EntityExists):
        db.create("p", Person)
    assert db.names() == ["p"] and db.entities("p", Person).get_all().count() == 0


def test_a_commit_that_fails_ends_its_transaction(db):
    e = db.entities("p", Person)
    t = db.transaction()
    e.insert(db.spark.createDataFrame([(None, "x", 1, None, None)], e.stored))
    with pytest.raises(Exception, match="null"):
        t.commit()
    assert db.transactions.current is None and e.get_all().count() == 0


def test_versions_of_several_writers_and_of_one_upsert(db):
    v, other = VersionedEntities(db, "v", Person), VersionedEntities(db, "v", Person)
    assert [v._claim(), other._claim(), v._claim()] == [1, 2, 3]
    v.upsert(db.spark.createDataFrame([(1, f"n{i}", i, None, None) for i in range(5)], "Id int, Name string, Age int, Passport struct<Code:string>, Tags array<struct<Name:string>>").coalesce(1))
    assert [r["Age"] for r in v.current().collect()] == [4] and sorted((r["ver"], r["Age"]) for r in v.histories().collect()) == [(i + 1, i) for i in range(5)]


def test_history_of_a_hot_key_is_numbered_by_ranges(db):
    rows = [(1, i * 7 % 1000) for i in range(1000)] + [(None, i) for i in range(5)] + [(2, None), (2, 3), (3, 5)]
    df = db.spark.createDataFrame(rows, "k int, v long").repartition(4)
    got = sorted((str(r["k"]), r["ver"], str(r["v"])) for r in history(df, "k", "v", ranges=8).collect())
    want = [(str(k), n + 1, str(v)) for k in (1, 2, 3, None) for n, v in enumerate(sorted((v for q, v in rows if q == k), key=lambda v: (v is not None, v or 0)))]
    assert got == sorted(want) and history(df.limit(0), "k", "v").count() == 0
