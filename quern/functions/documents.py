"""Column functions on documents: identifier, byte length, binary form, JSON, access without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.schema import SchemaError, key_of

#: Bytes of a value after its tag byte; text and bytes have a length of 4 bytes first.
WIDTHS = {
    T.IntegerType: 4, T.LongType: 8, T.ShortType: 2, T.ByteType: 1, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.TimestampType: 8, T.TimestampNTZType: 8, T.DayTimeIntervalType: 8, T.DecimalType: 16,
}


def value_size(c: Column, t: T.DataType) -> Column:
    """Bytes of a value in the documents' binary form: a tag, then the value; null is a tag alone."""
    if isinstance(t, T.StructType):
        inside = [F.lit(4 + len(f.name.encode())) + value_size(c.getField(f.name), f.dataType) for f in t.fields]
        size = sum(inside, F.lit(5))
    elif isinstance(t, T.ArrayType):
        size = F.lit(5) + F.aggregate(F.transform(c, lambda x: value_size(x, t.elementType)), F.lit(0), lambda a, x: a + x)
    elif isinstance(t, (T.StringType, T.BinaryType)):
        size = F.lit(5) + F.octet_length(c)
    else:
        size = F.lit(1 + WIDTHS[type(t)])
    return F.when(c.isNull(), F.lit(1)).otherwise(size)


def document_size(schema: T.StructType) -> Column:
    """Bytes of a whole document: its identifier, then the object."""
    k = key_of(schema)
    parts = [F.lit(4 + len(f.name.encode())) + value_size(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]
    return value_size(F.col(f"`{k}`"), schema[k].dataType) + sum(parts, F.lit(5))


#: The tag bytes of the binary form.
TAGS = {"null": "01", "string": "02", "int": "07", "object": "13", "array": "14"}


def _int_hex(c: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def _text_hex(c: Column) -> Column:
    return F.concat(_int_hex(F.octet_length(c)), F.hex(F.encode(c, "UTF-8")))


def _value_hex(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        out = F.concat(F.lit(TAGS["object"]), _int_hex(F.lit(len(t.fields))), *[x for f in t.fields for x in (_text_hex(F.lit(f.name)), _value_hex(c.getField(f.name), f.dataType))])
    elif isinstance(t, T.ArrayType):
        out = F.concat(F.lit(TAGS["array"]), _int_hex(F.size(c)), F.array_join(F.transform(c, lambda x: _value_hex(x, t.elementType)), ""))
    elif isinstance(t, T.StringType):
        out = F.concat(F.lit(TAGS["string"]), _text_hex(c))
    elif isinstance(t, T.IntegerType):
        out = F.concat(F.lit(TAGS["int"]), _int_hex(c))
    else:
        raise SchemaError(f"{t.simpleString()} has no binary form")
    return F.when(c.isNull(), F.lit(TAGS["null"])).otherwise(out)


def document_bytes(schema: T.StructType) -> Column:
    """The document in its tagged binary form (integers, strings, nulls, objects and arrays): its identifier, then the object."""
    k = key_of(schema)
    fields = [x for f in schema.fields for x in (_text_hex(F.lit(f.name)), _value_hex(F.col(f"`{f.name}`"), f.dataType))]
    return F.unhex(F.concat(_value_hex(F.col(f"`{k}`"), schema[k].dataType), F.lit(TAGS["object"]), _int_hex(F.lit(len(schema.fields))), *fields))


def identifier(schema: T.StructType) -> Column:
    return F.col(f"`{key_of(schema)}`").alias("_id")


def to_json(df: DataFrame) -> Column:
    """The document as JSON, nulls written out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def as_variant(df: DataFrame) -> Column:
    """The document without its schema, for variant_get.  (Integers widen to bigint, keys come back sorted.)"""
    return F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
