"""Schemas of entities: a dataclass or StructType becomes a validated StructType.

The reader's schema decides: stored fields it does not name are skipped, fields that are not stored
(or null) read as the field's default, which is 0 for a plain ``int`` and NULL otherwise.  Names
are case-sensitive at every depth.  The key is the first field marked ``key``.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import re
import types
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of a stored value; those after bytes go beyond what the documents' own types require.
PRIMITIVES: dict[type, T.DataType] = {
    int: T.IntegerType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    bool: T.BooleanType(),
    float: T.DoubleType(),
    decimal.Decimal: T.DecimalType(38, 18),
    datetime.datetime: T.TimestampType(),
    datetime.timedelta: T.DayTimeIntervalType(),
}
#: What may identify a document.
KEY_TYPES = (T.IntegerType, T.StringType, T.LongType, T.ShortType, T.ByteType, T.DecimalType, T.BinaryType)


class SchemaError(ValueError):
    """A schema or a value that an entity cannot hold."""


def key(**metadata: object) -> typing.Any:
    """A dataclass field that identifies its document."""
    return dataclasses.field(metadata={"key": True, **metadata})


def _type(t: object, inside: tuple[type, ...]) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a Python annotation."""
    origin, args = typing.get_origin(t), typing.get_args(t)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise SchemaError(f"{t}: only one type, or that type and None")
        return _type(rest[0], inside)[0], True
    if origin is list:
        return T.ArrayType(_type(args[0], inside)[0], True), True
    if dataclasses.is_dataclass(t):
        return _struct(t, inside), True
    if t in PRIMITIVES:
        # a plain number or truth value has no null; text and bytes have
        return PRIMITIVES[t], t in (str, bytes)
    raise SchemaError(f"{t} cannot be stored")


def _struct(cls: type, inside: tuple[type, ...] = ()) -> T.StructType:
    if cls in inside:
        raise SchemaError(f"{cls.__name__} contains itself; schemas must be finite")
    hints = typing.get_type_hints(cls)
    fields = []
    for f in dataclasses.fields(cls):
        kind, nullable = _type(hints[f.name], (*inside, cls))
        meta = {k: v for k, v in f.metadata.items() if k == "key"}
        if f.default is not dataclasses.MISSING and f.default is not None:
            meta["default"] = f.default
        fields.append(T.StructField(f.name, kind, nullable, meta))
    return T.StructType(fields)


def _check(t: T.DataType, at: str) -> None:
    if isinstance(t, T.StructType):
        if not t.fields:
            raise SchemaError(f"{at} has no fields; Parquet cannot hold an empty structure")
        low = [f.name.lower() for f in t.fields]
        if len(set(t.names)) != len(t.names):
            raise SchemaError(f"{at} names a field twice")
        if len(set(low)) != len(low):
            raise SchemaError(f"{at} has fields that differ in case only")
        for f in t.fields:
            _check(f.dataType, f"{at}.{f.name}")
    elif isinstance(t, T.ArrayType):
        _check(t.elementType, f"{at}[]")
    elif isinstance(t, T.MapType):
        raise SchemaError(f"{at}: a map is not a document value; use a structure")


def build(source: object) -> T.StructType:
    """The validated schema of a dataclass or StructType."""
    if isinstance(source, T.StructType):
        out = source
    elif isinstance(source, type) and dataclasses.is_dataclass(source):
        out = _struct(source)
    else:
        raise SchemaError("an entity's schema is a dataclass or a StructType")
    _check(out, "schema")
    return out


def key_of(schema: T.StructType) -> str:
    """The name of the first key field."""
    for f in schema.fields:
        if f.metadata.get("key"):
            if not isinstance(f.dataType, KEY_TYPES):
                raise SchemaError(f"{f.name}: {f.dataType.simpleString()} cannot identify a document")
            return f.name
    raise SchemaError("no field is marked as the key")


def nullable(t: T.DataType) -> T.DataType:
    """The same type as it is stored: everything may be null."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType), True)
    return t


def paths_of(t: T.DataType, at: str = "") -> dict[str, str]:
    """The type of every field at any depth by its path: names joined by dots, ``[]`` for an array's elements."""
    if isinstance(t, T.ArrayType):
        return paths_of(t.elementType, f"{at}[]")
    out: dict[str, str] = {}
    if isinstance(t, T.StructType):
        for f in t.fields:
            p = f"{at}.{f.name}" if at else f.name
            out |= {p: f.dataType.simpleString()} | paths_of(f.dataType, p)
    return out


def readable(t: T.DataType, known: dict[str, str], at: str = "") -> T.DataType:
    """The part of a type that files hold under these very names.  A structure of which they hold none is read by a
    field of theirs, so that it can be told from null."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(readable(t.elementType, known, f"{at}[]"), True)
    if not isinstance(t, T.StructType):
        return t
    path = lambda n: f"{at}.{n}" if at else n
    out = [T.StructField(f.name, readable(f.dataType, known, path(f.name)), True, f.metadata) for f in t.fields if path(f.name) in known]
    if not out and at:
        inside = sorted(p for p in known if p.startswith(f"{at}.") and not re.search(r"[.\[]", p[len(at) + 1 :]))
        out = [T.StructField(p[len(at) + 1 :], T.DataType.fromDDL(known[p])) for p in inside[:1]]
    return T.StructType(out)


def _missing(t: T.DataType, known: dict[str, str] | None, at: str) -> bool:
    return known is not None and any(p not in known for p in paths_of(t, at))


def _needs_default(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_default(f) is not None or _needs_default(f.dataType) for f in t.fields)
    return isinstance(t, T.ArrayType) and _needs_default(t.elementType)


def _default(f: T.StructField) -> object:
    """What a null reads as: nothing where the schema allows nulls, and in keys, which never are (so filters on them reach the scan)."""
    if f.nullable or f.metadata.get("key"):
        return None
    if "default" in f.metadata:
        return f.metadata["default"]
    return {T.BooleanType: False}.get(type(f.dataType), 0 if isinstance(f.dataType, T.NumericType) else None)


def with_defaults(c: Column, t: T.DataType, known: dict[str, str] | None = None, at: str = "") -> Column:
    """A stored value as the schema reads it; null structures and arrays stay null.  known: the paths that are stored
    (all, if not given)."""
    if not _needs_default(t) and not _missing(t, known, at):
        return c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: with_defaults(x, t.elementType, known, f"{at}[]"))
    assert isinstance(t, T.StructType)
    stored = lambda f: known is None or f"{at}.{f.name}" in known
    return F.when(c.isNotNull(), F.struct(*[(field(c[f.name], f, known, f"{at}.{f.name}") if stored(f) else absent(f)).alias(f.name) for f in t.fields]))


def absent(f: T.StructField) -> Column:
    """A field that was never stored: its default."""
    d = f.metadata.get("default", _default(f))
    return F.lit(d).cast(f.dataType)


def field(c: Column, f: T.StructField, known: dict[str, str] | None = None, at: str = "") -> Column:
    c, d = with_defaults(c, f.dataType, known, at), _default(f)
    return c if d is None else F.coalesce(c, F.lit(d).cast(f.dataType))
