"""Import and export of single-file page stores (an extension): fixed pages of slotted, tagged documents.

The file is read as records of one page each, so Spark splits it on any file system.  Documents are
decoded to JSON in batches and take the reader's schema from there.  Which pages belong to an entity
is told by the first page in the catalog (page 0) and each page's successor; the chains are worked out from
the page numbers alone, of which the format has at most 2^32 / 8192.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.documents import document_bytes
from quern.operators.entities import Entities
from quern.sources.database import Database

# Fixed values of the format, little-endian: sizes, offsets and tags.
PAGE_SIZE = 8192
CATALOG, DATA = 1, 2  # page types
TYPE_AT, ITEMS_AT, NEXT_AT = 4, 5, 10  # in a data page's header
ENTITY_COUNT_AT, ENTITIES_AT = 17, 32  # in page 0
DOCUMENTS_AT, SLOT, MOST_ITEMS = 32, 4, 255  # where documents begin in a data page; bytes of a slot; a count of one byte
NULL, STRING, INT, OBJECT, ARRAY = 1, 2, 7, 19, 20


class PageFileError(ValueError):
    """The bytes are not what the format says."""


def _text(b: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<i", b, at)
    if n < 0 or at + 4 + n > len(b):
        raise PageFileError(f"a text of {n} bytes at {at}")
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def value(b: bytes, at: int = 0) -> tuple[object, int]:
    """A tagged value, and where the next one begins."""
    tag, at = b[at], at + 1
    if tag == NULL:
        return None, at
    if tag == STRING:
        return _text(b, at)
    if tag == INT:
        return struct.unpack_from("<i", b, at)[0], at + 4
    if tag not in (OBJECT, ARRAY):
        raise PageFileError(f"tag {tag} at {at - 1}")
    (n,), at = struct.unpack_from("<i", b, at), at + 4
    if tag == ARRAY:
        items = []
        for _ in range(n):
            x, at = value(b, at)
            items.append(x)
        return items, at
    fields: dict[str, object] = {}
    for _ in range(n):
        name, at = _text(b, at)
        if name in fields:
            raise PageFileError(f"{name} stands twice in an object")
        fields[name], at = value(b, at)
    return fields, at


def document(b: bytes) -> dict:
    """The object of a document; its identifier, written first, is a field of it as well."""
    _, at = value(b)
    found, _ = value(b, at)
    if not isinstance(found, dict):
        raise PageFileError("a document is an object")
    return found


def documents_of(page: bytes) -> list[bytes]:
    out = []
    for i in range(page[ITEMS_AT]):
        length, position = struct.unpack_from("<HH", page, PAGE_SIZE - 4 * (i + 1))
        out.append(page[position : position + length])
    return out


def catalog(page: bytes) -> dict[str, int]:
    """First data page of each entity, from page 0."""
    if page[TYPE_AT] != CATALOG:
        raise PageFileError("page 0 is no catalog")
    at, out = ENTITIES_AT, {}
    for _ in range(page[ENTITY_COUNT_AT]):
        name, at = _text(page, at)
        out[name] = struct.unpack_from("<I", page, at)[0]
        at += 8
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """number, type, next, page of all pages of the file."""
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, PAGE_SIZE).map(lambda b: (b,)), "page binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head = [struct.unpack_from("<IB", x) for x in b["page"]]
            yield pd.DataFrame({"number": [h[0] for h in head], "type": [h[1] for h in head], "next": [struct.unpack_from("<I", x, NEXT_AT)[0] for x in b["page"]], "page": b["page"]})

    return raw.mapInPandas(run, "number long, type int, next long, page binary")


def import_entity(db: Database, path: str, name: str, schema: object, all_pages: bool = False) -> Entities:
    """Append an entity of a page file to the entity of that name.

    all_pages takes every data page of a file with one entity: its chain may have been broken when it was written."""
    pages = read_pages(db.spark, path)
    first = pages.where(f"type = {CATALOG}").select("page").first()
    known = catalog(bytes(first["page"])) if first else {}
    if name not in known:
        raise PageFileError(f"{path} has no entity {name}")
    data = pages.where(f"type = {DATA}")
    if all_pages and len(known) > 1:
        raise PageFileError("only a file with one entity can be taken whole")
    if not all_pages:
        after = {r["number"]: r["next"] for r in data.select("number", "next").collect()}
        chain, at = [], known[name]
        while at and at in after and at not in chain[-1:]:
            chain.append(at)
            at = after[at]
            if len(chain) > len(after):
                raise PageFileError("the pages go round in a circle")
        data = data.where(F.col("number").isin(chain)) if len(chain) < 1000 else data.join(db.spark.createDataFrame([(n,) for n in chain], "number long"), "number")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"js": [json.dumps(document(d)) for p in b["page"] for d in documents_of(p)]})

    entity = db.entities(name, schema)
    js = data.select("page").mapInPandas(run, "js string")
    entity.insert(js.select(F.from_json("js", T.StructType(entity.stored.fields)).alias("d")).select("d.*"))
    return entity


def data_page(number: int, items: list[bytes], next_page: int) -> bytes:
    b, at = bytearray(PAGE_SIZE), DOCUMENTS_AT
    struct.pack_into("<IBB", b, 0, number, DATA, len(items))
    struct.pack_into("<I", b, NEXT_AT, next_page)
    for i, d in enumerate(items):
        b[at : at + len(d)] = d
        struct.pack_into("<HH", b, PAGE_SIZE - SLOT * (i + 1), len(d), at)
        at += len(d)
    return bytes(b)


def catalog_page(first_last: dict[str, tuple[int, int]]) -> bytes:
    b, at = bytearray(PAGE_SIZE), ENTITIES_AT
    struct.pack_into("<IB", b, 0, 0, CATALOG)
    b[ENTITY_COUNT_AT] = len(first_last)
    for name, pages in first_last.items():
        raw = name.encode()
        entry = struct.pack("<i", len(raw)) + raw + struct.pack("<II", *pages)
        if at + len(entry) > PAGE_SIZE or len(first_last) > MOST_ITEMS:
            raise PageFileError("the names of the entities don't fit the catalog's page")
        b[at : at + len(entry)] = entry
        at += len(entry)
    return bytes(b)


def export_entities(path: str, *entities: Entities) -> None:
    """Write entities to one page file.  The format is one sequence of pages, so the driver writes it, holding one page
    and one partition of documents at a time (twice: the catalog comes first).  A document has to fit a page."""
    spark = entities[0].spark
    packed: dict[str, list[int]] = {}

    def pages_of(e: Entities) -> Iterator[list[bytes]]:
        items, size = [], 0
        for r in e.get_all().select(document_bytes(e.schema).alias("d")).toLocalIterator():
            d = bytes(r["d"])
            if len(d) + SLOT > PAGE_SIZE - DOCUMENTS_AT:
                raise PageFileError(f"a document of {len(d)} bytes doesn't fit a page")
            if size + len(d) + SLOT > PAGE_SIZE - DOCUMENTS_AT or len(items) == MOST_ITEMS:
                yield items
                items, size = [], 0
            items.append(d)
            size += len(d) + SLOT
        yield items

    number = 1
    for e in entities:
        n = sum(1 for _ in pages_of(e))
        packed[e.name] = [number, number + n - 1]
        number += n
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(catalog_page({k: tuple(v) for k, v in packed.items()})))
        for e in entities:
            first, last = packed[e.name]
            for at, items in zip(range(first, last + 1), pages_of(e), strict=True):
                out.write(bytearray(data_page(at, items, at + 1 if at < last else 0)))
    finally:
        out.close()
