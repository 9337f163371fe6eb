import struct

import pytest

from quern.sources import pagefile as P
from tests_support import GOLDEN, Person


def page(number, kind, rest=b"", at=5, items=(), next_page=0):
    b = bytearray(P.PAGE_SIZE)
    struct.pack_into("<IB", b, 0, number, kind)
    b[at : at + len(rest)] = rest
    if kind == P.DATA:
        b[P.ITEMS_AT] = len(items)
        struct.pack_into("<I", b, P.NEXT_AT, next_page)
        position = 32
        for i, d in enumerate(items):
            b[position : position + len(d)] = d
            struct.pack_into("<HH", b, P.PAGE_SIZE - 4 * (i + 1), len(d), position)
            position += len(d)
    return bytes(b)


def store(entities):
    b = bytearray(page(0, P.CATALOG))
    b[P.ENTITY_COUNT_AT] = len(entities)
    at = P.ENTITIES_AT
    for name, first in entities.items():
        raw = struct.pack("<i", len(name)) + name.encode() + struct.pack("<II", first, first)
        b[at : at + len(raw)] = raw
        at += len(raw)
    return bytes(b)


def test_documents():
    one, two = map(P.document, GOLDEN)
    assert one["Name"] == "Oleksandr" and two["Tags"] == [{"Name": "tag1"}, {"Name": "tag2"}] and len(GOLDEN[0]) == 151
    for bad in (bytes([7, 1, 0, 0, 0, 99]), bytes([7, 1, 0, 0, 0, 7, 1, 0, 0, 0]), bytes([7, 1, 0, 0, 0, 2, 9, 0, 0, 0])):
        with pytest.raises(P.PageFileError):
            P.document(bad)


def test_import(db, tmp_path):
    other = page(2, P.DATA, items=GOLDEN[:1])
    f = tmp_path / "people.db"
    f.write_bytes(store({"parsons": 1, "others": 2}) + page(1, P.DATA, items=GOLDEN, next_page=3) + other + page(3, P.DATA, items=GOLDEN[1:]) + page(4, P.DATA, items=GOLDEN[:1]))
    e = P.import_entity(db, str(f), "parsons", Person)
    assert sorted((r["Id"], r["Passport"]["Code"], len(r["Tags"])) for r in e.get_all().collect()) == [(1, "ST-111111", 2), (2, "ST-222222", 2), (2, "ST-222222", 2)]
    with pytest.raises(P.PageFileError):
        P.import_entity(db, str(f), "none", Person)
    with pytest.raises(P.PageFileError):
        P.import_entity(db, str(f), "parsons", Person, all_pages=True)
    g = tmp_path / "one.db"
    g.write_bytes(store({"q": 1}) + page(1, P.DATA, items=GOLDEN) + page(2, P.DATA, items=GOLDEN))
    assert P.import_entity(db, str(g), "q", Person, all_pages=True).get_all().count() == 4
