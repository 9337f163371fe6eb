"""Types and golden documents that several tests use.

Fixed values: the sample types, and the bytes that their documents have in the format of page files."""

from __future__ import annotations

import dataclasses
from typing import Optional

from quern.plans.schema import key


@dataclasses.dataclass
class Tag:
    Name: str


@dataclasses.dataclass
class Passport:
    Code: str


@dataclasses.dataclass
class Person:
    Id: int = key()
    Name: str = ""
    Age: int = 0
    Passport: Optional[Passport] = None
    Tags: Optional[list[Tag]] = None


GOLDEN = [
    bytes.fromhex(x)
    for x in (
        "070100000013050000000200000049640701000000040000004e616d6502090000004f6c656b73616e647203000000416765071d0000000800000050617373706f7274130100000004000000436f6465020900000053542d313131313131040000005461677314020000001301000000040000004e616d650204000000746167311301000000040000004e616d65020400000074616732",
        "070200000013050000000200000049640702000000040000004e616d6502040000004b61746503000000416765071c0000000800000050617373706f7274130100000004000000436f6465020900000053542d323232323232040000005461677314020000001301000000040000004e616d650204000000746167311301000000040000004e616d65020400000074616732",
    )
]
