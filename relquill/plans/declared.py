"""Entities from dataclasses, and back: rows as objects of a declared class.

    @dataclass
    class Order:
        orderkey: int = field(metadata={"id": True, "column": "o_orderkey"})
        total: float = field(default=0.0, metadata={"column": "o_totalprice", "index": "BTREE"})
        customer: object = field(default=None, metadata={"relation": ToOne("customer", "Customer", "o_custkey")})
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import types
import typing
from collections.abc import Mapping
from decimal import Decimal

from relquill.plans.schema import Entity, Field

#: Type codes whose values a Python type holds, the first being its own.
CODES = {
    bool: ("boolean",), int: ("long", "int", "short", "byte"), float: ("double", "float"), str: ("string", "char"), Decimal: ("decimal", "bigint"),
    dt.datetime: ("datetime", "instant", "timestamp"), dt.date: ("date",),
}


def plain(hint) -> tuple[object, bool]:
    """A type without its None, and whether it had one."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        parts = [a for a in typing.get_args(hint) if a is not type(None)]
        return (parts[0] if len(parts) == 1 else object), True
    return hint, False


def declared(cls: type) -> Entity:
    """The entity of a dataclass. Field metadata: id, column, type, index, converter, relation; the class may
    carry ``__entity__`` (further arguments of ``Entity``). Fields that cannot be None are primitive."""
    if not dataclasses.is_dataclass(cls):
        raise TypeError(f"{cls.__name__} is no dataclass")
    hints, fields, relations, key = typing.get_type_hints(cls), [], [], None
    for f in dataclasses.fields(cls):
        meta = f.metadata
        if "relation" in meta:
            relations.append(meta["relation"])
            continue
        kind, optional = plain(hints[f.name])
        code = meta.get("type") or next((c[0] for t, c in CODES.items() if t is kind), None)
        if code is None:
            raise TypeError(f"{cls.__name__}.{f.name}: no type for {kind}")
        key = f.name if meta.get("id") else key
        fields.append(Field(f.name, code, meta.get("column", ""), not optional and not meta.get("id") and code not in ("string", "char"), meta.get("converter"), meta.get("index", "")))
    if key is None:
        raise ValueError(f"{cls.__name__}: no field is the id")
    return Entity(cls.__name__, key, tuple(fields), tuple(relations), **getattr(cls, "__entity__", {}))


def fits(code: str, hint) -> bool:
    """Whether values of a type code can be held by a declared type."""
    kind, _ = plain(hint)
    return kind in (object, typing.Any) or kind not in CODES or code in CODES[kind]


@functools.lru_cache(maxsize=256)
def hints_of(cls: type) -> dict[str, object]:
    return typing.get_type_hints(cls)


def made(cls: type, values: Mapping[str, object]) -> object:
    """An object of a dataclass from dotted properties; nested dataclasses are made of their parts."""
    hints, out = hints_of(cls), {}
    for f in dataclasses.fields(cls):
        kind, _ = plain(hints[f.name])
        if f.name in values:
            out[f.name] = values[f.name]
        elif dataclasses.is_dataclass(kind):
            below = {n.partition(".")[2]: v for n, v in values.items() if n.startswith(f"{f.name}.")}
            if below:
                out[f.name] = made(kind, below) if any(v is not None for v in below.values()) else None
    return cls(**out)
