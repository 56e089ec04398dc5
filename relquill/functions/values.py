"""Arguments to literals of a field's type, and value converters.

A converter turns arguments into stored values, and stored values into results; the
column itself stays as stored, so filters still reach the scan.
"""

from __future__ import annotations

import datetime as dt
import enum
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from relquill.plans.schema import TYPES, Field

_RANGES = {"byte": 7, "short": 15, "int": 31, "long": 63}
WHOLE, FRACTIONAL, TEXT, EXACT = {"byte", "short", "int", "long"}, {"float", "double"}, {"string", "char"}, {"decimal", "bigint"}


@dataclass(frozen=True)
class TypeHandler:
    """A type of one's own: how its values are stored and compared.

    ``coerce`` makes any accepted value the stored one and raises TypeError for others;
    ``literal`` makes a Column of a stored value where a plain cast does not.
    """

    code: str
    spark: object
    coerce: Callable
    literal: Callable | None = None
    ordered: bool = True
    textual: bool = False


HANDLERS: dict[str, TypeHandler] = {}


def register_type(handler: TypeHandler) -> None:
    """Let fields have the type ``handler.code``; built-in codes stay what they are."""
    if handler.code in TYPES and handler.code not in HANDLERS:
        raise ValueError(f"{handler.code} is a built-in type")
    HANDLERS[handler.code] = handler
    TYPES[handler.code] = handler.spark


@dataclass(frozen=True)
class Converter:
    """A pair of functions between a value and its stored form."""

    store: Callable
    load: Callable


def enum_names(kind: type[enum.Enum]) -> Converter:
    return Converter(lambda v: v.name if isinstance(v, enum.Enum) else v, lambda s: None if s is None else kind[s])


#: Types that are stored as text.
UUID_TEXT = Converter(lambda v: str(v) if isinstance(v, uuid.UUID) else v, lambda s: None if s is None else uuid.UUID(s))
TIME_TEXT = Converter(lambda v: v.isoformat() if isinstance(v, dt.time) else v, lambda s: None if s is None else dt.time.fromisoformat(s))
DATE_TEXT = Converter(lambda v: v.isoformat() if isinstance(v, dt.date) else v, lambda s: None if s is None else dt.date.fromisoformat(s))
DATETIME_TEXT = Converter(lambda v: v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v, lambda s: None if s is None else dt.datetime.fromisoformat(s))


class Converters:
    """Registered converters: by entity field first, then by the value's class."""

    def __init__(self):
        self._fields: dict[tuple[str, str], Converter] = {}
        self._classes: dict[type, Converter] = {uuid.UUID: UUID_TEXT, dt.time: TIME_TEXT}

    def for_field(self, entity: str, field: str, converter: Converter) -> None:
        self._fields[entity.lower(), field.lower()] = converter

    def for_class(self, kind: type, converter: Converter) -> None:
        self._classes[kind] = converter

    def find(self, entity: str, field: Field, value=None) -> Converter | None:
        found = self._fields.get((entity.lower(), field.name.lower())) or field.converter
        if found is None and value is not None:
            found = next((c for k, c in self._classes.items() if isinstance(value, k)), None)
        return found

    def stored(self, entity: str, field: Field, value):
        c = self.find(entity, field, value)
        return coerce(field, c.store(value) if c and value is not None else value)


def coerce(field: Field, value):
    """The value as the field's type has it; a value of another kind is an error."""
    kind = field.type
    if value is None:
        return None
    if kind in HANDLERS:
        return HANDLERS[kind].coerce(value)
    wrong = TypeError(f"{field.name} is {kind}, not {type(value).__name__}")
    if kind == "boolean":
        if not isinstance(value, bool):
            raise wrong
        return value
    if isinstance(value, bool):
        raise wrong
    if kind in WHOLE:
        if isinstance(value, Decimal) and value == value.to_integral_value():
            value = int(value)
        if not isinstance(value, int):
            raise wrong
        if not -(1 << _RANGES[kind]) <= value < 1 << _RANGES[kind]:
            raise OverflowError(f"{field.name}: {value} is out of range")
        return value
    if kind in FRACTIONAL:
        if not isinstance(value, (int, float, Decimal)):
            raise wrong
        return float(value)
    if kind in EXACT:
        if not isinstance(value, (int, Decimal, float)):
            raise wrong
        return Decimal(str(value))
    if kind in TEXT:
        if not isinstance(value, str):
            raise wrong
        return value[:1] if kind == "char" else value
    if kind == "date":
        if isinstance(value, str):
            return dt.date.fromisoformat(value)
        if isinstance(value, dt.datetime) or not isinstance(value, dt.date):
            raise wrong
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        raise wrong
    return value.replace(tzinfo=None) if kind == "datetime" else value


def literal(field: Field, value) -> Column:
    """A literal of the field's type. Zoneless times stay zoneless, so comparisons reach the scan."""
    if field.type in HANDLERS:
        own = HANDLERS[field.type].literal
        return own(value) if own is not None and value is not None else F.lit(value).cast(TYPES[field.type])
    if field.type == "datetime" and value is not None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if value is None or field.type in ("decimal", "bigint"):
        return F.lit(value).cast(TYPES[field.type]) if value is None else F.lit(value)
    return F.lit(value) if field.type not in ("byte", "short", "float") else F.lit(value).cast(TYPES[field.type])


def listed(value) -> list:
    """The values of an IN argument."""
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        return [value]
    return list(value)
