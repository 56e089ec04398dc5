"""The predicates as Columns for filters.

A row meets a predicate or it does not: negations are complements over all rows and so
hold for nulls, while comparisons and patterns do not. EQ with a null argument asks
for nulls. Comparisons stay plain, so that they reach the scan: under AND and OR a null
counts as false, and no predicate here is ever negated from outside. ``met`` makes one
two-valued where it is projected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relquill.functions.values import EXACT, HANDLERS, TEXT, WHOLE, Converters, FRACTIONAL, literal, listed
from relquill.plans.schema import Field

_ORDERED = WHOLE | FRACTIONAL | EXACT | TEXT | {"instant", "date", "datetime", "timestamp"}
_PATTERNS = {"LIKE", "CONTAINING", "STARTING_WITH", "ENDING_WITH"}
_RANGES = {"GT", "GTE", "LT", "LTE", "BETWEEN", "AFTER", "BEFORE"}


def met(predicate: Column) -> Column:
    """The predicate with null as false."""
    return F.coalesce(predicate, F.lit(False))


def check(field: Field, op: str) -> None:
    """Refuse predicates that a type does not have."""
    plain, own = op.removeprefix("NOT_") if op.removeprefix("NOT_") in _PATTERNS else op, HANDLERS.get(field.type)
    if plain in _PATTERNS or op == "IGNORE_CASE_LIKE":
        if not (own.textual if own else field.type == "string"):
            raise TypeError(f"{op} needs text; {field.name} is {field.type}")
    elif op in _RANGES and not (own.ordered if own else field.type in _ORDERED):
        raise TypeError(f"{op} needs an ordered type; {field.name} is {field.type}")
    elif op in ("IS_TRUE", "IS_FALSE") and field.type != "boolean":
        raise TypeError(f"{op} needs a boolean; {field.name} is {field.type}")


def predicate(column: Column, field: Field, op: str, args: list, ignore_case: bool, entity: str, converters: Converters) -> Column:
    """``column op args`` for a stored field; null at most where it is not met."""
    if op in ("IGNORE_CASE_EQ", "IGNORE_CASE_LIKE"):
        op, ignore_case = op.removeprefix("IGNORE_CASE_"), True
    check(field, op)
    own = HANDLERS.get(field.type)
    caseless = ignore_case and (own.textual if own else field.type in TEXT)

    def value(raw) -> Column:
        stored = converters.stored(entity, field, raw)
        return literal(field, stored.lower() if caseless and isinstance(stored, str) else stored)

    c = F.lower(column) if caseless else column
    negative = op.startswith("NOT_") and op != "NOT_NULL"
    if op in ("EQ", "NE"):
        if args[0] is None:
            return column.isNotNull() if op == "NE" else column.isNull()
        return (c != value(args[0])) | column.isNull() if op == "NE" else c == value(args[0])
    if op == "IS_NULL":
        return column.isNull()
    if op == "NOT_NULL":
        return column.isNotNull()
    if op in ("IS_TRUE", "IS_FALSE"):
        return column == F.lit(op == "IS_TRUE")
    if op in ("IN", "NOT_IN"):
        values = [] if args[0] is None else listed(args[0])
        if any(v is None for v in values):
            raise ValueError(f"{field.name}: a list of values holds a null")
        if not values:
            return F.lit(op == "NOT_IN")
        inside = c.isin([value(v) for v in values])
        return ~inside | column.isNull() if op == "NOT_IN" else inside
    if op in _RANGES:
        if any(a is None for a in args):
            return F.lit(False)
        low = value(args[0])
        if op == "BETWEEN":
            return c.between(low, value(args[1]))
        return {"GT": c > low, "AFTER": c > low, "GTE": c >= low, "LT": c < low, "BEFORE": c < low, "LTE": c <= low}[op]
    plain = op.removeprefix("NOT_")
    if plain in _PATTERNS:
        text = args[0]
        if text is None:
            return F.lit(negative)
        text = converters.stored(entity, field, text)
        text = text.lower() if caseless else text
        if plain == "LIKE":
            # no escape sign: a backslash is itself
            found = c.like(text.replace("\\", "\\\\"))
        else:
            found = {"CONTAINING": c.contains, "STARTING_WITH": c.startswith, "ENDING_WITH": c.endswith}[plain](text)
        return ~found | column.isNull() if negative else found
    raise ValueError(f"no predicate {op}")
