"""The logical query that both front ends build."""

from __future__ import annotations

from dataclasses import dataclass

#: The predicates.
OPS = (
    "EQ", "NE", "GT", "GTE", "LT", "LTE", "BETWEEN", "IN", "NOT_IN", "LIKE", "NOT_LIKE", "CONTAINING", "NOT_CONTAINING",
    "STARTING_WITH", "NOT_STARTING_WITH", "ENDING_WITH", "NOT_ENDING_WITH", "IGNORE_CASE_EQ", "IGNORE_CASE_LIKE",
    "IS_NULL", "NOT_NULL", "IS_TRUE", "IS_FALSE", "AFTER", "BEFORE",
)

#: Predicates under NOT: another predicate, not the complement of the first.
NEGATED = {
    "EQ": "NE", "NE": "EQ", "GT": "LTE", "LTE": "GT", "LT": "GTE", "GTE": "LT", "IN": "NOT_IN", "NOT_IN": "IN",
    "LIKE": "NOT_LIKE", "NOT_LIKE": "LIKE", "IS_NULL": "NOT_NULL", "NOT_NULL": "IS_NULL", "IS_TRUE": "IS_FALSE", "IS_FALSE": "IS_TRUE",
}

ARITY = {"BETWEEN": 2, "IS_NULL": 0, "NOT_NULL": 0, "IS_TRUE": 0, "IS_FALSE": 0}


def arity(op: str) -> int:
    return ARITY.get(op, 1)


@dataclass(frozen=True)
class Param:
    """A value given at call time: by position (from 0) or by name."""

    key: int | str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    path: str
    op: str
    args: tuple[Param | Literal, ...] = ()
    ignore_case: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Order:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Having:
    """count <op> value."""

    op: str
    value: Param | Literal


@dataclass(frozen=True)
class Query:
    """``action``: FIND, COUNT, EXISTS, DELETE, UPDATE. ``group``: None, LIST, SET, COUNT."""

    action: str
    entity: str
    where: object = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
    group_by: tuple[str, ...] = ()
    group: str | None = None
    having: tuple = ()  # Having, "and" / "or", Having, ...: evaluated from left to right
    projection: tuple[tuple[str, str], ...] = ()  # (alias, path)
    left: frozenset[str] = frozenset()  # relation paths joined LEFT: they filter nothing
    assign: tuple[tuple[str, Param | Literal], ...] = ()


def leaves(node) -> list[Compare]:
    if node is None:
        return []
    return [node] if isinstance(node, Compare) else [x for p in node.parts for x in leaves(p)]


def negated(node):
    """NOT, pushed down to the predicates."""
    if isinstance(node, And):
        return Or(tuple(negated(p) for p in node.parts))
    if isinstance(node, Or):
        return And(tuple(negated(p) for p in node.parts))
    if node.op not in NEGATED:
        raise ValueError(f"NOT {node.op} is not supported")
    return Compare(node.path, NEGATED[node.op], node.args, node.ignore_case)
