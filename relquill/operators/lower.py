"""Logical queries to DataFrames.

Relation predicates only filter: a conjunction of them on one relation becomes one
left semi join against the filtered target; under OR it becomes an EXISTS, which
Spark plans as an existence join. Rows are never multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.predicates import met, predicate
from relquill.plans.ir import And, Compare, Literal, Or, Param, Query, leaves
from relquill.plans.schema import Entity, InverseOne, Path, ToMany, ToOne
from relquill.sources.workspace import Workspace, visible


_SUFFIX = {"ENDING_WITH": "STARTING_WITH", "NOT_ENDING_WITH": "NOT_STARTING_WITH"}


def first_by(rows: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """(__g, name): of the rows of each value of ``column`` that of least ``key``, as a struct."""
    return rows.groupBy(F.col(column).alias("__g")).agg(F.min_by(F.struct("*"), F.col(key)).alias(name))


class Lowering:
    """One query over one workspace with given arguments."""

    def __init__(self, workspace: Workspace, query: Query, args: tuple = (), named: dict | None = None):
        self.ws, self.query, self.args, self.named = workspace, query, args, named or {}
        self.entity = workspace.model.entity(query.entity)

    # --- values

    def value(self, v):
        if isinstance(v, Literal):
            return tuple(self.value(x) for x in v.value) if isinstance(v.value, tuple) else v.value
        if isinstance(v, Param):
            if isinstance(v.key, int):
                if v.key >= len(self.args):
                    raise ValueError(f"argument {v.key + 1} is missing")
                return self.args[v.key]
            if v.key not in self.named:
                raise ValueError(f"argument :{v.key} is missing")
            return self.named[v.key]
        return v

    # --- where

    def ignored(self, path: Path) -> bool:
        """Predicates beyond a LEFT joined relation filter nothing."""
        walked = ".".join(s.relation.name for s in path.steps).lower()
        return any(walked == left or walked.startswith(left + ".") for left in self.query.left)

    def pruned(self, node):
        if isinstance(node, Compare):
            return None if self.ignored(self.ws.model.path(self.entity, node.path)) else node
        parts = tuple(p for p in (self.pruned(p) for p in node.parts) if p is not None)
        return None if not parts else parts[0] if len(parts) == 1 else type(node)(parts)

    def filtered(self) -> DataFrame:
        table = self.ws.stored(self.entity.name)
        where = self.pruned(self.query.where) if self.query.where is not None else None
        return visible(table if where is None else self.apply(table, self.entity, where))

    def apply(self, table: DataFrame, entity: Entity, node) -> DataFrame:
        """Rows of ``table`` that meet the node."""
        parts = node.parts if isinstance(node, And) else (node,)
        plain, by_relation, mixed = [], {}, []
        for p in parts:
            relations = {self.first(entity, x) for x in leaves(p)}
            if relations == {None}:
                plain.append(p)
            elif isinstance(p, Compare):
                by_relation.setdefault(relations.pop(), []).append(p)
            else:
                mixed.append(p)
        if plain:
            table = table.filter(self.column(entity, And(tuple(plain))))
        for relation, conditions in by_relation.items():
            table = self.semi(table, entity, relation, And(tuple(self.below(c) for c in conditions)))
        if mixed:
            outer = table.alias("outer_row")
            table = outer.filter(self.column(entity, And(tuple(mixed)), "outer_row"))
        return table

    def first(self, entity: Entity, leaf: Compare) -> str | None:
        path = self.ws.model.path(entity, leaf.path)
        if path.field is None:
            raise ValueError(f"{leaf.path}: a relation cannot be compared")
        return path.steps[0].relation.name if path.steps else None

    @staticmethod
    def below(leaf: Compare) -> Compare:
        return Compare(leaf.path.split(".", 1)[1], leaf.op, leaf.args, leaf.ignore_case)

    def keys(self, entity: Entity, name: str, node) -> tuple[DataFrame, str, str]:
        """(target rows that meet the node with one key column, its name, the own key column)."""
        relation = entity.relation(name)
        target = self.ws.model.entity(relation.target)
        rows = self.apply(self.ws.stored(target.name), target, node)
        if isinstance(relation, ToOne):
            key = target.field(relation.references) if relation.references else target.key
            return rows.select(F.col(key.column).alias("__k")), "__k", relation.column
        if isinstance(relation, (ToMany, InverseOne)):
            back, own = entity.back(relation, target)
            return rows.select(F.col(back).alias("__k")), "__k", own
        bridge = self.ws.table(relation.bridge)
        pairs = bridge.select(F.col(relation.source_column).alias("__k"), F.col(relation.target_column).alias("__t"))
        rows = rows.select(F.col(target.key.column).alias("__id"))
        return pairs.join(rows, F.col("__t") == F.col("__id"), "left_semi").select("__k"), "__k", entity.key.column

    def semi(self, table: DataFrame, entity: Entity, name: str, node) -> DataFrame:
        rows, key, own = self.keys(entity, name, node)
        return table.join(rows, F.col(own) == F.col(key), "left_semi")

    def column(self, entity: Entity, node, outer: str | None = None) -> Column:
        """A node as a two-valued Column; relations become EXISTS over the row named ``outer``."""
        if isinstance(node, And):
            return reduce(lambda a, b: a & b, [self.column(entity, p, outer) for p in node.parts])
        if isinstance(node, Or):
            return reduce(lambda a, b: a | b, [self.column(entity, p, outer) for p in node.parts])
        path = self.ws.model.path(entity, node.path)
        if path.steps:
            rows, key, own = self.keys(entity, path.steps[0].relation.name, self.below(node))
            return rows.where(F.col(key) == F.col(f"{outer}.{own}").outer()).exists()
        column, op, args = path.field.column, node.op, [self.value(a) for a in node.args]
        if op in _SUFFIX and not node.ignore_case and isinstance(args[0], str) and (turned := self.ws.turned(entity, path.field)):
            # the layout has the text reversed: an ending is a beginning, which reaches the scan's statistics
            column, op, args = turned, _SUFFIX[op], [args[0][::-1]]
        return predicate(F.col(f"{outer}.{column}" if outer else column), path.field, op, args, node.ignore_case, entity.name, self.ws.converters)

    # --- order, limit, projection

    def with_paths(self, table: DataFrame, paths: list[str]) -> tuple[DataFrame, dict[str, Column]]:
        """Left joins for to-one paths, each target key once; the Column of each path."""
        columns, joined = {}, {}
        if any(self.ws.model.path(self.entity, p).steps for p in paths):
            table = table.select(F.struct("*").alias("r"))
            own = "r."
        else:
            own = ""
        for text in paths:
            path = self.ws.model.path(self.entity, text)
            if path.field is None:
                raise ValueError(f"{text}: a relation is no value")
            prefix, walked, entity = own, "", self.entity
            for step in path.steps:
                if not isinstance(step.relation, (ToOne, InverseOne)):
                    raise ValueError(f"{text}: only to-one relations can be walked here")
                walked += f"_{step.relation.name.lower()}"
                if walked not in joined:
                    right, unique = self.ws.table(step.entity.name), False
                    if isinstance(step.relation, InverseOne):
                        there, here = entity.back(step.relation, step.entity)
                    else:
                        unique, here = not step.relation.references, step.relation.column
                        there = (step.entity.key if unique else step.entity.field(step.relation.references)).column
                    if not unique:  # the first match, by id
                        right = first_by(right, there, step.entity.key.column, "m").select("m.*")
                    right = right.select(F.struct("*").alias(walked))
                    table = table.join(right, F.col(f"{prefix}{here}") == F.col(f"{walked}.{there}"), "left")
                    joined[walked] = True
                prefix, entity = f"{walked}.", step.entity
            columns[text] = F.col(prefix + path.field.column)
        return table, columns

    def sort_keys(self, columns: dict[str, Column], own: str = "") -> list[tuple[Column, bool]]:
        """(column, descending): the order, and the id that settles ties, reversed for one descending key."""
        order = self.query.order
        tie = (F.col(own + self.entity.key.column), len(order) == 1 and order[0].descending)
        return [*((columns[o.path], o.descending) for o in order), tie]

    @staticmethod
    def sorted_by(table: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
        return table.orderBy(*directed(keys))

    def ordered(self, table: DataFrame, columns: dict[str, Column], own: str = "") -> DataFrame:
        """Nulls last ascending and first descending; a limit without an order takes the least ids."""
        q = self.query
        if q.order or q.limit is not None:
            table = self.sorted_by(table, self.sort_keys(columns, own))
        return table if q.limit is None else table.limit(q.limit)

    def find(self) -> DataFrame:
        q = self.query
        paths = list(dict.fromkeys([p for _, p in q.projection] + [o.path for o in q.order]))
        table, columns = self.with_paths(self.filtered(), paths)
        own = "r." if any(self.ws.model.path(self.entity, p).steps for p in paths) else ""
        if q.projection and q.distinct:
            return self.distinct(table, columns, own)
        table = self.ordered(table, columns, own)
        if q.projection:
            return table.select(*(columns[p].alias(a) for a, p in q.projection))
        # entities are told apart by their id, so DISTINCT leaves nothing out
        return table.select("r.*") if own else table

    def distinct(self, table: DataFrame, columns: dict[str, Column], own: str) -> DataFrame:
        """Distinct projected rows; in an order, each where its first row stands. A limit counts rows before that."""
        q = self.query
        names = [a for a, _ in q.projection]
        chosen = [columns[p].alias(a) for a, p in q.projection]
        if not q.order and q.limit is None:
            return table.select(*chosen).distinct()
        keys = self.sort_keys(columns, own)
        table = table.select(*chosen, *(c.alias(f"__sort{i}") for i, (c, _) in enumerate(keys)))
        keys = [(F.col(f"__sort{i}"), d) for i, (_, d) in enumerate(keys)]
        if q.limit is not None:
            table = self.sorted_by(table, keys).limit(q.limit)
        first = Window.partitionBy(*names).orderBy(*directed(keys))
        table = table.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")
        return (self.sorted_by(table, keys) if q.order else table).select(*names)

    # --- groups

    def nested(self, paths) -> bool:
        return any(self.ws.model.path(self.entity, p).steps for p in paths)

    def grouped_rows(self) -> DataFrame:
        """The rows with their keys beside them: groups of any size, none gathered in one row."""
        q = self.query
        table, columns = self.with_paths(self.filtered(), list(q.group_by))
        keys = [columns[p].alias(p.replace(".", "_")) for p in q.group_by]
        return table.select(*keys, F.col("r").alias("item") if self.nested(q.group_by) else F.struct("*").alias("item"))

    def grouped(self) -> DataFrame:
        """One row per key: the keys, and cnt or items. A key's items are one array, which must fit a
        row (2 GiB) and a task's memory: for larger groups take ``grouped_rows``."""
        q = self.query
        table, columns = self.with_paths(self.filtered(), list(q.group_by))
        keys = [columns[p].alias(p.replace(".", "_")) for p in q.group_by]
        if q.group == "COUNT":
            out = table.groupBy(*keys).agg(F.count("*").alias("cnt"))
            return out.filter(self.having()) if q.having else out
        row = F.struct(F.col("r.*")) if self.nested(q.group_by) else F.struct(*table.columns)
        collect = F.collect_set if q.group == "SET" else F.collect_list
        return table.groupBy(*keys).agg(F.array_sort(collect(row)).alias("items"))

    def having(self) -> Column:
        out, combine = None, None
        for x in self.query.having:
            if isinstance(x, str):
                combine = x
                continue
            c, v = F.col("cnt"), F.lit(self.value(x.value)).cast("long")
            test = {"EQ": c == v, "NE": c != v, "GT": c > v, "GTE": c >= v, "LT": c < v, "LTE": c <= v}[x.op]
            out = test if out is None else (out & test if combine == "and" else out | test)
        return out

    # --- changes

    def matched(self) -> tuple[DataFrame, Column]:
        """The table with a flag column for the rows the query names."""
        table = self.ws.stored(self.entity.name)
        if self.query.where is None:
            return table, F.lit(True)
        node = self.pruned(self.query.where)
        if all(self.first(self.entity, x) is None for x in leaves(node)):
            return table, self.column(self.entity, node)
        key = self.entity.key.column
        hit = self.filtered().select(F.col(key).alias("__hit"))
        return table.join(hit, F.col(key) == F.col("__hit"), "left"), F.col("__hit").isNotNull()

    def deleted(self) -> DataFrame:
        """The table without the rows the query names."""
        table, hit = self.matched()
        return visible(table.filter(~met(hit)).drop("__hit"))

    def updated(self) -> DataFrame:
        table, hit = self.matched()
        from relquill.functions.values import literal

        new = {}
        for name, v in self.query.assign:
            field = self.entity.field(name)
            stored = self.ws.converters.stored(self.entity.name, field, self.value(v))
            if stored is None and field.primitive:
                raise ValueError(f"{name} is never null")
            new[field.column] = F.when(met(hit), literal(field, stored).cast(table.schema[field.column].dataType)).otherwise(F.col(field.column))
        return visible(table.withColumns(new).drop("__hit"))


def directed(keys: list[tuple[Column, bool]]) -> list[Column]:
    """Nulls last ascending and first descending."""
    return [c.desc_nulls_first() if descending else c.asc_nulls_last() for c, descending in keys]


def hydrated(ws: Workspace, entity: Entity, table: DataFrame, *names: str, only: dict | None = None) -> DataFrame:
    """``table`` with related entities attached: a struct for to-one, a list (or set) for to-many.

    ``only`` names the target's columns to attach, by relation; a list must fit a row.
    """
    only = only or {}
    for name in names or [r.name for r in entity.relations]:
        relation = entity.relation(name)
        if relation is None:
            raise ValueError(f"{entity.name} has no relation {name!r}")
        target = ws.model.entity(relation.target)
        rows = ws.table(target.name)
        item = F.struct(*(only.get(name) or rows.columns))
        if isinstance(relation, ToOne) and not relation.references:
            right = rows.select(F.col(target.key.column).alias("__g"), item.alias(name))
            table = table.join(right, F.col(relation.column) == F.col("__g"), "left").drop("__g")
            continue
        if isinstance(relation, (ToOne, InverseOne)):
            there, here = (target.field(relation.references).column, relation.column) if isinstance(relation, ToOne) else entity.back(relation, target)
            right = rows.groupBy(F.col(there).alias("__g")).agg(F.min_by(item, F.col(target.key.column)).alias(name))
            table = table.join(right, F.col(here) == F.col("__g"), "left").drop("__g")
            continue
        collect = F.collect_set if isinstance(relation, ToMany) and relation.as_set else F.collect_list
        if isinstance(relation, ToMany):
            there, own = entity.back(relation, target)
            many = rows.groupBy(F.col(there).alias("__k")).agg(F.array_sort(collect(item)).alias(name))
        else:
            own = entity.key.column
            pairs = ws.table(relation.bridge).select(F.col(relation.source_column).alias("__k"), F.col(relation.target_column).alias("__t")).distinct()
            many = pairs.join(rows.select(F.col(target.key.column).alias("__id"), item.alias("__item")), F.col("__t") == F.col("__id")).groupBy("__k").agg(F.array_sort(collect("__item")).alias(name))
        table = table.join(many, F.col(own) == F.col("__k"), "left").drop("__k")
        table = table.withColumn(name, F.coalesce(F.col(name), F.array().cast(table.schema[name].dataType)))
    return table


def null_if_empty(table: DataFrame, column: str) -> DataFrame:
    """An embedded struct whose leaves are all null reads as null."""

    def leaves_of(path: str, kind) -> list[str]:
        if not hasattr(kind, "fields"):
            return [path]
        return [x for f in kind.fields for x in leaves_of(f"{path}.{f.name}", f.dataType)]

    tests = [F.col(p).isNotNull() for p in leaves_of(column, table.schema[column].dataType)]
    return table.withColumn(column, F.when(reduce(lambda a, b: a | b, tests), F.col(column)))


__all__ = ["Lowering", "hydrated", "null_if_empty"]
