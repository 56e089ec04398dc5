"""Repositories: declared methods compiled to queries, called for results or DataFrames.

    class Orders(Repository):
        entity = "Order"
        queries = {"summaries": "select o.total as total from Order o where o.total >= :min"}

    Orders(workspace).findTop3ByStatusOrderByTotalDesc("F")          # rows
    Orders(workspace).frame("findByStatus", "F")                      # a DataFrame
"""

from __future__ import annotations

import copy
import dataclasses
import datetime as dt
import re
import types
import typing
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from relquill.functions.values import coerce
from relquill.operators.change import linked, numbered, upserted, without_ids
from relquill.operators.lower import Lowering, hydrated
from relquill.plans.declared import fits, made
from relquill.plans.ir import Query
from relquill.plans.names import parse_name
from relquill.plans.schema import ManyToMany
from relquill.plans.text import parse_text
from relquill.sources.workspace import Workspace


class Repository:
    """Methods of one entity. Subclasses name it, and may carry query texts and hooks."""

    entity: str = ""
    queries: Mapping[str, str] = {}
    #: Method name to "map" (counts by key), "list", "set" (in order of first appearance), "one" or "optional"
    #: (a row or None, never one of several); of a change "int", "long" or "void".
    returns: Mapping[str, str] = {}
    #: Method name to the dataclass of its projected rows.
    records: Mapping[str, type] = {}
    #: The dataclass of entities that are read, by property names; rows if there is none.
    made_as: type | None = None

    def __init__(self, workspace: Workspace, entity: str = "", user: Callable[[], str] | None = None):
        self.ws, self.user = workspace, user
        self.spec = workspace.model.entity(entity or self.entity)
        self._compiled: dict[tuple[str, str | None], Query] = {}

    # --- compiling

    def compile(self, name: str, returns: str | None = None) -> Query:
        """The logical query of a method, kept after its first use."""
        returns = returns or self.returns.get(name)
        if (name, returns) not in self._compiled:
            if name in self.queries:
                m = re.match(r"[a-z]+(?:Top|First)(\d*)(?=[A-Z]|$)", name)
                query = parse_text(self.ws.model, self.queries[name], int(m[1] or 1) if m else None)
            else:
                query = parse_name(self.ws.model, self.spec, name, "map" if returns == "map" else None)
            self._compiled[name, returns] = self.checked(name, query, returns)
        return self._compiled[name, returns]

    def checked(self, name: str, query: Query, returns: str | None) -> Query:
        """Refuse results that a query cannot have; records have their components' order."""
        changes = query.action in ("DELETE", "UPDATE")
        if returns and (returns in ("int", "long", "void")) != changes or returns not in (None, "map", "list", "set", "one", "optional", "int", "long", "void"):
            raise ValueError(f"{name}: cannot return {returns}")
        if returns == "map" and not query.group:
            raise ValueError(f"{name}: a map needs a grouping")
        if (record := self.records.get(name)) is None:
            return query
        if not query.projection:
            raise ValueError(f"{name}: a record needs projected properties")
        paths, hints = dict(query.projection), typing.get_type_hints(record)
        names = [f.name for f in dataclasses.fields(record)]
        if sorted(names) != sorted(paths):
            raise ValueError(f"{name}: {record.__name__} has {', '.join(names)}, the query {', '.join(paths)}")
        for n in names:
            code = self.ws.model.path(self.spec, paths[n]).field.type
            if not fits(code, hints[n]):
                raise TypeError(f"{name}: {n} is {code}, which {record.__name__} does not hold")
        return dataclasses.replace(query, projection=tuple((n, paths[n]) for n in names))

    def text(self, text: str) -> Query:
        if (text, None) not in self._compiled:
            self._compiled[text, None] = parse_text(self.ws.model, text)
        return self._compiled[text, None]

    # --- reading

    def frame(self, method: str, *args, returns: str | None = None, **named) -> DataFrame:
        """A method, or a query text, as a DataFrame. Counts have a column cnt, EXISTS found;
        updates and deletes give the table they would leave."""
        spoken = re.match(r"\s*(select|update|delete)\s", method, re.I)
        return self.lowered(self.text(method) if spoken else self.compile(method, returns), args, named)

    def lowered(self, query: Query, args: tuple = (), named: dict | None = None) -> DataFrame:
        low = Lowering(self.ws, query, args, named)
        if query.group:
            return low.grouped()
        if query.action == "COUNT":
            return low.filtered().agg(F.count("*").alias("cnt"))
        if query.action == "EXISTS":
            return low.filtered().limit(1).agg((F.count("*") > 0).alias("found"))
        if query.action == "DELETE":
            return low.deleted()
        if query.action == "UPDATE":
            return low.updated()
        return low.find()

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            self.compile(name)
        except ValueError as e:
            raise AttributeError(str(e)) from e
        return lambda *args, **named: self.call(name, *args, **named)

    def call(self, name: str, *args, **named):
        """A method's result: rows, one row, a number, a truth, a dict, or rows changed."""
        query, returns = self.compile(name), self.returns.get(name)
        if query.action in ("DELETE", "UPDATE"):
            n = self.change(query, args, named)
            if returns == "int" and n >= 1 << 31:
                raise OverflowError(f"{name}: {n} rows do not fit an int")
            return None if returns == "void" else n
        df = self.lowered(query, args, named)
        if query.group:
            keys = [c for c in df.columns if c not in ("cnt", "items")]
            value = "cnt" if query.group == "COUNT" else "items"
            return {r[keys[0]] if len(keys) == 1 else Row(*keys)(*(r[k] for k in keys)): r[value] for r in df.collect()}
        if query.action == "COUNT":
            return df.first()["cnt"]
        if query.action == "EXISTS":
            return df.first()["found"]
        make = self.made(name, query)
        if returns in ("one", "optional"):
            rows = df.limit(2).collect()
            if len(rows) > 1:
                raise LookupError(f"{name}: more than one row")
            return make(rows[0]) if rows else None
        if returns == "set":
            df = df.distinct() if query.projection and not query.order else df
            return dict.fromkeys(make(r) for r in df.collect()).keys()
        return [make(r) for r in df.collect()]

    def each(self, name: str, value: Callable[[object], tuple], schema: str, *args, **named) -> DataFrame:
        """A reading method's objects, each made by a worker that has its row: a DataFrame of ``value`` of every one.

        Nothing is brought to the driver. Converters and the post_load hook run there, the hook in a
        repository whose workspace has its converters only.
        """
        query, returns = self.compile(name), self.returns.get(name)
        if query.action != "FIND" or query.group or returns not in (None, "list"):
            raise ValueError(f"{name}: no rows to make objects of")
        apart = copy.copy(self)
        apart.ws = types.SimpleNamespace(converters=self.ws.converters)
        make = apart.made(name, query)
        return self.ws.spark.createDataFrame(self.lowered(query, args, named).rdd.map(lambda r: value(make(r))), schema)

    def made(self, name: str, query: Query) -> Callable[[Row], object]:
        """What becomes of a row: a record, an entity, or a projected row as it is."""
        if (record := self.records.get(name)) is not None:
            return lambda r: record(**r.asDict())
        return (lambda r: r) if query.projection else self.loaded

    def loaded(self, row: Row):
        """A stored row with its converters' values, after the post_load hook; an object of ``made_as`` if there is one."""
        values = row.asDict()
        for f in self.spec.fields:
            if f.column in values and (c := self.ws.converters.find(self.spec.name, f)) is not None:
                values[f.column] = c.load(values[f.column])
        if (hook := getattr(type(self), "post_load", None)) is not None:
            values = hook(self, values) or values
        if self.made_as is None:
            return Row(**values)
        return made(self.made_as, {f.name: self.at(values, f.column) for f in self.spec.fields})

    @staticmethod
    def at(values: Mapping, column: str):
        """A column's value, through structs."""
        for part in column.split("."):
            values = None if values is None else values[part]
        return values

    # --- built in

    @property
    def table(self) -> DataFrame:
        return self.ws.table(self.spec.name)

    def findAll(self) -> list[Row]:
        return [self.loaded(r) for r in self.table.collect()]

    def count(self) -> int:
        return self.table.count()

    def by_id(self, id) -> DataFrame:
        if id is None:
            return self.table.limit(0)
        return self.table.filter(F.col(self.spec.key.column) == F.lit(coerce(self.spec.key, id)))

    def findById(self, id) -> Row | None:
        found = self.by_id(id).collect()
        return self.loaded(found[0]) if found else None

    def existsById(self, id) -> bool:
        return not self.by_id(id).isEmpty()

    def by_ids(self, ids) -> DataFrame:
        """Long lists are joined rather than spelled out."""
        ids = [coerce(self.spec.key, i) for i in ids if i is not None]
        key = self.spec.key.column
        if len(ids) <= 1000:
            return self.table.filter(F.col(key).isin(ids)) if ids else self.table.limit(0)
        listed = self.ws.spark.createDataFrame([(i,) for i in ids], f"__k {self.table.schema[key].dataType.simpleString()}")
        return self.table.join(listed, F.col(key) == F.col("__k"), "left_semi")

    def findAllById(self, ids) -> list[Row]:
        return [self.loaded(r) for r in self.by_ids(ids).collect()]

    def hydrated(self, *relations: str, only: Mapping[str, list[str]] | None = None) -> DataFrame:
        """The table with related rows attached; ``only`` names the columns of a relation's rows to take along."""
        return hydrated(self.ws, self.spec, self.table, *relations, only=only)

    def grouped_rows(self, method: str, *args, **named) -> DataFrame:
        """The rows of a grouping method with their keys, for groups that are too large for a list."""
        return Lowering(self.ws, self.compile(method), args, named).grouped_rows()

    # --- writing

    def save(self, row: Mapping) -> dict:
        return self.saveAll([row])[0]

    def saveAll(self, rows) -> list[dict]:
        """Insert or replace by id; the last row of an id wins. Returns the rows as saved."""
        with self.ws.lock:
            return self._saved([dict(r) for r in rows])

    def _saved(self, rows: list[dict]) -> list[dict]:
        key, now = self.spec.id, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        known = {r[self.spec.key.column] for r in self.by_ids([r[key] for r in rows if r.get(key)]).select(self.spec.key.column).collect()}
        if self.spec.generated == "identity":
            self.ws.saw_id(self.spec, max((r[key] for r in rows if isinstance(r.get(key), int)), default=0))
        for r in rows:
            new = not r.get(key)
            if new:
                r[key] = self.new_id()
            first = new or r[key] not in known
            hook = getattr(type(self), "pre_persist" if first else "pre_update", None)
            if hook is not None:
                r.update(hook(self, r) or {})
            for role, prop in self.spec.audit.items():
                if role.startswith("modified") or first and r.get(prop) is None:
                    r[prop] = now if role.endswith("date") else self.user() if self.user else None
        if not rows:
            return rows
        from pyspark.sql import types as T

        from relquill.plans.schema import TYPES

        table, fields = self.table, self.spec.fields
        # columns that are no fields, such as foreign keys, are given by their own names
        others = [c for c in table.schema if not any(f.column.split(".")[0] == c.name for f in fields)]
        stored = [(*(self.ws.converters.stored(self.spec.name, f, r.get(f.name)) for f in fields), *(r.get(c.name) for c in others), i) for i, r in enumerate(rows)]
        for s in stored:
            for f, v in zip(fields, s, strict=False):
                if f.primitive and v is None:
                    raise ValueError(f"{f.name} is never null")
        numbers = {f.column: f"f{i}" for i, f in enumerate(fields)} | {c.name: f"o{i}" for i, c in enumerate(others)}
        flat = T.StructType([*(T.StructField(f"f{i}", TYPES[f.type]) for i, f in enumerate(fields)), *(T.StructField(f"o{i}", c.dataType) for i, c in enumerate(others)), T.StructField("__seq", T.LongType())])

        def column(path: str, kind):
            if path not in numbers and hasattr(kind, "fields"):
                return F.struct(*(column(f"{path}.{c.name}", c.dataType).alias(c.name) for c in kind.fields))
            return F.col(numbers[path]).cast(kind) if path in numbers else F.lit(None).cast(kind)

        batch = self.ws.spark.createDataFrame(stored, flat).select(*(column(c.name, c.dataType).alias(c.name) for c in table.schema), "__seq")
        self.ws.commit(self.spec.name, upserted(table, batch, self.spec.key.column, "__seq"))
        return rows

    def new_id(self):
        """An id for a row without one, by the entity's generation."""
        if self.spec.generated == "identity":
            return self.ws.next_id(self.spec)
        return str(uuid.uuid4()) if self.spec.generated == "uuid" else self.spec.generator()

    def save_frame(self, batch: DataFrame, order: str | None = None) -> DataFrame:
        """Insert or replace the rows of a DataFrame; ids that are null or zero are assigned.

        Of rows of one id that of the largest ``order`` (a column of the batch that need not be
        the table's) wins; without an order such rows are refused. The batch is evaluated once.
        """
        with self.ws.lock:
            key = self.spec.key.column
            batch = self.ws.held(batch, f"{self.spec.name.lower()}-batch")
            batch = numbered(self.ws, batch, self.spec)
            if order is None:
                twice = batch.groupBy(key).count().filter("count > 1").limit(1).collect()
                if twice:
                    raise ValueError(f"{self.spec.name}: several rows of id {twice[0][key]!r}, and no order among them")
            if self.spec.generated == "identity":
                self.ws.saw_id(self.spec, batch.agg(F.max(key)).first()[0])
            return self.ws.commit(self.spec.name, upserted(self.table, batch, key, order))

    def link(self, relation: str, pairs: DataFrame) -> DataFrame:
        """Add pairs of a many-to-many relation that are not there."""
        r = self.spec.relation(relation)
        if not isinstance(r, ManyToMany):
            raise ValueError(f"{relation} is not many-to-many")
        return self.ws.commit(r.bridge, linked(self.ws, r, pairs))

    def change(self, query: Query, args: tuple = (), named: dict | None = None) -> int:
        """Run an update or delete; the number of rows it named."""
        with self.ws.lock:
            low = Lowering(self.ws, query, args, named)
            after = low.updated() if query.action == "UPDATE" else low.deleted()
            n = low.filtered().count()
            self.ws.commit(self.spec.name, after)
            return n

    def execute(self, text: str, *args, **named) -> int:
        query = self.text(text)
        if query.action not in ("UPDATE", "DELETE"):
            raise ValueError("execute takes an update or a delete")
        return self.change(query, args, named)

    def delete(self, row: Mapping) -> None:
        self.deleteById(row[self.spec.id])

    def deleteById(self, id) -> None:
        self.deleteAllById([id])

    def deleteAllById(self, ids) -> int:
        ids = [coerce(self.spec.key, i) for i in ids if i is not None]
        n = self.by_ids(ids).count()
        self.ws.commit(self.spec.name, without_ids(self.table, self.spec, ids))
        return n

    def deleteAll(self) -> int:
        n = self.count()
        self.ws.commit(self.spec.name, self.table.limit(0))
        return n
