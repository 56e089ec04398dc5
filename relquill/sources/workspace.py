"""Entity tables as immutable DataFrame versions.

A commit replaces an entity's DataFrame by one computed from it, so a query keeps the
version it began with. After ``KEEP`` commits a version is written to the shared folder and
read again, which cuts its lineage. Writers take turns by the workspace's lock.
"""

from __future__ import annotations

import posixpath
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.functions.values import Converters
from relquill.plans.declared import declared
from relquill.plans.schema import Entity, Field, Model
from relquill.sources.shared import shared_root

KEEP = 8
#: Columns of a layout that are no fields.
HIDDEN = "__turned_"


def visible(table: DataFrame) -> DataFrame:
    """Without the columns of a layout."""
    hidden = [c for c in table.columns if c.startswith(HIDDEN)]
    return table.drop(*hidden) if hidden else table


class Workspace:
    """``metadata`` makes an entity of a class that is added: by default from its dataclass fields."""

    def __init__(self, spark: SparkSession, name: str = "default", storage: str | None = None, metadata: Callable[[type], Entity] = declared):
        self.spark, self.name, self._storage, self.metadata = spark, name, storage, metadata
        self.model, self.converters = Model(), Converters()
        self.lock = threading.RLock()
        self._tables: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._commits: dict[str, int] = {}
        self._top: dict[str, int] = {}
        self._counted: set[str] = set()
        self.closed = False

    def _check(self) -> None:
        if self.closed:
            raise RuntimeError(f"workspace {self.name!r} is closed")

    @property
    def storage(self) -> str:
        """Where versions are written: a folder that driver and executors share."""
        if self._storage is None:
            self._storage = shared_root(self.spark)
        return self._storage

    @storage.setter
    def storage(self, path: str) -> None:
        self._storage = path

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """Written to the shared folder and read again: evaluated once, without lineage."""
        path = posixpath.join(self.storage, f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, entity: Entity | type, table: DataFrame | Callable[[], DataFrame] | None = None) -> Entity:
        """Declare an entity, over a DataFrame, over a function that opens one when it is first used, or empty."""
        self._check()
        if not isinstance(entity, Entity):
            entity = self.metadata(entity)
        self.model.add(entity)
        self._tables[entity.name.lower()] = table if table is not None else self.spark.createDataFrame([], entity.struct())
        return entity

    def read_parquet(self, entity: Entity | type, path: str) -> Entity:
        """An entity over Parquet files, opened when first used."""
        return self.add(entity, lambda: self.spark.read.parquet(path))

    def bridge(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        """Pairs of ids of a many-to-many relation."""
        self._check()
        self._tables[name.lower()] = table

    def stored(self, name: str) -> DataFrame:
        """A table as it lies, with the columns of its layout."""
        self._check()
        if name.lower() not in self._tables:
            raise ValueError(f"no table {name!r}")
        found = self._tables[name.lower()]
        if not isinstance(found, DataFrame):
            found = self._tables[name.lower()] = found()
        return found

    def table(self, name: str) -> DataFrame:
        return visible(self.stored(name))

    def turned(self, entity: Entity, field: Field) -> str | None:
        """The column that holds a SUFFIX field's text reversed, if the table was read from such a layout."""
        name = HIDDEN + field.column
        return name if field.index == "SUFFIX" and name in self.stored(entity.name).columns else None

    def commit(self, name: str, table: DataFrame) -> DataFrame:
        self._check()
        key, table = name.lower(), visible(table)
        self._commits[key] = self._commits.get(key, 0) + 1
        if self._commits[key] % KEEP == 0:
            table = self.held(table, key)
        self._tables[key] = table
        return table

    def version(self, name: str) -> int:
        return self._commits.get(name.lower(), 0)

    def saw_id(self, entity: Entity, top: int | None) -> None:
        """Ids up to ``top`` were given: none of them is handed out any more."""
        key = entity.name.lower()
        self._top[key] = max(self._top.get(key, 0), top or 0)

    def next_id(self, entity: Entity) -> int:
        """Dense numeric ids, from one past the largest that is stored or was given."""
        self._check()
        key = entity.name.lower()
        with self.lock:
            if key not in self._counted:
                self.saw_id(entity, self.table(key).agg(F.max(entity.key.column)).first()[0])
                self._counted.add(key)
            self._top[key] += 1
            return self._top[key]

    def write_parquet(self, name: str, path: str, files: int | None = None) -> None:
        """The current version as Parquet, laid out by the entity's index hints.

        The first ordered hint (a BTREE composite, else a BTREE, PREFIX or SUFFIX field) deals rows
        out by range, so that files and row groups do not overlap and their statistics prune;
        further ones order rows within files. SUFFIX fields get a column of their text reversed,
        in which an ending is a beginning. Fields of HASH hints, composite or not, get bloom filters
        (or, of few values, the dictionary that the writer prefers there).
        """
        entity, table = self.model.entity(name), self.table(name)
        for f in entity.fields:
            if f.index == "SUFFIX":
                table = table.withColumn(HIDDEN + f.column, F.reverse(f.column))
        columns = lambda names: [entity.field(n).column for n in names]
        ordered = [columns(names) for kind, names in entity.composites if kind == "BTREE"]
        ordered += [[HIDDEN + f.column if f.index == "SUFFIX" else f.column] for kind in ("BTREE", "PREFIX", "SUFFIX") for f in entity.fields if f.index == kind]
        if ordered:
            n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            flat = list(dict.fromkeys(c for names in ordered for c in names))
            table = table.repartitionByRange(n, *ordered[0]).sortWithinPartitions(*flat)
        writer = table.write
        hashed = [c for kind, names in entity.composites if kind == "HASH" for c in columns(names)] + [f.column for f in entity.fields if f.index == "HASH"]
        for c in dict.fromkeys(hashed):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)

    def close(self) -> None:
        self.closed = True
        self._tables.clear()
