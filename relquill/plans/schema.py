"""Entities: typed fields, an id, embedded structs, four kinds of relation, index hints."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Type codes and the Spark types that hold them.
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(),
    "float": T.FloatType(), "double": T.DoubleType(), "char": T.StringType(), "string": T.StringType(),
    "instant": T.TimestampType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(),
    "decimal": T.DecimalType(38, 10), "bigint": T.DecimalType(38, 0),
}


@dataclass(frozen=True)
class Field:
    """A stored property. ``column`` may be a dotted struct path; ``primitive`` fields are never null."""

    name: str
    type: str
    column: str = ""
    primitive: bool = False
    converter: object = None
    #: HASH, BTREE, PREFIX, SUFFIX: how ``write_parquet`` lays rows out, never what results are.
    index: str = ""

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: no type {self.type!r}")
        if not self.column:
            object.__setattr__(self, "column", self.name)


@dataclass(frozen=True)
class ToOne:
    """A foreign key column to the target's id, or to another of its properties."""

    name: str
    target: str
    column: str
    references: str = ""


@dataclass(frozen=True)
class ToMany:
    """The reverse of the target's to-one relation ``mapped_by``; as list or set."""

    name: str
    target: str
    mapped_by: str
    as_set: bool = False


@dataclass(frozen=True)
class InverseOne:
    """The other side of the target's to-one relation ``mapped_by`` where that is one to one; of
    several rows the one of least id."""

    name: str
    target: str
    mapped_by: str


@dataclass(frozen=True)
class ManyToMany:
    """Pairs of ids in a bridge table."""

    name: str
    target: str
    bridge: str
    source_column: str
    target_column: str


Relation = ToOne | ToMany | InverseOne | ManyToMany


@dataclass(frozen=True)
class Entity:
    """One entity. ``fields`` are in column order; ``id`` names the one id property."""

    name: str
    id: str
    fields: tuple[Field, ...]
    relations: tuple[Relation, ...] = ()
    #: Audit roles (created_date, modified_date, created_by, modified_by) to property names.
    audit: Mapping[str, str] = field(default_factory=dict)
    #: Composite layouts, HASH or BTREE: (kind, properties).
    composites: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: Where ids come from that are not given: identity (the next number), uuid (text), auto (either,
    #: by the id's type), custom (``generator``, called once a row).
    generation: str = "auto"
    generator: Callable[[], object] | None = None

    def __post_init__(self):
        if self.generation not in ("auto", "identity", "uuid", "custom"):
            raise ValueError(f"{self.name}: no id generation {self.generation!r}")
        if (self.generation == "custom") != (self.generator is not None):
            raise ValueError(f"{self.name}: custom ids need a generator, and no others do")
        names = [f.name.lower() for f in self.fields] + [r.name.lower() for r in self.relations]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a property is declared twice")
        if self.field(self.id) is None:
            raise ValueError(f"{self.name}: its id {self.id!r} is no field")
        if self.generation in ("identity", "uuid") and (self.key.type in ("string", "char")) != (self.generation == "uuid"):
            raise ValueError(f"{self.name}: {self.generation} ids do not fit {self.key.type}")
        for _, props in self.composites:
            for p in props:
                if self.field(p) is None:
                    raise ValueError(f"{self.name}: composite index on unknown {p!r}")

    def field(self, name: str) -> Field | None:
        """A field by name, any case; embedded fields have dotted names."""
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name.lower() == name.lower()), None)

    @property
    def key(self) -> Field:
        return self.field(self.id)

    @property
    def generated(self) -> str:
        """identity, uuid or custom."""
        return self.generation if self.generation != "auto" else "uuid" if self.key.type in ("string", "char") else "identity"

    def back(self, relation: Relation, target: Entity) -> tuple[str, str]:
        """The target's column that names rows of this entity, and the own column that it names."""
        there = target.relation(relation.mapped_by)
        return there.column, (self.field(there.references) if there.references else self.key).column

    def struct(self) -> T.StructType:
        """The Spark schema; embedded fields nest, primitives are non-null."""
        out: dict = {}
        for f in self.fields:
            at, parts = out, f.column.split(".")
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = f
        for r in self.relations:
            if isinstance(r, ToOne) and r.column not in out:
                out[r.column] = Field(r.column, "long")

        def build(node: dict) -> T.StructType:
            return T.StructType([T.StructField(k, TYPES[v.type] if isinstance(v, Field) else build(v), not (isinstance(v, Field) and v.primitive)) for k, v in node.items()])

        return build(out)


@dataclass(frozen=True)
class Step:
    """One relation of a path."""

    relation: Relation
    entity: Entity


@dataclass(frozen=True)
class Path:
    """Relations to walk, then a field of the last entity (None: the entity itself)."""

    steps: tuple[Step, ...]
    field: Field | None

    @property
    def text(self) -> str:
        return ".".join([s.relation.name for s in self.steps] + ([self.field.name] if self.field else []))


class Model:
    """The entities of a workspace, by name."""

    def __init__(self, *entities: Entity):
        self._by_name = {e.name.lower(): e for e in entities}

    def add(self, entity: Entity) -> None:
        self._by_name[entity.name.lower()] = entity

    def entity(self, name: str) -> Entity:
        if name.lower() not in self._by_name:
            raise ValueError(f"no entity {name!r}")
        return self._by_name[name.lower()]

    def path(self, entity: Entity, text: str) -> Path:
        """Resolve ``a.b.c``: relations first, then a plain or embedded field."""
        steps, parts = [], text.split(".")
        while parts:
            if (f := entity.field(".".join(parts))) is not None:
                return Path(tuple(steps), f)
            relation = entity.relation(parts[0])
            if relation is None:
                raise ValueError(f"{entity.name} has no property {'.'.join(parts)!r}")
            entity = self.entity(relation.target)
            steps.append(Step(relation, entity))
            parts = parts[1:]
        return Path(tuple(steps), None)

    def names(self, entity: Entity, seen: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """(method-name spelling, path) of every property within reach; a relation is walked once."""
        def spelled(path: str) -> str:
            return "".join(p[:1].upper() + p[1:] for p in path.split("."))

        out = [(spelled(f.name), f.name) for f in entity.fields]
        for r in entity.relations:
            if r.target.lower() in seen or r.target.lower() not in self._by_name:
                continue
            for name, path in self.names(self.entity(r.target), (*seen, entity.name.lower())):
                out.append((spelled(r.name) + name, f"{r.name}.{path}"))
        return out
