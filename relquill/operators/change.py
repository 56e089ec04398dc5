"""Saves and deletes: each makes a new version of an entity's table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relquill.plans.schema import Entity, ManyToMany
from relquill.sources.workspace import Workspace


def upserted(table: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of equal id. With ``order``
    the last row of an id in the batch wins."""
    if order:
        batch = batch.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("__row")).select("__row.*")
    return table.join(batch.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti").unionByName(batch.select(*table.columns))


def numbered(ws: Workspace, batch: DataFrame, entity: Entity) -> DataFrame:
    """``batch``, a stored table, with ids where its id is null or zero, by the entity's generation.

    Numbers are dense, from one past the largest that is stored or given: the new rows are stored
    with their places in partitions, and each partition begins after those before it. One count a
    partition reaches the driver, and no row moves.
    """
    key = entity.key.column
    kind = batch.schema[key].dataType
    new = F.col(key).isNull() if entity.generated != "identity" else F.col(key).isNull() | (F.col(key) == 0)
    given, fresh = batch.filter(~new), batch.filter(new)
    if fresh.isEmpty():
        return batch
    if entity.generated == "custom":
        raise ValueError(f"{entity.name}: ids of its own generator are assigned row by row, not to a DataFrame")
    fresh = ws.held(fresh.withColumn("__place", F.monotonically_increasing_id()), f"{entity.name.lower()}-new")
    if entity.generated == "uuid":
        # of a random number and the row's place, so that every reading agrees
        digest = F.md5(F.concat(F.lit(uuid.uuid4().hex), F.col("__place").cast("string")))
        fresh = fresh.withColumn(key, F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").cast(kind))
        return given.unionByName(fresh.drop("__place"))
    ws.saw_id(entity, given.agg(F.max(key)).first()[0])
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in fresh.groupBy(part.alias("part")).count().collect())  # one row a partition
    ahead, first = [], ws.next_id(entity)
    for p, n in counts:
        ahead.append((p, first))
        first += n
    ahead = F.broadcast(ws.spark.createDataFrame(ahead, "__part long, __ahead long"))
    fresh = fresh.join(ahead, part == F.col("__part")).withColumn(key, (F.col("__ahead") + at).cast(kind))
    return given.unionByName(fresh.drop("__place", "__part", "__ahead"))


def linked(ws: Workspace, relation: ManyToMany, pairs: DataFrame) -> DataFrame:
    """The bridge with those of ``pairs`` (source, target) that it lacks."""
    bridge = ws.table(relation.bridge)
    s, t = relation.source_column, relation.target_column
    new = pairs.select(F.col(pairs.columns[0]).alias(s), F.col(pairs.columns[1]).alias(t)).distinct()
    return bridge.unionByName(new.join(bridge, [s, t], "left_anti").select(*bridge.columns), allowMissingColumns=True)


def without_ids(table: DataFrame, entity: Entity, ids: list) -> DataFrame:
    return table.filter(~F.coalesce(F.col(entity.key.column).isin(ids), F.lit(False))) if ids else table
