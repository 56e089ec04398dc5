"""A stream of entity rows as upserts, one commit for each micro batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relquill.repository import Repository


def upsert_stream(repository: Repository, rows: DataFrame, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Apply a streaming DataFrame to a repository's table. ``order`` names a column whose
    largest value wins among rows of one id within a batch. A batch that is delivered again
    leaves the same table, since rows replace those of equal id."""
    from relquill.operators.change import upserted

    spec = repository.spec
    def apply(batch: DataFrame, epoch: int) -> None:
        # the batch outlives its epoch inside the new version, so it is stored first
        held = _stored(repository, batch, epoch)
        with repository.ws.lock:
            if spec.generated == "identity":
                repository.ws.saw_id(spec, held.agg({spec.key.column: "max"}).first()[0])
            repository.ws.commit(spec.name, upserted(repository.table, held, spec.key.column, order))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def _stored(repository: Repository, batch: DataFrame, epoch: int) -> DataFrame:
    path = f"{repository.ws.storage}/{repository.spec.name.lower()}-epoch-{epoch}"
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)
