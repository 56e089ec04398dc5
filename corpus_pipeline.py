"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of ``documents``. ``run`` writes each result as
Parquet to the shared folder and reads it again. SQL cannot express the stages, so
ORACLE_SQL is None and the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm import decontam, mixing, nearcopies, tokens, toxicity
from relquill.llm.common import documents, free_name, materialize

ORACLE_SQL = None
#: Row numbers (8 bytes each) up to which a join sends them to every executor.
BROADCAST_ROWS = 1_000_000


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(document, row): whole rows beside a number of their own, stored so that a repeated attempt cannot change it."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    return materialize(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Null and empty texts have the score of the model's
    bias; repeated rows go or stay together; any other columns stay."""
    score = free_name(docs.columns, "toxicity")
    return toxicity.scored(docs, documents(spark, sf_dir, "labels"), toxicity.learnable, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word similarity of 0.8) one row: of smallest id, rows without an id last.

    Null texts and texts without words are one group; repeated rows and texts that differ in
    case or white space only are near copies; any other columns stay.
    Rows are told apart by a number of their own, so rows that share an id are compared by
    text like any others. Ties of the id go by a hash of the text, then by row number.
    Only row numbers, ids and digests are grouped: texts are read where they stand.
    """
    row, numbered = "row", numbered_rows(docs)
    groups = materialize(nearcopies.near_copies(numbered.select(row, "document.doc_id", "document.text").withColumn("tie", F.xxhash64("text")), "doc_id", "tie"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", row)
    first = groups.groupBy("component").agg(F.min(order).alias("least")).select(F.col(f"least.{row}").alias(row))
    gone = materialize(groups.select(row).join(first, row, "left_anti"), "copies")
    # a merge join once the rows that go are too many to send to every executor
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return numbered.join(gone, row, "left_anti").select("document.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or
    stay together; any other columns stay."""
    return decontam.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share wants it, up to three times. Null sources are
    a source; null and empty texts have no words, so they cost a source nothing and are kept
    at its rate of size 0; repeated rows are rows of their own; any other columns stay."""
    row, numbered = "row", numbered_rows(docs)
    copies = mixing.mixed(numbered.select("document.doc_id", "document.source", "document.text", row), row).select(row, "copies").filter("copies > 0")
    # a merge join at every size: the copies grow with the documents
    taken = numbered.join(copies.hint("merge"), row)
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in order of doc_id (null first), read back: one row a document, whatever its columns."""
    return tokens.token_output(spark, docs)


STAGES = [("toxicity", reject_toxic), ("simhash", one_of_each), ("decontamination", without_benchmark), ("mixing", mix), ("tokens", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
