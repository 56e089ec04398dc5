"""Operator 7, mixing sources to target weights by entropy balancing. Native.

Each source's documents get rates w(size) = min(3, exp(lambda * size / mean size)):
the weights nearest to 1 in relative entropy whose words meet the source's target
under the bound of three copies. The dual is one concave function per source; all
sources take safeguarded Newton steps at once, each a pre-aggregated group over
(source, size) cells. Rates become whole copies by systematic rounding in order of
size, so a source misses its target by less than its longest document; then single
copies are moved to where they close most of that gap.

Only DataFrame functions. Ranks inside hot cells are dealt over hashed sub-cells of
about ``RANK_ROWS`` rows, by a hash of the id so that reruns agree however the rows are
laid out; a sub-cell that rows of one id (or of none) make larger than twice that is dealt
once more by row number, so a cell may hold any share of the rows. Rows of a hot cell get its
rate where they are (``join_hot``). The table of sources
(one row each) is ordered in one place, and each source's sizes (one row each, at most the words
of its longest text) in one task.

Null text: size 0. Null source: a source of its own, ranked last. Size 0: taken 0. Very long
texts count like any other. Null ids and repeated rows: documents of their own, told apart
by nothing but their rank. Ties of size go by a hash of the id. Empty table: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquill.llm.common import WHITE, documents, join_hot, materialize

WEIGHTS, MOST = (5, 2, 1), 3
#: Sources up to which a table of one row a source is broadcast (under 100 bytes a row).
BROADCAST_SOURCES = 10_000
#: Single copies moved per source after rounding.
CORRECTIONS = 2
RANK_ROWS = 4096
#: Newton steps at most, steps between two tables, and the relative error that ends them.
#: A step that leaves its bracket halves it, so the steps end even far from the solution.
STEPS, STEPS_A_TABLE, MISS = 60, 3, 1e-9


def word_count(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[ \x09-\x0D]+"))).cast("long")


def source_targets(cells: DataFrame) -> DataFrame:
    """(sid, source, source_size, target) from (source, size, n) cells.

    Targets are a water filling: T = min(3 S, mu * weight) with the mu that spends
    all words, found by walking the sources in order of S / weight.
    """
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.col("sid"), F.lit(len(WEIGHTS)))
    weight = F.when(kind == 0, WEIGHTS[0]).when(kind == 1, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("double")
    ranked = per.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(MOST))).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = ranked.withColumn("mu", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that its share does not fill fixes mu for all that follow
    level = F.max(F.when(F.col("mu") <= F.col("ratio"), F.col("mu"))).over(whole)
    return filled.withColumn("level", level).select("sid", "source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def balanced(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(sid, lam, scale): the dual of each source, by Newton steps inside a bracket."""
    at = cells.groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    full = F.col("target") >= F.col("source_size") * MOST
    state = targets.filter(~full).join(at, "sid").select("sid", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.coalesce("least", F.lit(1)).alias("least"), F.log(F.greatest(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(1e-9))).alias("lam"))
    # exp(lam x) spans (0, 3] for every size between these ends
    state = materialize(state.select("sid", "target", "scale", "lam", (F.lit(-60.0) * F.col("scale") / F.col("least")).alias("lo"), (F.lit(2.0) * F.col("scale") / F.col("least")).alias("hi")), "newton")
    for step in range(STEPS):
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(2.0)))
        met = cells.join(state, "sid").groupBy(*state.columns).agg(F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(MOST)))).alias("words"), F.sum(F.when(rate < MOST, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        short = F.col("words") < F.col("target")
        met = met.withColumn("lo", F.when(short, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(short, F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") - F.when(F.col("slope") > 0, (F.col("words") - F.col("target")) / F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        miss = F.abs(F.col("words") - F.col("target")) / F.greatest("target", F.lit(1.0))
        # a source that meets its target keeps its dual
        state = met.select("sid", "target", "scale", F.when(miss <= MISS, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", miss.alias("miss"))
        if step % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            state = materialize(state, "newton")
            if not state.filter(F.col("miss") > MISS).limit(1).count():
                break
        state = state.drop("miss")
    return targets.join(state.select("sid", "lam", "scale"), "sid", "left").select("sid", "lam", "scale")


def beside(rows: DataFrame, table: DataFrame, by: tuple[str, ...], value: str, how: str = "inner") -> DataFrame:
    """``rows`` with the column ``value`` of the row of ``table`` that has the same ``by``, nulls equal."""
    named = table.select(*(F.col(c).alias(f"by_{c}") for c in by), value)
    same = [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in by]
    return rows.join(named, same, how).drop(*(f"by_{c}" for c in by))


def mixed(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (doc_id, text, source) as (doc_id, *keep, size, source_size, target, copies).

    ``keep`` names narrow columns that come along, such as a row number."""
    rows = materialize(docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("number")), "sizes")
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = materialize(source_targets(counted), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    named = F.broadcast(targets) if few else targets
    cells = materialize(counted.alias("c").join(named.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("sid", "c.source", "size", "n", "source_size", "target"), "cells-by-source")
    dual = balanced(cells.select("sid", "size", "n"), targets.select("sid", "source_size", "target"))
    rate = F.when(F.col("lam").isNull(), F.lit(float(MOST))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(2.0))), F.lit(float(MOST))))
    by_size = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = cells.join(dual, "sid").withColumn("rate", rate).withColumn("before", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(by_size), F.lit(0.0)))
    rated = materialize(rated.select("sid", "source", "size", "n", "source_size", "target", "rate", "before"), "rates")
    deal = F.xxhash64("doc_id", "size")
    dealt = join_hot(rows, rated, ("source", "size"), "n").withColumn("deal", deal).withColumn("sub", F.pmod("deal", F.ceil(F.col("n") / RANK_ROWS)))
    place = ("source", "size", "sub")
    subs = materialize(dealt.groupBy(*place).agg(F.count("*").alias("m")), "sub-cells")
    crowded = subs.filter(F.col("m") > 2 * RANK_ROWS)
    if crowded.limit(1).count():
        more = F.pmod(F.xxhash64("number"), F.ceil(F.col("m") / RANK_ROWS)) * F.ceil(F.col("n") / RANK_ROWS)
        dealt = beside(dealt, crowded, place, "m", "left").withColumn("sub", F.col("sub") + F.coalesce(more, F.lit(0))).drop("m")
        subs = materialize(dealt.groupBy(*place).agg(F.count("*").alias("m")), "sub-cells")
    # ranks within a cell: rows before the sub-cell, then within it
    earlier = Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*place).orderBy("deal", "doc_id", "number")
    ranked = beside(dealt.withColumn("rank", F.row_number().over(own)), subs.withColumn("ahead", F.coalesce(F.sum("m").over(earlier), F.lit(0))), place, "ahead")
    upto = F.col("before") + F.col("rate") * (F.col("ahead") + F.col("rank"))
    # a 1e-9 guard keeps sums of whole rates on their side of the step
    step = lambda c: F.floor(c + F.lit(0.5 + 1e-9))
    copies = F.least(F.greatest(step(upto) - step(upto - F.col("rate")), F.lit(0)), F.lit(MOST))
    rounded = materialize(ranked.select("doc_id", *keep, "sid", "size", "sub", "rank", "source_size", "target", copies.cast("int").alias("copies")), "rounded")
    for _ in range(CORRECTIONS):
        rounded = corrected(rounded, few)
    return rounded.select("doc_id", *keep, "size", "source_size", "target", "copies")


def corrected(rounded: DataFrame, few: bool) -> DataFrame:
    """One document of each source gains or loses a copy: that whose size is nearest to
    what its source lacks or has too much, if the source comes nearer to its target.

    ``few``: one row a source is small enough to be broadcast, so no source's rows meet.
    """
    small = F.broadcast if few else (lambda df: df)
    off = rounded.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    able = F.when(F.col("off") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs(F.col("off")) - F.col("size"))
    picks = rounded.join(small(off), "sid").filter(able & (left < F.abs("off"))).groupBy("sid").agg(F.min(F.struct(left.alias("left"), "size", "sub", "rank", F.signum("off").cast("int").alias("change"))).alias("pick"))
    chosen = (F.col("size") == F.col("pick.size")) & (F.col("sub") == F.col("pick.sub")) & (F.col("rank") == F.col("pick.rank"))
    return rounded.join(small(picks), "sid", "left").withColumn("copies", F.col("copies") + F.when(chosen, F.col("pick.change")).otherwise(0)).drop("pick")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
