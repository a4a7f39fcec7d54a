"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, global_prefix, materialize, shuffle_partitions


def count_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_repeats: int = 2, n_ranges: int) -> DataFrame:
    """Adds weight and target to a table of source, source_size.

    Sources by code point, null last, get ``weights`` in turn and share
    ``share`` (a fraction) of all sizes. A target above ``max_repeats`` times
    its source's size is set to that, and what is over is shared again by
    weight among the rest until none is above. Sums are integers, so reruns
    give the same doubles. One row per round reaches the driver.
    """
    ranked = sizes.withColumns({"last": F.col("source").isNull().cast("int"), "name": F.coalesce(F.col("source"), F.lit("")), "one": F.lit(1)})
    ranked = global_prefix(materialize(ranked, "mix-sources"), ["last", "name"], "one", "rank", n_ranges)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("most")), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share[0] / share[1]
    level = 0.0
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        fixed, free = ranked.agg(F.sum(F.when(above, F.col("most"))).alias("f"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if not free:
            break
        raised = (budget - (fixed or 0)) / free
        if raised <= level:
            break
        level = raised
    target = F.when(F.col("most") < F.lit(level) * F.col("weight"), F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target)


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_ranges: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``.

    Each source offers its documents in a shuffled order (by md5 of the id),
    ``max_repeats`` times over. A copy's virtual finish time is the words its
    source has offered up to and with it, divided by the source's target. All
    copies are sorted by that time (then source, repeat and shuffled order)
    and taken while their running total is within the budget, the sum of all
    targets. Sources thus advance in proportion to their targets, and the cut
    falls where all of them are nearly served.

    A source's order is summed in slices by the leading bits of the md5, each
    slice then runs on its own, and the final running total works on ranges, so
    neither a source with a third of all rows nor the whole order meets in one task.
    The text is read once; what is kept of it is its number of words.

    Null source: a source of its own, the last. Null or empty text: size 0,
    nothing taken. Rows that share an id are documents of their own,
    ordered by size, and rows without one are placed by their text; equal rows are interchangeable. No documents: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or shuffle_partitions(spark)
    # a row without an id is placed by its text
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\0"), F.xxhash64(text_col).cast("string")))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), key))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), shuffled.alias("turn"))
    sized = materialize(sized, "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, max_repeats=max_repeats, n_ranges=min(n_ranges, 16))
    targets = materialize(targets, "mix-targets")
    slice_of = F.substring("turn", 1, 3)  # 12 bits
    sums = sized.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    sums = sums.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "slice").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("slice", slice_of).withColumns({"upto": F.sum("size").over(within), "nth": F.row_number().over(within)})
    run = run.join(sums.withColumnsRenamed({"source": "s", "slice": "sl"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    run = run.join(targets.select(F.col("source").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t")))
    run = materialize(run.select("id", "source", "size", "turn", "nth", (F.col("upto") + F.col("offset")).alias("offered"), "source_size", "target"), "mix-run")
    finish = (F.col("offered") + F.col("source_size") * F.col("repeat")) / F.col("target")
    copies = run.where("size > 0").select("id", "source", "size", "turn", "nth", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("repeat"), "offered", "source_size", "target")
    copies = copies.select("size", "turn", "nth", "repeat", F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().cast("int").alias("last"), finish.alias("finish"))
    order = ["finish", "last", "name", "repeat", "turn", "nth"]
    copies = materialize(copies, "mix-copies")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = min(total * share[0] / share[1], float(total * max_repeats))
    queued = global_prefix(copies, order, "size", "upto", n_ranges).where(F.col("upto") <= F.lit(budget))
    taken = queued.groupBy("last", "name", "turn", "nth").agg(F.sum("size").alias("taken"))
    taken = taken.withColumn("key", F.when(F.col("last") == 0, F.col("name"))).drop("last", "name").withColumnsRenamed({"turn": "taken_turn", "nth": "taken_nth"})
    same = (F.col("turn") == F.col("taken_turn")) & F.col("source").eqNullSafe(F.col("key")) & (F.col("nth") == F.col("taken_nth"))
    return run.join(taken, same, "left").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))
