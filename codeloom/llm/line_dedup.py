"""Line dedup: drop lines that many documents share, keeping each in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, materialize, sized

_BLANKS = " \t\n\x0b\x0c\r"


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops every line whose key is frequent, except in the largest id that holds it.

    The text is split at ``\\n``. A line's key is the line without ASCII white
    space at its ends and with A-Z lower-cased; keys of at least ``min_chars``
    code points in at least ``min_docs`` distinct documents are frequent. The
    result has the input's columns and rows, ``text_col`` reassembled by
    position, and n_lines and n_dropped (renamed if such columns exist).

    A coarse 64-bit hash of the fully lower-cased line, exploded and counted by
    distinct document, leaves few candidate lines; only these get the exact
    key, a second count and the choice of the document that keeps them. Counts
    are pre-aggregated, so a line in a third of all documents is one row per
    task. Texts are shuffled once at most, for the join with the positions, and
    not at all while those are few enough to be broadcast.

    Null or empty text: one empty line, and the text becomes empty. A row with a null id is
    not counted as a document and keeps all its lines. Rows that share an id
    are one document in the counts and are reassembled each from its own text.
    Any other columns pass through.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines")
    ).where("id IS NOT NULL")
    long_lines = base.select("id", "text_hash", F.posexplode("lines").alias("pos", "line")).where(F.length(_stripped(F.col("line"))) >= min_chars)
    coarse = F.xxhash64(F.lower(_stripped(F.col("line"))))
    common = (
        long_lines.select("id", coarse.alias("coarse")).groupBy("coarse").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs).select("coarse")
    )
    common = materialize(common, "line-candidates")
    stripped = _stripped(F.col("line"))
    held = (
        long_lines.withColumn("coarse", coarse)
        .join(common, "coarse", "left_semi")
        .select("id", "text_hash", "pos", F.sha2(F.translate(stripped, UPPER, LOWER), 256).alias("key"))
    )
    held = materialize(held, "line-holders")
    frequent = held.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    frequent = materialize(frequent.select("key", "keeper"), "line-frequent")  # so that a hot line's holders are split in the join
    drops = (
        held.join(frequent, "key")
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "text_hash")
        .agg(F.collect_set("pos").alias("drops"))
    )
    drops = materialize(drops, "line-drops")
    names = list(docs.columns)
    for c in ("drops", "dropped_id", "text_hash", "dropped_hash", "lines", "n_lines", "n_dropped"):
        names.append(fresh(names, c))
    hit, at, text_hash, gone_hash, lines, n_lines, n_dropped = names[-7:]
    drops = drops.select(F.col("id").alias(at), F.col("text_hash").alias(gone_hash), F.col("drops").alias(hit))
    same = (F.col(id_col) == F.col(at)) & (F.col(text_hash) == F.col(gone_hash))
    joined = docs.withColumn(text_hash, F.xxhash64(text_col)).join(sized(drops), same, "left")
    joined = joined.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    kept = F.when(F.col(hit).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(hit), i)), "\n")
    )
    counted = joined.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.size(hit), F.lit(0)).cast("long")})
    counted = counted.withColumn(n_dropped, F.when(F.col(hit).isNull(), F.lit(0).cast("long")).otherwise(F.col(n_dropped)))
    return counted.withColumn(text_col, kept).select(*docs.columns, n_lines, n_dropped)
