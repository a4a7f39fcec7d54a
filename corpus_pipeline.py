"""A training corpus in five stages: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet to the shared folder and reads it again as the
next one's docs, and removes what the stage wrote in between. All stages but the last return the columns of ``docs``.

Decisions are joined to whole rows by id and xxhash64 of the text (a null id
equals a null id), so rows that share an id are judged one by one. The decisions are written and measured first: up to a
fixed size they are broadcast and texts stay where they are, beyond it the planner sorts and merges.
Columns of other names pass through every stage but the last. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from codeloom.llm.common import fresh, materialize, read_table, sized
from codeloom.storage import scratch_scope

#: SQL can't express the classifier.
ORACLE_SQL = None


def _marked(docs: DataFrame, decided: DataFrame, how: str) -> tuple[DataFrame, str]:
    """``docs`` joined with a written table (id, row, ...) on id and text hash; the hash's column name."""
    hash_, id_, row = (fresh([*docs.columns, *decided.columns], c) for c in ("hash_of_text", "decided_id", "decided_row"))
    decided = decided.withColumnsRenamed({"id": id_, "row": row})
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(row))
    return docs.withColumn(hash_, F.xxhash64("text")).join(sized(decided), same, how), hash_


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (low quality or toxic, by text and site) go.

    A null or empty text is judged as empty, a null source or lang is a site of its own; rows that repeat id and text go together. Without labels all stay.
    """
    judged = quality.classify(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    rejected = judged.where("NOT keep").select("id", F.col("text_hash").alias("row")).distinct()
    kept, hash_ = _marked(docs, materialize(rejected, "pipeline-rejected"), "left_anti")
    return kept.drop(hash_)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document may be left without text, but stays.

    A null text becomes empty; rows with a null id keep all lines. n_chars, if there is such a column, is that of the text that is left.
    """
    kept = line_dedup.dedup_lines(docs)
    n_dropped = kept.columns[-1]
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id (null last).

    Of rows that repeat id and text one stays (the least by its other columns, as text). Null or empty texts, or those without a word, are duplicates of nothing.
    """
    decided = jaccard_join.near_duplicate_rows(docs)
    decided = materialize(decided.where("NOT keep OR n > 1"), "pipeline-duplicates")
    kept, hash_ = _marked(docs, decided.where("NOT keep").select("id", "row"), "left_anti")
    repeated = materialize(decided.where("keep").select("id", "row"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.drop(hash_)
    single, _ = _marked(kept.drop(hash_), repeated, "left_anti")
    several, hash_ = _marked(kept.drop(hash_), repeated, "left_semi")
    nth, order = fresh(several.columns, "nth"), [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    line = Window.partitionBy("doc_id", hash_).orderBy(*order or [F.lit(0)])
    several = several.withColumn(nth, F.row_number().over(line)).where(F.col(nth) == 1)
    return single.select(docs.columns).unionByName(several.select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, those with a null id too. A null or empty text holds none."""
    found = decontaminate.contaminated_rows(docs, read_table(spark, sf_dir, "benchmark"))
    kept, hash_ = _marked(docs, materialize(found.select("id", "row").distinct(), "pipeline-contaminated"), "left_anti")
    return kept.drop(hash_)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of the documents that the mix takes words from.

    A null source is a source of its own; documents without words (null and empty texts) are never taken.
    """
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            own = made.pop()  # the stage's result, the last that was written
            made += [at] * (at is not None)
            at = own
    return docs
