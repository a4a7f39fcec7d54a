"""Diffs that arrive as files: each batch is turned into impacted nodes against a fixed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import impact, traverse
from ..sources.diff import changed_lines
from ..storage import materialize


def read_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (diff, text), one row per file that lands in ``folder``."""
    files = spark.readStream.schema("value string").option("wholetext", "true").text(folder)
    return files.select(F.col("_metadata.file_name").alias("diff"), F.col("value").alias("text"))


def impact_stream(diffs: DataFrame, nodes: DataFrame, edges: DataFrame, out: str, checkpoint: str, project: str = "", depth: int = 6) -> StreamingQuery:
    """Appends (diff, id, type, confidence, impact_status) of each diff to the Parquet table ``out``.

    All diffs of a batch go through one plan. A batch is written under its number, so one that is run again replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        lines = df.select("diff", F.posexplode(F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n")).alias("line_no", "line"))
        lines = lines.select("diff", F.col("line_no").cast("long").alias("line_no"), "line")
        changes = changed_lines(lines)
        seeds = materialize(impact.seeds(nodes, changes, project, ("diff",)), "seeds")
        paths = traverse.impact_paths(edges, seeds, depth, by=("diff",))
        hit = impact.impacted(nodes, paths, seeds, ("diff",)).select("diff", "id", "type", "confidence", "impact_status")
        hit.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return diffs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
