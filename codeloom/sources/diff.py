"""Unified diffs as changed lines per file."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_diff(source: str | None) -> str:
    """None or ``-``: standard input; an existing path: its text; else the text itself."""
    if source in (None, "-"):
        return sys.stdin.read()
    try:
        return Path(source).read_text(encoding="utf-8") if Path(source).exists() else source
    except OSError:  # a diff may be too long for a path
        return source


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """One diff as rows (diff, line_no, line)."""
    return spark.createDataFrame([("diff", i, line) for i, line in enumerate(text.splitlines())], "diff string, line_no long, line string")


def _path(line: Column) -> Column:
    name = F.trim(F.substr(line, F.lit(5)))
    return F.when(name.startswith("a/") | name.startswith("b/"), F.substr(name, F.lit(3))).otherwise(name)


def changed_lines(lines: DataFrame) -> DataFrame:
    """(diff, path, changed_lines, deleted) from rows (diff, line_no, line).

    A state machine as running windows within each diff: ``diff --git`` clears
    the file, ``---`` and ``+++`` set it, ``@@`` sets the line, which all other
    lines but removed ones advance. Added and removed lines mark the line they
    stand at. As a state machine would have it, a removed line that begins with
    ``-- `` reads as a header, and the line number outlives the file.
    """
    line = F.col("line")
    run = Window.partitionBy("diff").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    reset, old, new = line.startswith("diff --git "), line.startswith("--- "), line.startswith("+++ ")
    df = lines.withColumns({"old_set": F.when(reset, F.struct(F.lit(None).cast("string").alias("p"))).when(old & ~reset, F.struct(_path(line).alias("p")))})
    df = df.withColumn("old_file", F.last("old_set", ignorenulls=True).over(run)["p"])
    chosen = F.when(_path(line) != "/dev/null", _path(line)).otherwise(F.col("old_file"))
    df = df.withColumn("file_set", F.when(reset, F.struct(F.lit(None).cast("string").alias("p"))).when(new & ~reset & ~old, F.struct(chosen.alias("p"))))
    df = df.withColumn("path", F.last("file_set", ignorenulls=True).over(run)["p"])
    body = ~reset & ~old & ~new & F.col("path").isNotNull()
    hunk = F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", 3)
    df = df.withColumns({"body": body, "begin": F.when(body & (hunk != ""), hunk.try_cast("int"))})
    df = df.withColumn("hunk", F.count("begin").over(run))
    within = Window.partitionBy("diff", "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.col("body") & F.col("begin").isNull()
    removed = line.startswith("-") & ~line.startswith("---")
    added = line.startswith("+") & ~line.startswith("+++")
    whole = Window.partitionBy("diff", "hunk")
    df = df.withColumn("at", F.max("begin").over(whole) + F.coalesce(F.sum((counted & ~removed).cast("int")).over(within), F.lit(0)))
    marks = F.when(counted & (F.col("hunk") > 0) & (removed | added), F.col("at"))
    header = F.col("file_set").isNotNull() & (F.col("path") != "/dev/null")
    first = F.when(header, F.struct("line_no", (_path(line) == "/dev/null").alias("deleted")))
    files = df.where(F.col("path").isNotNull() & (F.col("path") != "/dev/null") & (F.col("path") != ""))
    files = files.groupBy("diff", "path").agg(F.array_sort(F.collect_set(marks.cast("int"))).alias("changed_lines"), F.min(first).alias("first"))
    return files.where("first IS NOT NULL").select("diff", "path", "changed_lines", F.col("first.deleted").alias("deleted"))
