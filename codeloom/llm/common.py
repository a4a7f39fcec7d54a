"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import fresh, global_prefix, range_bounds, range_bucket, shuffle_partitions
from ..storage import materialize, scratch_path, size_of

__all__ = ["fresh", "global_prefix", "materialize", "range_bounds", "range_bucket", "scratch_path", "shuffle_partitions"]

#: Bytes of a table (as written) up to which it is sent to every executor in a join with texts.
BROADCAST_BYTES = 16 << 20
#: ASCII white space of the contracts, as a character class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(table: DataFrame) -> DataFrame:
    """A table just written, marked for broadcast if it has at most ``BROADCAST_BYTES``; a larger one is left to the planner, which sorts and merges.

    What is joined to whole texts this way keeps them from being shuffled while it is small.
    """
    return F.broadcast(table) if size_of(table) <= BROADCAST_BYTES else table
