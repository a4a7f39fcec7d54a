"""URL filters: block and allow rules on hosts and paths, matched by a sort-merge range join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, range_bounds, range_bucket, shuffle_partitions

#: Above every character that a reversed host can go on with.
_HIGH = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(F.substr(url, F.locate("://", url) + F.lit(3)), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) == 0, "").otherwise(F.translate(host, UPPER, LOWER))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    rest = F.substring_index(F.substring_index(F.substr(url, F.locate("://", url) + F.lit(3)), "?", 1), "#", 1)
    return F.when((F.coalesce(F.locate("://", url), F.lit(0)) == 0) | (F.locate("/", rest) == 0), "").otherwise(F.substr(rest, F.locate("/", rest)))


def reversed_key(host: Column) -> Column:
    """``a.example.com`` as ``com.example.a.``: a rule's subdomains are the keys that its own key begins."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", n_ranges: int | None = None) -> DataFrame:
    """Host, path, matching rule and verdict of every url.

    ``rules`` has host, path_prefix and action. A rule fits its host and all
    subdomains where the path starts with its prefix; the longest (host and
    prefix in characters) wins, then the longer host, then the larger prefix
    and action. No rule: null, and ``default``.

    Reversed hosts make each rule host an interval of sorted keys, and the
    intervals nest. Urls and rule hosts are cut into ``n_ranges`` ranges of
    about equal size (a hot host is cut by path and id), a rule being copied
    to the ranges that its interval meets; each range is sorted and swept once.
    The sweep's stack has a slot for each number of labels: a rule host
    overwrites its slot when its interval begins, and a slot counts while its
    interval is open. No rule set is broadcast, and no range is gathered.

    Null or ``://``-less urls: host and path empty, no rule. Null ids and
    repeated rows are kept, one row out for each in. Rules with null or empty
    host are ignored; null prefixes count as empty. Other columns of ``pages``
    are not returned. Empty ``rules`` or ``pages``: default verdicts, or no rows.
    """
    spark = pages.sparkSession
    n_ranges = n_ranges or shuffle_partitions(spark)
    hosts = (
        rules.where("host IS NOT NULL AND host <> ''")
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce(F.col("path_prefix"), F.lit("")).alias("prefix"), "action")
        .distinct()
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct(F.length(F.concat("host", "prefix")).alias("n"), F.length("host").alias("h"), F.concat("host", "prefix").alias("rule"), "prefix", "action")), asc=False).alias("entries"))
        .withColumn("key", reversed_key(F.col("host")))
        .withColumn("depth", F.size(F.split("host", r"\.")))
    )
    depth = hosts.agg(F.max("depth")).first()[0] or 0
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.select("id", "host", "path", reversed_key(F.col("host")).alias("key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("tie"))
    bounds = range_bounds(urls, ["key", "path", "tie"], n_ranges)
    cut = lambda *c: range_bucket(c, bounds)
    entry = hosts.schema["entries"].dataType
    points = urls.select(
        cut(F.col("key"), F.col("path"), F.col("tie")).alias("part"), "key", F.lit(1).alias("kind"), "path", "tie", "id", "host", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(entry).alias("entries")
    )
    starts = hosts.select(
        F.explode(F.sequence(cut(F.col("key"), F.lit(""), F.lit("")), cut(F.concat("key", F.lit(_HIGH)), F.lit(""), F.lit("")))).alias("part"),
        "key", F.lit(0).alias("kind"), F.lit("").alias("path"), F.lit("").alias("tie"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), "depth", "entries",
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind", "path", "tie").rowsBetween(Window.unboundedPreceding, 0)
    stack = {f"slot{d}": F.last(F.when(F.col("depth") == d, F.struct("key", "entries")), ignorenulls=True).over(sweep) for d in range(1, depth + 1)}
    swept = points.unionByName(starts).withColumns(stack).where("kind = 1")
    fits = [
        F.when(F.startswith("key", F.col(f"slot{d}.key")), F.filter(F.col(f"slot{d}.entries"), lambda e: F.startswith(F.col("path"), e["prefix"]))) for d in range(1, depth + 1)
    ]
    none = F.lit(None).cast(entry)
    best = F.array_max(F.flatten(F.array_compact(F.array(*fits)))) if fits else F.array_max(none)
    return swept.select(F.col("id").alias(id_col), "host", "path", best.alias("best")).select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    )
