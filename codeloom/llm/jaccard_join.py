"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialize, sized
from .tokens import chunks, hash_words, mix, shingles

#: Members of a bucket that are compared with each other, or with another block, in one go.
BLOCK = 512


def choose_bands(threshold: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which a pair at ``threshold`` meets in a band with probability ``recall``."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding within so many hashes reaches this recall")


def _signatures(n: int, bands: int, rows: int):
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64), 11) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows_, text = batch.columns
            for begin, end in chunks(text):
                words, ptr = hash_words(text[begin:end])
                grams, at = shingles(words, ptr, n)
                some = np.flatnonzero(np.diff(at))
                band = np.zeros((end - begin, bands), np.uint64)
                if len(some):
                    starts = at[some]
                    for b in range(bands):
                        value = np.zeros(len(some), np.uint64)
                        for r in range(rows):
                            value = mix(value ^ np.minimum.reduceat(grams * factors[b * rows + r], starts), r)
                        band[some, b] = value
                key = [hashlib.blake2b(words[ptr[i] : ptr[i + 1]].tobytes(), digest_size=16).digest() for i in range(end - begin)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - begin + 1) * bands, bands), pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids[begin:end], rows_[begin:end], pa.array(key, pa.binary()), pa.array(np.diff(ptr)), lists], ["id", "row", "key", "n_words", "bands"])

    return run


def _gram_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for begin, end in chunks(text):
                grams, at = shingles(*hash_words(text[begin:end]), n)
                sets = [np.unique(grams[at[i] : at[i + 1]]).view(np.int64) for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array(sets, pa.list_(pa.int64()))], ["key", "grams"])

    return run


def linked_pairs(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i, the later sets j with Jaccard(i, j) >= threshold.

    Sets are held as their difference from the grams that most of them have:
    the symmetric difference of two sets is that of their differences, so sets
    that are nearly alike cost what they differ by, not what they hold.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(code, minlength=len(flat)) * 2 > m
    core, owner = int(common.sum()), np.repeat(np.arange(m), sizes)
    grid: list[np.ndarray] = []
    for i, own in enumerate(np.split(code, np.cumsum(sizes)[:-1])):
        lacks = common.copy()
        lacks[own[common[own]]] = False
        grid.append(np.concatenate((own[~common[own]], np.flatnonzero(lacks))) if core else own)
    extent = np.array([len(g) for g in grid])
    all_ = np.concatenate(grid)
    owner = np.repeat(np.arange(m), extent)
    order = np.argsort(all_, kind="stable")
    holders, first = owner[order], np.searchsorted(all_[order], np.arange(len(flat) + 1))
    for i in range(m - 1):
        met = [holders[first[g] : first[g + 1]] for g in grid[i].tolist() if first[g + 1] - first[g] > 1]
        shared = np.bincount(np.concatenate(met), minlength=m) if met else np.zeros(m, np.int64)
        apart = extent[i] + extent - 2 * shared
        both = sizes[i] + sizes
        alike = (both - apart) >= threshold * (both + apart) - 1e-9
        yield i, i + 1 + np.flatnonzero(alike[i + 1 :])


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        block, copies = table["block"].to_numpy(), table["copies"].to_numpy()
        band, left, right = table["band"][0].as_py(), table["left"][0].as_py(), table["right"][0].as_py()
        grams = table["grams"].combine_chunks()
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        bands = np.array(table["bands"].to_pylist())
        links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(keys) > 1:
            for i, js in linked_pairs([flat[at[i] : at[i + 1]] for i in range(len(keys))], threshold):
                if left != right:
                    js = js[block[js] != block[i]]
                # a pair that meets in several bands counts in the first of them
                js = js[(bands[js] == bands[i]).argmax(axis=1) == band] if len(js) else js
                if len(js):
                    links[i] += copies[js].sum()
                    links[js] += copies[i]
                    for j in js.tolist():
                        x, y = find(i), find(j)
                        if x != y:
                            root[max(x, y)] = min(x, y)
        hit = np.flatnonzero(links).tolist()
        return pa.table({"key": pa.array([keys[i] for i in hit], pa.binary()), "links": links[hit], "root": pa.array([keys[find(i)] for i in hit], pa.binary())})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _joined(base: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """From rows (id, row, text): the distinct rows (id, row, key, n_words, n), and per text with a word (key, id, copies, links, root)."""
    bands, rows = choose_bands(threshold, recall)
    kind = base.schema["id"].dataType.simpleString()
    signed = base.mapInArrow(_signatures(n, bands, rows), f"id {kind}, row long, key binary, n_words long, bands array<long>")
    signed = signed.groupBy("id", "row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    signed = materialize(signed, "jaccard-signatures")
    # of each text a row that has it, the number of documents and the band hashes
    texts = signed.where("n_words > 0").groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.min(F.struct("id", "row")).alias("held"), F.first("bands").alias("bands"))
    texts = materialize(texts, "jaccard-texts")
    banded = texts.select("key", F.posexplode("bands").alias("band", "value"))
    buckets = (
        banded.groupBy("band", "value")
        .agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .where("m > 1")
        .groupBy("m", "x", "y", "lo", "hi")
        .agg(F.min(F.struct("band", "value")).alias("k"))
        .select("k.*", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    members = banded.join(materialize(buckets, "jaccard-buckets"), ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "value", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    members = materialize(members, "jaccard-members")
    wanted = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("held.id").alias("held_id"), F.col("held.row").alias("held_row"))
    wanted = materialize(wanted, "jaccard-wanted")
    held = base.join(sized(wanted), F.col("id").eqNullSafe(F.col("held_id")) & (F.col("row") == F.col("held_row"))).select("key", "text")
    sets = held.mapInArrow(_gram_sets(n), "key binary, grams array<long>").groupBy("key").agg(F.first("grams").alias("grams"))  # repeated rows
    sets = sets.join(texts.select("key", "copies", "bands"), "key")
    checked = members.join(sets, "key").groupBy("band", "value", "left", "right").applyInArrow(_verify(threshold), "key binary, links long, root binary")
    checked = materialize(checked, "jaccard-links")
    roots = connected_components(checked.select("key", "root"), "key", "root").withColumnRenamed("node", "key")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    found = texts.select("key", "id", "copies").join(links, "key", "left").join(roots, "key", "left")
    found = found.select("key", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))
    return signed.drop("bands"), materialize(found, "jaccard-classes")


def jaccard_join(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) for every document: the near-duplicate join on word ``n``-grams.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``; n_links counts a document's links, and
    class_id is the least id that links lead to. Pairs at the threshold are
    candidates with probability ``recall`` (from which bands and rows follow), and closer ones more often;
    every candidate is decided on the full sets.

    Equal texts (word for word) are one text with a number of copies. Band
    hashes are shuffled, buckets with the same members are joined once, and only
    texts in buckets of two or more carry their sets on. A bucket is compared
    in blocks of ``BLOCK`` members, each pair of blocks a task of its own, and yields a row per
    member with the sum of its links and its root, never a row per pair; a
    pair counts in the first band that it shares.

    Ids may be of any type that has an order. A document is an id with a text: rows that repeat both
    are one document, and rows that share an id but not the words are documents of their own with a row each in the result.
    Rows with a null id are left out. Null or empty texts, or those without a
    word, have no links and are classes of their own. Texts of fewer than ``n``
    words are one gram. No documents: no rows. Other columns are ignored.
    """
    signed, texts = _joined(_rows(docs, id_col, text_col).where("id IS NOT NULL"), threshold, n, recall)
    least = materialize(texts.groupBy("root").agg(F.min("id").alias("class_id")), "jaccard-least")
    classes = materialize(texts.join(least, "root").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "jaccard-decided")
    documents = signed.select("id", F.when(F.col("n_words") > 0, F.col("key")).alias("key")).distinct()
    out = documents.join(classes, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce(F.col("n_links"), F.lit(0)).alias("n_links"))


def near_duplicate_rows(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, keep, n): for every distinct row of ``docs`` (``row`` is the xxhash64 of the text) whether it stays if one document of each class does, and how often it stands (without a word: 1).

    The least row of a class by id (null last), then ``row``, stays. Rows without a word all stay; the classes are those of jaccard_join.
    """
    signed, texts = _joined(_rows(docs, id_col, text_col), threshold, n, recall)
    placed = signed.join(texts.select("key", "root"), "key", "left").select("id", "row", F.when(F.col("n_words") > 0, F.col("n")).otherwise(1).alias("n"), "n_words", "root")
    placed = materialize(placed, "jaccard-placed")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    keepers = materialize(placed.where("n_words > 0").groupBy("root").agg(F.min(rank).alias("keeper")), "jaccard-keepers")
    first = (F.col("keeper.row") == F.col("row")) & F.col("keeper.id").eqNullSafe(F.col("id"))
    return placed.join(keepers, "root", "left").select("id", "row", (F.col("keeper").isNull() | first).alias("keep"), "n")
