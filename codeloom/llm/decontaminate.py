"""Benchmark decontamination by greedy string tiling (running Karp-Rabin)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import chunks, hash_words, shingles

#: Bits of the seed filter that every task gets: its size is fixed, however many test items there are.
FILTER_BITS = 22


def _items(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ptr = hash_words(batch.column(1))
            grams, at = shingles(words, ptr, n)
            long_ = np.diff(ptr) >= n
            found = [np.unique(grams[at[i] : at[i + 1]] if long_[i] else grams[:0], return_counts=True) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([words[ptr[i] : ptr[i + 1]].view(np.int64) for i in range(len(batch))], pa.list_(pa.int64())),
                    pa.array([seeds.view(np.int64) for seeds, _ in found], pa.list_(pa.int64())),
                    pa.array([places for _, places in found], pa.list_(pa.int64())),
                ],
                ["item_id", "words", "seeds", "places"],
            )

    return run


def _runs(n: int, filter_words: dict[int, int]):
    filled = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for at, bits in filter_words.items():
        filled[at] = bits & 0xFFFFFFFFFFFFFFFF
    filled = np.unpackbits(filled.view(np.uint8), bitorder="little").view(bool)
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rows = batch.column(2), []
            out: dict[str, list] = {"at": [], "words": [], "seeds": []}
            for begin, end in chunks(text):
                words, ptr = hash_words(text[begin:end])
                grams, gram_at = shingles(words, ptr, n)
                hit = np.flatnonzero(filled[grams >> shift])
                if not len(hit):
                    continue
                row = np.searchsorted(gram_at, hit, "right") - 1
                long_ = (ptr[row + 1] - ptr[row]) >= n
                hit, row = hit[long_], row[long_]
                cut = np.flatnonzero(np.diff(hit, prepend=-2) != 1) if len(hit) else hit
                cut = np.union1d(cut, np.flatnonzero(np.diff(row, prepend=-1))) if len(hit) else cut
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)], strict=False):
                    r = int(row[a])
                    at = int(hit[a] - gram_at[r])
                    first = int(ptr[r]) + at
                    rows.append(begin + r)
                    out["at"].append(at)
                    out["words"].append(words[first : first + b - a + n - 1].view(np.int64))
                    out["seeds"].append(np.unique(grams[hit[a:b]]).view(np.int64))
            if rows:
                lists = [pa.array(out[c], pa.list_(pa.int64())) for c in ("words", "seeds")]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows)) for i in (0, 1)], pa.array(out["at"], pa.int64()), *lists], ["id", "row", *out])

    return run


_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Rolled:
    """A text of word hashes whose Karp-Rabin hash of any run of words is one subtraction away, and which words are marked."""

    def __init__(self, words: np.ndarray, power: np.ndarray) -> None:
        self.words, self.power, self.marked = words, power, np.zeros(len(words), bool)
        total, run = np.zeros(len(words) + 1, np.uint64), 0
        for i, w in enumerate(words.tolist()):
            run = (run * int(_BASE) + w + 1) & 0xFFFFFFFFFFFFFFFF
            total[i + 1] = run
        self.total = total

    def runs(self, length: int, crossing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and hash of every run of ``length`` unmarked words that crosses no part's end."""
        if len(self.words) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate(([0], np.cumsum(self.marked)))
        free = taken[length:] == taken[:-length]
        if crossing is not None:
            free &= crossing[length - 1 :] == crossing[: len(crossing) - length + 1]
        at = np.flatnonzero(free)
        return at, self.total[at + length] - self.total[at] * self.power[length]


def tile(pattern: Sequence[int], parts: Sequence[Sequence[int]], shortest: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling of ``pattern`` with ``parts``: (place in pattern, part, place in part, length) of each tile.

    The longest common run of unmarked words is marked, again and again, until
    none of ``shortest`` words is left; ties go to the earliest places. The Karp-Rabin hashes of all unmarked runs of a length
    are compared at once, the greatest length that has a match is found by
    halving (a longer match holds a shorter one), and all tiles of that length
    are marked in one pass, so each round is linear in the words and there is one for each length that occurs.
    """
    to_array = lambda x: np.array(x, dtype=np.int64).view(np.uint64) if len(x) else np.zeros(0, np.uint64)
    sizes = [len(p) for p in parts]
    longest = min(len(pattern), max(sizes, default=0))
    if longest < shortest:
        return []
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, _BASE))), dtype=np.uint64)
    own, text = _Rolled(to_array(pattern), power), _Rolled(np.concatenate([to_array(p) for p in parts]), power)
    part = np.repeat(np.arange(len(parts)), sizes)
    part_at = np.concatenate(([0], np.cumsum(sizes)))
    tiles: list[tuple[int, int, int, int]] = []

    def matches(length: int) -> bool:
        return bool(np.isin(own.runs(length)[1], text.runs(length, part)[1]).any())

    while True:
        low, high = shortest - 1, longest  # the greatest length in (low, high] with a match, or low
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if matches(mid) else (low, mid - 1)
        if low < shortest:
            return tiles
        longest = low
        at, hashes = own.runs(longest)
        places, found = text.runs(longest, part)
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        begin, end = np.searchsorted(found, hashes), np.searchsorted(found, hashes, "right")
        next_free: dict[int, int] = {}  # of equal runs, the first that may still be free
        marked_any = False
        for i, a, b in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True):
            if a == b or own.marked[i : i + longest].any():
                continue
            k = next_free.get(a, a)
            while k < b:
                j = int(places[k])
                if not text.marked[j : j + longest].any():
                    break
                k += 1
            next_free[a] = k
            if k < b and np.array_equal(own.words[i : i + longest], text.words[j : j + longest]):
                own.marked[i : i + longest] = text.marked[j : j + longest] = True
                tiles.append((i, int(part[j]), int(j - part_at[part[j]]), longest))
                marked_any = True
        if not marked_any:  # equal hashes of different words only
            longest -= 1


def _tiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = sorted(row["runs"], key=lambda p: p["at"])
                tiles = tile(row["words"], [p["words"] for p in parts], n)
                spans = sorted((parts[k]["at"] + j, parts[k]["at"] + j + length) for _, k, j, length in tiles)
                covered = sum(t[3] for t in tiles)
                out.append({"covered": covered, "item_words": len(row["words"]), "spans": [{"begin": a, "end": b} for a, b in spans]})
            tiled = pa.RecordBatch.from_pylist(out, _TILED)
            keys = ["id", "row", "item_id"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *tiled.columns], [*keys, *_TILED.names])

    return run


_TILED = pa.schema([("covered", pa.int64()), ("item_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def contaminated_rows(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, row, item_id, covered, item_words, coverage, spans): as find_contamination, for every row of ``docs`` by id (null too) and ``row``, the xxhash64 of its text."""
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL")
    bench = bench.mapInArrow(_items(n), f"item_id {kinds[1]}, words array<long>, seeds array<long>, places array<long>").where("size(seeds) > 0")
    bench = materialize(bench.withColumn("variant", F.xxhash64("words")).dropDuplicates(["item_id", "variant"]), "bench-items")
    seeds = bench.select("item_id", "variant", F.size("words").alias("item_words"), F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    seeds = materialize(seeds.select("item_id", "variant", "item_words", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places")), "bench-seeds")
    # what an item shares with most others is left out of the join, as far as it can't reach the threshold alone
    held = seeds.groupBy("seed").agg(F.count("*").alias("held"))
    most = Window.partitionBy("item_id", "variant").orderBy(F.desc("held"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    needed = F.lit(threshold) * F.col("item_words")
    ranked = seeds.join(held, "seed").withColumn("upto", F.sum("places").over(most)).withColumn("left_out", F.col("upto") * n < needed)
    left_out = F.coalesce(F.sum(F.when(F.col("left_out"), F.col("places"))).over(Window.partitionBy("item_id", "variant")), F.lit(0))
    joined = materialize(ranked.withColumn("rest", left_out).where("NOT left_out").select("seed", "item_id", "variant", "item_words", "places", "rest"), "bench-joined")
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.expr("1L"), F.pmod(slot, F.lit(64)).cast("int"))
    filled = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # 2**16 rows at most
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    runs = base.mapInArrow(_runs(n, {r["at"]: r["bits"] for r in filled}), f"id {kinds[0]}, row long, at long, words array<long>, seeds array<long>")
    runs = materialize(runs, "bench-runs")
    shared = runs.select("id", "row", F.explode("seeds").alias("seed")).distinct().join(joined, "seed")
    # a tile of k words has k - n + 1 of the item's places, so places times n is at least what tiles can cover
    shared = shared.groupBy("id", "row", "item_id", "variant").agg(F.sum("places").alias("places"), F.first("item_words").alias("item_words"), F.first("rest").alias("rest"))
    shared = shared.where((F.col("places") + F.col("rest")) * n >= needed).select("id", "row", "item_id", "variant")
    same = lambda left, right: left["id"].eqNullSafe(right["id"]) & (left["row"] == right["row"])
    met = shared.select("id", "row").distinct()
    parts = runs.join(met, same(runs, met), "left_semi").groupBy("id", "row").agg(F.collect_set(F.struct("at", "words")).alias("runs"))
    tiled = shared.join(parts.select(F.col("id").alias("id_"), F.col("row").alias("row_"), "runs"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_")))
    tiled = tiled.join(bench.select("item_id", "variant", "words"), ["item_id", "variant"]).select("id", "row", "item_id", "words", "runs")
    tiled = tiled.mapInArrow(_tiles(n), f"id {kinds[0]}, row long, item_id {kinds[1]}, covered long, item_words long, spans array<struct<begin:long,end:long>>")
    tiled = tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= threshold)
    return _best(tiled, "id", "row", "item_id")


def _best(tiled: DataFrame, *keys: str) -> DataFrame:
    """The row with the greatest coverage of each key; of equals that with more words, then the earliest spans."""
    rest: list[Column] = [F.col(c) for c in ("covered", "item_words", "coverage", "spans")]
    order = F.struct((-F.col("coverage")).alias("c"), (-F.col("item_words")).alias("w"), "spans")
    return tiled.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def find_contamination(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_words, coverage, spans) of documents that hold a test item.

    Seeds are the runs of ``n`` words of the items. A document is read once:
    words are hashed, and runs of words whose seeds pass a filter of fixed size
    go on, so what moves is a few words per matching document. Seeds are joined
    by hash to give candidates (document, item) that share seeds at enough places of the item to reach
    the threshold at all; each candidate is tiled greedily and reported if its tiles of at least ``n`` words
    cover ``threshold`` of the item's words, in whatever order they stand.
    Spans are word positions in the document.

    A seed in many documents is joined row by row (the items' side is
    broadcast only if the planner measures it small); the seeds that an item has in common with most other items
    are left out of the join as far as they can't make it a candidate alone. Ids keep their type. Null ids and texts, items of fewer than ``n``
    words and rows without a word give no rows. Rows that share an id, in documents or items, are compared text by text, and the best
    coverage counts. Empty tables: no rows. Other columns are ignored.
    """
    found = contaminated_rows(docs, items, threshold=threshold, n=n, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    return _best(found.where("id IS NOT NULL"), "id", "item_id").withColumnRenamed("id", id_col)
