"""Substring dedup: compact windows of token min-hashes find near-duplicate passages, word by word comparison decides."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import chunks, hash_stretches, hash_words, mix, shingles

#: The filter of repeated signatures that every task gets has two parts of 2**FILTER_BITS bits (16 MB each), whatever the input.
FILTER_BITS = 27
#: The parts are set by bits of a signature that they do not share: these are passed over on the right.
_PARTS = (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)
#: Pairs of hash functions whose windows are joined. At similarity 0.8 one pair meets with probability 0.64, one of three with 0.95.
BANDS = 3
#: Different stretches of a signature that are searched for partners in one go; larger groups are thinned out and cut into blocks.
BLOCK = 4096
#: Rows of keys up to which they are sent to every executor, so that what they pick is picked before it is shuffled. Counted, since files are well compressed.
FEW = 1 << 20
#: Pairs of equal n-grams of two stretches that are held at once.
_SLICE = 1 << 20
#: Runs of two stretches that are chained all together; of more, those of one band of shifts after the other.
MANY_RUNS = 256
_BAND = 32
#: Bits of a packed value that hold a position; more for longer texts.
_AT_BITS = 26


def compact_windows(order: np.ndarray, centres: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ends (inclusive) of the compact window of each centre in its row's positions [begin, end).

    The window of a centre reaches to the next lower value on either side: its
    node's range in the Cartesian tree. ``centres`` (ascending) hold every position that is the least of some
    window of the length in question; the next lower value of such a position
    is again one if the range is as long, so the tree is built on them alone.
    """
    begin, end = np.broadcast_to(begin, centres.shape), np.broadcast_to(end, centres.shape)
    right = len(centres) - 1 - _next_lower(order[centres][::-1], -end[::-1])[::-1]
    return left_ends(order, centres, begin), np.where(right < len(centres), centres[np.minimum(right, len(centres) - 1)] - 1, end - 1)


def left_ends(order: np.ndarray, centres: np.ndarray, begin: np.ndarray) -> np.ndarray:
    link = _next_lower(order[centres], begin)
    return np.where(link >= 0, centres[link] + 1, begin)


def _next_lower(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier lower value of the same ``row``, or -1: the left links of Cartesian trees over all rows.

    Every link goes from a value past greater ones only, so where it ends at a greater value it can go on along
    that one's link; all links are followed at once, which doubles what they pass in each round.
    """
    first = np.searchsorted(row, row)
    link = np.arange(len(values)) - 1
    todo = np.flatnonzero(link >= first)
    todo = todo[values[link[todo]] > values[todo]]
    while len(todo):
        link[todo] = link[link[todo]]
        todo = todo[link[todo] >= first[todo]]
        todo = todo[values[link[todo]] > values[todo]]
    return np.where(link >= first, link, -1)


def _sliding_least(packed: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span, least = 1, packed
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def cells(grams: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per band: (signature, anchor, first start, last start) of the groups of ``width``-gram subsequences that share two min-hashes.

    For each hash function the compact windows give, for each centre, the
    starts of the subsequences of this length whose least gram it is; the
    windows of two functions are joined on overlapping starts. All positions
    are those of ``grams``; no subsequence crosses a row.
    """
    if len(grams) < width:
        return
    lengths = np.diff(at)
    rows = np.flatnonzero(lengths >= width)
    if not len(rows):
        return
    valid = np.zeros(len(grams) - width + 1, bool)
    for r in rows.tolist():
        valid[at[r] : at[r + 1] - width + 1] = True
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << max(_AT_BITS, len(grams).bit_length())) - 1)
    starts_all = np.flatnonzero(valid)

    def windows(seed: int) -> tuple[np.ndarray, np.ndarray]:
        """First start of each window's group, ascending, and the window's centre."""
        packed = mix(grams, 100 + seed) & ~low | place
        least = (_sliding_least(packed, width)[valid] & low).astype(np.int64)
        fresh = np.flatnonzero(np.diff(least, prepend=-1))
        centres = least[fresh]  # ascending, each once
        begin = at[np.searchsorted(at, centres, "right") - 1]
        return np.maximum(left_ends(packed, centres, begin), centres - width + 1), centres

    for band in range(BANDS):
        (first_f, centre_f), (first_g, centre_g) = windows(2 * band), windows(2 * band + 1)
        first = np.sort(np.concatenate((first_f, first_g)), kind="stable")
        first = first[np.flatnonzero(np.diff(first, prepend=-1))]
        f = centre_f[np.searchsorted(first_f, first, "right") - 1]
        g = centre_g[np.searchsorted(first_g, first, "right") - 1]
        ends = np.searchsorted(starts_all, np.append(first[1:], len(grams))) - 1
        signature = mix(grams[f] + np.uint64(3) * mix(grams[g], 7), 200 + band)
        yield signature, f, first, starts_all[ends]


def _signatures(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, end in chunks(batch.column(1)):
                grams, at = shingles(*hash_words(batch.column(1)[begin:end]), n)
                for signature, _, first, _ in cells(grams, at, width):
                    row = np.searchsorted(at, first, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(ids[begin + row])], ["signature", "id"])

    return run


#: A stretch of words under repeated signatures; for each of them its anchor, the words sent along before and after the anchor, and their hash.
_REGION = {"id": pa.int64(), "begin": pa.int64(), "words": pa.binary()} | {c: pa.list_(t) for c, t in (("signatures", pa.int64()), ("anchors", pa.int64()), ("befores", pa.int32()), ("afters", pa.int32()), ("hashes", pa.int64()))}


def _regions(n: int, width: int, margin: int, filled: np.ndarray):
    low, slots = np.uint64(63), np.uint64((1 << FILTER_BITS) - 1)

    def passes(signature: np.ndarray) -> np.ndarray:
        """Which ones both parts of the filter hold."""
        hit = np.arange(len(signature))
        for part, right in zip(filled, _PARTS, strict=True):
            slot = (signature[hit] >> np.uint64(right)) & slots
            hit = hit[(part[slot >> np.uint64(6)] >> (slot & low)) & np.uint64(1) == 1]
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, end in chunks(batch.column(1)):
                words, ptr = hash_words(batch.column(1)[begin:end])
                grams, at = shingles(words, ptr, n)
                found = []
                for signature, anchor, first, last in cells(grams, at, width):
                    hit = passes(signature)
                    found.append(np.stack([signature[hit].view(np.int64), anchor[hit], first[hit], last[hit]]))
                if not found or not sum(f.shape[1] for f in found):
                    continue
                cell = np.concatenate(found, axis=1)
                cell = cell[:, np.argsort(cell[2], kind="stable")]
                row = np.searchsorted(at, cell[2], "right") - 1
                stop = cell[3] + width + n - 1 - at[row] + ptr[row]  # past the last word of the last subsequence
                start, stop = np.maximum(ptr[row], cell[2] - at[row] + ptr[row] - margin), np.minimum(ptr[row + 1], stop + margin)
                hashes = hash_stretches(words, start, stop).view(np.int64)
                anchor = cell[1] - at[row] + ptr[row]
                before, after = (anchor - start).astype(np.int32), (stop - anchor).astype(np.int32)
                reach = np.maximum.accumulate(stop)
                cut = np.flatnonzero(np.concatenate(([True], (start[1:] > reach[:-1]) | (row[1:] != row[:-1]))))
                edges = [*cut.tolist(), len(start)]
                out: dict[str, list] = {c: [] for c in _REGION}
                for a, b in zip(edges, edges[1:], strict=False):
                    r, at_word = int(row[a]), int(start[a])
                    out["id"].append(int(ids[begin + r]))
                    out["begin"].append(at_word - int(ptr[r]))
                    out["words"].append((words[at_word : int(reach[b - 1])] >> np.uint64(48)).astype(np.uint16).tobytes())
                    for c, v in (("signatures", cell[0]), ("anchors", anchor - ptr[row]), ("befores", before), ("afters", after), ("hashes", hashes)):
                        out[c].append(v[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(v, _REGION[c]) for c, v in out.items()], list(out))

    return run


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : i + len(out)]
    return mix(out)


def _among(grams: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the n-grams are among the others."""
    if not len(others):
        return np.zeros(len(grams), bool)
    others = np.sort(others)
    return others[np.minimum(np.searchsorted(others, grams), len(others) - 1)] == grams


def shared_runs(own: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """(own begin, other begin, number of ``n``-grams) of all longest runs of equal words that hold ``n``-grams, in order of shift and place."""
    a, b = _grams(own, n), _grams(other, n)
    at = np.argsort(b, kind="stable")
    b = b[at]
    low, high = np.searchsorted(b, a), np.searchsorted(b, a, "right")
    hit = np.flatnonzero(high > low)
    ends = np.cumsum((high - low)[hit])
    shifts, firsts, sizes, begin = [], [], [], 0
    while begin < len(hit):  # in slices, for words that repeat themselves
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + _SLICE, "right")))
        part = hit[begin:end]
        count = high[part] - low[part]
        place = np.repeat(part, count)
        key = (place - at[np.arange(count.sum()) + np.repeat(low[part] - (np.cumsum(count) - count), count)] << 32) + place
        key.sort()
        cut = np.flatnonzero(np.diff(key, prepend=key[0] - 2) != 1)
        shifts.append(key[cut] >> 32)
        firsts.append(key[cut] & 0xFFFFFFFF)
        sizes.append(np.diff(cut, append=len(key)))
        begin = end
    if not shifts:
        return np.zeros((0, 3), np.int64)
    shift, first, size = (np.concatenate(x) for x in (shifts, firsts, sizes))
    order = np.lexsort((first, shift))
    shift, first, size = shift[order], first[order], size[order]
    joined = np.flatnonzero(np.concatenate(([True], (shift[1:] != shift[:-1]) | (first[1:] != first[:-1] + size[:-1]))))
    return np.stack([first[joined], first[joined] - shift[joined], np.add.reduceat(size, joined)], axis=1)


def _needed_runs(runs: np.ndarray, least: int) -> np.ndarray:
    """Without the runs whose own side lies within that of runs of ``least`` n-grams or more, as few of the latter as cover the same."""
    solid = np.flatnonzero(runs[:, 2] >= least)
    if not len(solid):
        return _apart(runs)
    solid = solid[np.lexsort((-runs[solid, 2], runs[solid, 0]))]
    chosen: list[int] = []
    reach, best, best_end = -1, -1, -1
    for k, begin, end in zip(solid.tolist(), runs[solid, 0].tolist(), (runs[solid, 0] + runs[solid, 2]).tolist(), strict=True):
        if best >= 0 and begin > reach:  # what reaches farthest of those that begin within the cover
            chosen.append(best)
            reach, best = best_end, -1
        if end > max(reach, best_end if best >= 0 else -1):
            if begin > reach:
                chosen.append(k)
                reach = end
            else:
                best, best_end = k, end
    if best >= 0:
        chosen.append(best)
    cover = runs[sorted(chosen, key=lambda k: runs[k, 0])]
    begin, end = cover[:, 0], cover[:, 0] + cover[:, 2]
    fresh = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    begin, end = begin[fresh], np.append(end[fresh[1:] - 1], end[-1:])
    at = np.searchsorted(begin, runs[:, 0], "right") - 1
    within = (at >= 0) & (runs[:, 0] + runs[:, 2] <= end[np.maximum(at, 0)])
    within[chosen] = False
    return _apart(runs[~within])


def _apart(runs: np.ndarray) -> np.ndarray:
    """Without the runs that lie, on either side, within runs of four times their size: a chain through one would leave out those."""
    if len(runs) < 8:
        return runs
    order = np.argsort(runs[:, 2], kind="stable")
    far = np.ones(len(runs), bool)
    for side in (0, 1):
        begin, end = runs[:, side], runs[:, side] + runs[:, 2]
        widest = np.zeros(int(end.max()), np.int64)
        for a, b, size in zip(begin[order].tolist(), end[order].tolist(), runs[order, 2].tolist(), strict=True):
            widest[a:b] = size
        far &= np.minimum(np.minimum(widest[begin], widest[end - 1]), widest[(begin + end) // 2]) >= 4 * runs[:, 2]
    return runs[~far]



def matching_passages(own: np.ndarray, other: np.ndarray, n: int, least: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, other begin, other end, similarity) of passages of at least ``least`` words of ``own`` that ``other`` has nearly alike.

    Words are compared along every shift at which an ``n``-gram is shared. Runs of at least ``n`` equal words
    are chained in order over gaps of any length; a chain counts if its n-grams have Jaccard similarity
    ``threshold`` with those of the other side's stretch. Chains whose own words lie within those of a longer one
    that counts are left out, and so are short runs whose own words lie within a run that is a passage by itself, or
    that lie on either side within runs of four times their size.
    A passage begins and ends with equal words. Of texts that share very many runs (which repeat themselves), the
    bands of shifts are gone through until all own words that a passage may hold are covered, with gaps of ``2 * _BAND`` n-grams at most.

    With S shared of A and B n-grams, S / (A + B - S) >= t is S (1 - t) - t (A - S) - t (B - S) >= 0: a sum
    over runs and gaps, so the best chain from each run to each other one is found by going through the runs once.
    """
    runs = shared_runs(own, other, n)
    ends = len(own) - n + 1, len(other) - n + 1
    if len(runs) <= MANY_RUNS:
        return _outermost(_chains(_needed_runs(runs, least - n + 1), ends, n, least, threshold))
    covered, found = np.zeros(ends[0], bool), []
    for begin, end, held in _dense_bands(runs, least - n + 1, threshold):
        if not all(covered[a:b].all() for a, b in zip(begin.tolist(), end.tolist(), strict=True)):
            for passage in _chains(_needed_runs(held, least - n + 1), ends, n, least, threshold, most_gap=2 * _BAND):
                covered[passage[0] : passage[1] - n + 1] = True
                found.append(passage)
    return _outermost(found)


def _outermost(found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Without the passages whose own words lie within a longer one."""
    out: list[tuple[int, int, int, int, float]] = []
    for p in sorted(found, key=lambda p: (p[0] - p[1] + p[2] - p[3], p[0], p[2])):
        if not any(q[0] <= p[0] and p[1] <= q[1] for q in out):
            out.append(p)
    return sorted(out)


def _shared_places(begin: np.ndarray, size: np.ndarray) -> tuple[int, np.ndarray]:
    """The first place of the runs, and which places from there to the last one lie in a run."""
    first, n = int(begin.min()), int((begin + size).max() - begin.min())
    edge = np.bincount(begin - first, minlength=n + 1) - np.bincount(begin + size - first, minlength=n + 1)
    return first, np.cumsum(edge)[:-1] > 0


def _dense_bands(runs: np.ndarray, width: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches (begin, end) of the own side where some passage may lie whose runs have shifts within a band, and those runs; the band with most first.

    Half of a passage is one too, unless it gets too short: a passage of many n-grams holds one of fewer than about
    twice ``width``, whose gaps, a quarter of what is shared at most, keep its shifts within a band. Bands overlap by half. In a
    passage the share ``threshold`` of the own side's n-grams is shared, so the sum of 1 - t for each in a run of the band and -t for each other is 0 or more.
    """
    key = (runs[:, 0] - runs[:, 1]) // _BAND
    order = np.argsort(key, kind="stable")
    runs, key = runs[order], key[order]
    out = []
    for k in np.unique(np.concatenate((key, key - 1))).tolist():
        held = runs[np.searchsorted(key, k) : np.searchsorted(key, k + 1, "right")]
        (first, shared), (_, of_other) = (_shared_places(held[:, side], held[:, 2]) for side in (0, 1))
        if most_gain(shared, width, threshold) + most_gain(of_other, width, threshold) < -1e-9:
            continue
        total = np.concatenate(([0.0], np.cumsum(np.where(shared, 1 - threshold, -threshold))))
        most = np.maximum.accumulate(total[::-1])  # of what follows, by distance from the end
        farthest = len(total) - 1 - np.searchsorted(most, total - 1e-9)
        begin = np.flatnonzero(farthest - np.arange(len(total)) >= width)
        if not len(begin):
            continue
        end = np.maximum.accumulate(farthest[begin])
        cut = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
        begin, end = begin[cut] + first, end[np.append(cut[1:] - 1, len(begin) - 1)] + first
        at = np.searchsorted(begin, held[:, 0] + held[:, 2] - 1, "right") - 1
        out.append((begin, end, held[(at >= 0) & (held[:, 0] < end[np.maximum(at, 0)])]))
    return sorted(out, key=lambda x: -int((x[1] - x[0]).sum()))


def _outer(runs: np.ndarray) -> np.ndarray:
    """Without the runs that lie within an earlier one on both sides; longer ones come first."""
    begin, end, keep = runs[:, :2], runs[:, :2] + runs[:, 2:], []
    for k in range(0, len(runs), 256):  # in blocks, for very many runs
        part, upto = slice(k, k + 256), min(k + 256, len(runs))
        within = np.tri(upto - k, upto, k - 1, dtype=bool)
        for side in (0, 1):
            within &= (begin[None, :upto, side] <= begin[part, None, side]) & (end[part, None, side] <= end[None, :upto, side])
        keep.append(~within.any(axis=1))
    return runs[np.concatenate(keep)]


def _chains(runs: np.ndarray, ends: tuple[int, int], n: int, least: int, threshold: float, most_gap: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """From each run the chain that reaches farthest, of those that are passages; with ``most_gap`` no gap is wider, and starts that a passage covers are passed over."""
    if not len(runs):
        return []
    kept = sorted(map(tuple, _outer(runs[np.lexsort((runs[:, 0], np.abs(runs[:, 0] - runs[:, 1]), -runs[:, 2]))]).tolist()))
    gain, (own_end, other_end), widest = 1 - threshold, ends, max(k[2] for k in kept)
    into: list[list[tuple[int, float]]] = []  # per run, the runs that may come before it in a chain (the last first), and what going on to it adds
    low, before = 0, []
    for e, (a, b, size) in enumerate(kept):
        links, between = [], []
        while most_gap is not None and kept[low][0] + widest + most_gap < a:
            low += 1
        beyond = min(own_end - a, other_end - b)
        for _, p in before:  # from the farthest on
            if p < low:
                continue
            c, d, long_ = kept[p]
            gaps = a + b - c - d - 2 * long_
            # too far for all that both sides of the gap could hold
            if threshold * gaps > gain * ((c if c < d else d) + long_ + beyond) or (most_gap is not None and gaps > most_gap):
                continue
            over = max(0, c + long_ - a, d + long_ - b)  # n-grams that the run before has taken
            # a run that fits between two others makes the chain through it better than the one past it
            if over < size and c < a and d < b and not any(c + long_ <= x and d + long_ <= y for x, y in between):
                links.append((p, gain * (size - over) - threshold * (gaps + 2 * over)))
                if not over and len(between) < 8:
                    between.append((c, d))
        into.append(sorted(links, reverse=True))
        insort(before, (-a - b, e))
    spare = [gain * min(own_end - a - size, other_end - b - size) for a, b, size in kept]
    found, reached, unreached = [], -1, -np.inf
    for s, (a, b, size) in enumerate(kept):
        if most_gap is not None and a < reached - 2 * least:
            continue
        total = [unreached] * len(kept)
        total[s] = gain * size
        farthest, newest = None, s
        for e in range(s, len(kept)):
            if e > s:
                if most_gap is not None and kept[e][0] > kept[newest][0] + widest + most_gap:
                    break
                best = unreached
                for p, more in into[e]:
                    if p < s:
                        break
                    if total[p] + more > best:
                        best = total[p] + more
                if best + spare[e] < -1e-9:
                    continue  # not reached, or too low for what is left to make up for
                total[e], newest = best, e
            c, d = kept[e][0] + kept[e][2], kept[e][1] + kept[e][2]
            if total[e] >= -1e-9 and min(c - a, d - b) + n - 1 >= least and (farthest is None or (c, d) > farthest[:2]):
                farthest = (c, d, total[e])
        if farthest:
            c, d, sum_ = farthest
            both = c - a + d - b
            shared = round((sum_ + threshold * both) / (1 + threshold))
            found.append((a, c + n - 1, b, d + n - 1, shared / (both - shared)))
            reached = max(reached, c)
    return found


def most_gain(shared: np.ndarray, width: int, threshold: float, x: int | None = None) -> float:
    """A bound of what one side's n-grams (shared with the other or not) add to a passage of ``width`` of them or more, one that holds the ``x``-th if given.

    A passage's sum (see matching_passages) is at most (1 - t) / 2 for each shared n-gram of either side, and -t for
    each other one: no passage if the bounds of both sides are together below 0.
    """
    if len(shared) < width:
        return -np.inf
    total = np.concatenate(([0.0], np.cumsum(np.where(shared, (1 - threshold) / 2, -threshold))))
    most = np.maximum.accumulate(total[::-1])[::-1]
    first = np.arange(len(total) - width if x is None else min(x + 1, len(total) - width))
    last = first + width if x is None else np.maximum(x + 1, first + width)
    return float((most[last] - total[first]).max(initial=-np.inf))


def most_gains(shared: np.ndarray, width: int, threshold: float, x: np.ndarray) -> np.ndarray:
    """most_gain of each row, with its own ``x``; rows may be filled up at their ends with n-grams that are not shared."""
    room = shared.shape[1] - width + 1
    if room <= 0:
        return np.full(len(shared), -np.inf)
    total = np.zeros((len(shared), shared.shape[1] + 1))
    np.cumsum(np.where(shared, (1 - threshold) / 2, -threshold), axis=1, out=total[:, 1:])
    most = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1]
    first, x = np.arange(room), x[:, None]
    gains = np.take_along_axis(most, np.maximum(x + 1, first + width), axis=1) - total[:, :room]
    return np.where(first <= x, gains, -np.inf).max(axis=1)


def _joined(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


_FOUND = pa.schema([(c, pa.int64()) for c in ("doc_id", "begin", "end", "source_doc_id", "source_begin", "source_end")] + [("similarity", pa.float64())])


def _verify(n: int, least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
            out: dict[str, list] = {f.name: [] for f in _FOUND}
            for row in batch.to_pylist():
                own, other = np.frombuffer(row["words"], np.uint16), np.frombuffer(row["source_words"], np.uint16)
                if np.array_equal(own, other):
                    for k, v in zip(out, (row["id"], row["begin"], row["begin"] + len(own), row["source_id"], row["source_begin"], row["source_begin"] + len(own), 1.0), strict=True):
                        out[k].append(v)
                    continue
                x, y = _grams(own, n), _grams(other, n)
                if most_gain(_among(x, y), least - n + 1, threshold) + most_gain(_among(y, x), least - n + 1, threshold) < -1e-9:
                    continue
                for a, b, c, d, similarity in matching_passages(own, other, n, least, threshold):
                    for k, v in zip(out, (row["id"], row["begin"] + a, row["begin"] + b, row["source_id"], row["source_begin"] + c, row["source_begin"] + d, similarity), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, _FOUND)

    return run


def _least_shared(least: int, threshold: float, n: int) -> int:
    """N-grams that any passage shares with its source."""
    return int(np.ceil(2 * (least - n + 1) * threshold / (1 + threshold) - 1e-9))


def _gram_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_grams(np.frombuffer(w.as_buffer(), np.uint16), n)) for w in batch.column(2)]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["signature", "hash", "gram"])

    return run


def _partners(n: int, least: int, threshold: float):
    width, need = least - n + 1, _least_shared(least, threshold, n)

    def run(table: pa.Table) -> pa.Table:
        """For each stretch that asks, that of an earlier document under the same signature which holds a passage around its anchor and shares most n-grams with it."""
        asks, holds, ids, signature = (table[c].to_numpy() for c in ("asks", "holds", "id", "signature"))
        raw = table["words"].combine_chunks()
        spans = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] // 2
        words = np.frombuffer(raw.buffers()[2], np.uint16)[: spans[-1]]
        row = np.repeat(np.arange(len(raw)), np.diff(spans))
        inside = np.flatnonzero(np.arange(spans[0], spans[-1]) + n <= spans[row + 1])  # n-grams that end in their row
        grams = _grams(words[spans[0] :], n)[inside] if len(inside) else np.zeros(0, np.uint64)
        row = row[inside]
        # an n-gram counts per signature: all signatures of the table are gone through at once
        key = mix(grams ^ mix(signature.view(np.uint64), 9)[row], 4)
        slot = (key >> np.uint64(42)).astype(np.int64)
        several = np.bincount(slot, minlength=1)[slot] > 1  # the others occur once, so they need no code of their own
        flat, codes = np.unique(key[several], return_inverse=True)
        code = np.full(len(key), len(flat))
        code[several] = codes
        at_row = np.searchsorted(row, np.arange(len(raw) + 1))
        times = np.bincount(code, minlength=len(flat) + 1)
        times[-1] = 0
        twice = np.flatnonzero(times[code] > 1)
        pair = np.sort(row[twice] * (len(flat) + 1) + code[twice])
        pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
        owner, member = pair // (len(flat) + 1), pair % (len(flat) + 1)
        of_row = np.searchsorted(owner, np.arange(len(raw) + 1))
        alive = np.ones(len(raw), bool)
        while True:  # stretches with too few n-grams that others of the signature have can't hold a passage of them
            held = np.bincount(member[alive[owner]], minlength=len(flat) + 1)
            still = alive & (np.bincount(owner, weights=held[member] > 1, minlength=len(raw)) >= need)
            if (still == alive).all():
                break
            alive = still
        kept = (alive & holds)[owner] & (held[member] > 1)
        order = np.argsort(member[kept], kind="stable")
        holders, first = owner[kept][order], np.searchsorted(member[kept][order], np.arange(len(flat) + 2))
        out: dict[str, list] = {c: [] for c in ("id", "begin", "anchor", "source_id", "source_begin", "source_anchor")}
        place = {c: table[c].to_numpy() for c in ("id", "begin", "anchor")}
        before = table["before"].to_numpy()
        mark = np.zeros(len(flat) + 1, bool)

        def gain(i: int, j: int) -> float:
            other = member[of_row[j] : of_row[j + 1]]
            mark[other] = True
            shared = mark[code[at_row[i] : at_row[i + 1]]]
            mark[other] = False
            return most_gain(shared, width, threshold, int(before[i]))

        def possible(m: int, others: np.ndarray) -> Iterator[int]:
            """The others with which a passage can be, in their order: some one by one, since one of the first often has it, the rest in chunks."""
            for k in others[:4].tolist():
                if gain(m, k) + gain(k, m) >= -1e-9:
                    yield k
            own, codes = member[of_row[m] : of_row[m + 1]], code[at_row[m] : at_row[m + 1]]
            place_of = np.searchsorted(own, codes)
            place_of[own[np.minimum(place_of, len(own) - 1)] != codes] = len(own)
            for begin in range(4, len(others), 64):
                part = others[begin : begin + 64]
                sizes = of_row[part + 1] - of_row[part]
                theirs = member[_joined(of_row[part], sizes)]
                at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                has = np.zeros((len(part), len(own) + 1), bool)
                same = own[at] == theirs
                has[np.repeat(np.arange(len(part)), sizes)[same], at[same]] = True
                mark[own] = True
                lengths = at_row[part + 1] - at_row[part]
                of_others = np.zeros((len(part), int(lengths.max())), bool)
                of_others[np.arange(of_others.shape[1]) < lengths[:, None]] = mark[code[_joined(at_row[part], lengths)]]
                mark[own] = False
                gains = most_gains(has[:, place_of], width, threshold, np.full(len(part), before[m])) + most_gains(of_others, width, threshold, before[part])
                yield from part[(gains >= -1e-9) & (lengths >= width)].tolist()

        for m in np.flatnonzero(asks & alive).tolist():
            own = member[of_row[m] : of_row[m + 1]]
            count = first[own + 1] - first[own]
            shared = np.bincount(holders[_joined(first[own], count)], minlength=len(raw))
            others = np.flatnonzero(shared >= need)
            others = others[ids[others] < ids[m]]
            x = int(before[m])
            for k in possible(m, others[np.lexsort((ids[others], -shared[others]))]):
                if any(p[0] <= x and x + n <= p[1] for p in matching_passages(words[spans[m] : spans[m + 1]], words[spans[k] : spans[k + 1]], n, least, threshold)):
                    for c, i in (("", m), ("source_", k)):
                        for name in place:
                            out[c + name].append(int(place[name][i]))
                    break
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def few(keys: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A table just written, marked for broadcast if it (or the ``rows`` that it gathers) has at most ``FEW`` rows; a larger one is left to the planner, which sorts and merges."""
    return F.broadcast(keys) if (keys if rows is None else rows).count() <= FEW else keys


def repeated_passages(docs: DataFrame, *, min_words: int = 50, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end, source_doc_id, source_begin, source_end, similarity): passages that a document shares with an earlier one.

    A passage has at least ``min_words`` words, and its word ``n``-grams have Jaccard similarity
    ``threshold`` or more with the source's. Positions count words; the source is the least id that
    shares the signature and, where that one does not hold the passage, one that does of the others before the
    document (with equal words around the anchor the least, else that which shares most n-grams): not each pair of a group is reported, but each member that holds a passage of an earlier one. Copies of documents are passages too.

    Each subsequence of ``min_words`` words has, per band, a signature of two min-hashes over
    its n-grams; compact windows group the subsequences that share it, about four per
    ``min_words`` words and band. Signatures are aggregated over all documents (map-side first); those of two
    documents or more set a filter of fixed size, and a second reading sends on
    only the stretches of words under such signatures. Members are joined to
    their group's first by signature, stretches are compared word by word. Members that no passage found so far
    covers are compared with all earlier ones of the signature that share n-grams enough, those that share most first, until
    one holds the passage. For this, equal stretches around an anchor are one, a signature of more than ``BLOCK`` different ones is searched in pairs of blocks (of those that ask and those that
    hold), and one where more than that ask first loses those whose n-grams are too rare in it to make a passage, by two aggregations. Texts are never shuffled; a frequent passage is a join that the planner splits.

    Null ids and null, empty or shorter texts give no rows. Rows that share an
    id are taken as one document. Passages repeated within one document only are
    not reported. Words are compared by 16 bits of their
    hash, but only runs of ``n`` or more equal ones count. Other columns are ignored.
    """
    width = min_words - n + 1
    # words sent along on either side: a run too short to be found alone, past the longest gap that a chain can bridge
    margin = min_words + int(2 * width * (1 - threshold) / threshold)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    seen = base.mapInArrow(_signatures(n, width), "signature long, id long").groupBy("signature").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    slots = [F.shiftrightunsigned("signature", right).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + F.lit(part << FILTER_BITS) for part, right in enumerate(_PARTS)]
    bit = F.call_function("shiftleft", F.expr("1L"), F.pmod("slot", F.lit(64)).cast("int"))
    rows = seen.select(F.explode(F.array(*slots)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**22 rows at most
    filled = np.zeros(len(_PARTS) << (FILTER_BITS - 6), np.uint64)
    filled[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    filled = filled.reshape(len(_PARTS), -1)
    regions = base.mapInArrow(_regions(n, width, margin, filled), "id long, begin long, words binary, signatures array<long>, anchors array<long>, befores array<int>, afters array<int>, hashes array<long>")
    regions = materialize(regions, "passage-regions")
    each = {"signatures": "signature", "anchors": "anchor", "befores": "before", "afters": "after", "hashes": "hash"}
    named = [F.col(f"c.{c}").alias(k) for c, k in each.items()]
    cell = regions.select("id", "begin", F.explode(F.arrays_zip(*each)).alias("c")).select("id", "begin", *named)
    firsts = cell.groupBy("signature").agg(F.min(F.struct("id", "begin", "anchor")).alias("first"), F.max("id").alias("hi")).where("first.id < hi")
    firsts = firsts.select("signature", F.col("first.id").alias("source_id"), F.col("first.begin").alias("source_begin"), F.col("first.anchor").alias("source_anchor"))
    firsts = materialize(firsts, "passages-firsts")  # so that a hot signature's members are split in the join
    pairs = cell.join(firsts, "signature").where("id <> source_id")

    def text_of(*keys: DataFrame) -> DataFrame:
        """The words of those stretches: no others are shuffled while the keys are few enough to be sent to every executor."""
        wanted = reduce(DataFrame.union, [k.select(F.col(k.columns[0]).alias("id"), F.col(k.columns[1]).alias("begin")) for k in keys]).distinct()
        return regions.join(few(materialize(wanted, "passages-wanted")), ["id", "begin"], "left_semi").groupBy("id", "begin").agg(F.first("words").alias("words"))

    def cut(df: DataFrame, side: str) -> DataFrame:
        """Only the words around the anchors: all subsequences with their signatures lie there."""
        begin, lo, hi = (F.col(f"{side}begin"), F.col(f"lo_{side}anchor"), F.col(f"hi_{side}anchor"))
        first = F.greatest(begin, lo - min_words - margin)
        words = F.substring(F.col(f"{side}words"), (2 * (first - begin) + 1).cast("int"), (2 * (hi + min_words + margin - first)).cast("int"))
        return df.withColumns({f"{side}words": words, f"{side}begin": first})

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        ends = [f(c).alias(f"{k}_{c}") for c in ("anchor", "source_anchor") for k, f in (("lo", F.min), ("hi", F.max))]
        pairs = materialize(pairs.groupBy("id", "begin", "source_id", "source_begin").agg(*ends), f"{name}-pairs")
        text = text_of(pairs.select("id", "begin"), pairs.select("source_id", "source_begin"))
        source = text.select(F.col("id").alias("source_id"), F.col("begin").alias("source_begin"), F.col("words").alias("source_words"))
        checked = cut(cut(pairs.join(text, ["id", "begin"]), "").join(source, ["source_id", "source_begin"]), "source_")
        checked = checked.select("id", "begin", "words", "source_id", "source_begin", "source_words")
        found = checked.mapInArrow(_verify(n, min_words, threshold), ", ".join(f"{f.name} {'double' if f.name == 'similarity' else 'long'}" for f in _FOUND))
        return materialize(found, name)

    found = compared(pairs, "passages-of-firsts")
    # signatures around which no passage covers some member yet, and the different stretches of words that they have
    held = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct(F.col("begin").alias("a"), F.col("end").alias("b"))).alias("held"))
    left = regions.select("id", "begin", F.arrays_zip("signatures", "anchors", "hashes").alias("c")).join(few(materialize(held, "passages-held"), found), "id", "left")
    covered = lambda c: F.exists("held", lambda h: (h["a"] <= c["anchors"]) & (c["anchors"] + n <= h["b"]))
    left = left.select("id", "begin", F.explode(F.filter("c", lambda c: ~F.coalesce(covered(c), F.lit(False)))).alias("c")).select("id", "begin", *[F.col(f"c.{c}").alias(each[c]) for c in ("signatures", "anchors", "hashes")])
    left = materialize(left.join(firsts.select("signature", "source_id"), "signature").where("id <> source_id").select("signature", "id", "begin", "anchor", "hash"), "passages-open")
    asked = materialize(left.select("signature").distinct(), "passages-asked")
    least_of = F.min(F.struct("id", "begin", "anchor", "before", "after")).alias("r")
    contents = materialize(cell.join(few(asked), "signature", "left_semi").groupBy("signature", "hash").agg(least_of).select("signature", "hash", "r.*"), "passages-contents")
    # equal stretches: the least holder is a partner; it alone goes on to ask the other stretches
    ends = contents.select("signature", "hash", F.col("id").alias("source_id"), F.col("begin").alias("source_begin"), F.col("anchor").alias("source_anchor"))
    alike = left.join(ends, ["signature", "hash"]).where("source_id < id").select("id", "begin", "anchor", "source_id", "source_begin", "source_anchor")
    asking = left.select("signature", "hash", F.col("id").alias("asking_id"))
    asking = contents.join(asking, ["signature", "hash"]).where("id = asking_id").select("signature", "hash").distinct()
    members = contents.join(asking.withColumn("asks", F.lit(True)), ["signature", "hash"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))

    def counted(df: DataFrame) -> DataFrame:
        return materialize(df.groupBy("signature").agg(F.count("*").alias("size"), F.count_if("asks").alias("asking")).where("size > 1 AND asking > 0"), "passages-sizes")

    # the words come last, once, to the groups that are searched
    members = materialize(members, "passages-members")
    sizes = counted(members)
    members = members.join(sizes, "signature")
    cut_at = (2 * (F.col("anchor") - F.col("before") - F.col("begin")) + 1).cast("int")
    words = F.substring("words", cut_at, 2 * (F.col("before") + F.col("after"))).alias("words")
    members = members.join(text_of(members.select("id", "begin")), ["id", "begin"]).select("signature", "hash", "id", "begin", "anchor", "before", "asks", "size", "asking", words)
    members = materialize(members, "passages-worded")
    # groups that ask and hold very much lose the stretches that share too few n-grams with all others together: a line that very many documents have leaves none
    large = members.where(F.col("asking") > BLOCK)
    grams = materialize(large.select("signature", "hash", "words").mapInArrow(_gram_rows(n), "signature long, hash long, gram long"), "passages-grams")
    common = materialize(grams.groupBy("signature", "gram").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "passages-common")
    rich = grams.join(common, ["signature", "gram"]).groupBy("signature", "hash").count().where(F.col("count") >= _least_shared(min_words, threshold, n))
    rich = materialize(rich.select("signature", "hash"), "passages-rich")
    large = large.join(rich, ["signature", "hash"], "left_semi")
    wide = members.where((F.col("size") > BLOCK) & (F.col("asking") <= BLOCK))
    large = materialize(large.unionByName(wide).drop("size", "asking"), "passages-large")
    small = members.where(F.col("size") <= BLOCK)
    columns = ["pack", "signature", "ask", "block", "asks", "holds", "id", "begin", "anchor", "before", "words"]
    # small groups go through together, about BLOCK stretches at a time
    packs = max(1, (sizes.where(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 0) // BLOCK)
    pack = F.pmod(F.xxhash64("signature"), F.lit(packs))
    small = small.withColumns({"pack": pack, "ask": F.lit(0), "block": F.lit(0), "holds": F.lit(True)}).select(columns)
    blocks = counted(large).select("signature", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("asking"))
    large = large.join(blocks, "signature").withColumns({"at": F.xxhash64("hash"), "pack": F.col("signature")})
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    holding = large.withColumns({"block": F.pmod("at", F.col("blocks")).cast("int"), "asks": F.lit(False), "holds": F.lit(True)}).withColumn("ask", every("asking")).select(columns)
    asking = large.where("asks").withColumns({"ask": F.pmod("at", F.col("asking")).cast("int"), "holds": F.lit(False)}).withColumn("block", every("blocks")).select(columns)
    sides = small.union(holding).union(asking)
    partners = sides.groupBy("pack", "ask", "block").applyInArrow(_partners(n, min_words, threshold), "id long, begin long, anchor long, source_id long, source_begin long, source_anchor long")
    partners = materialize(partners.union(alike), "passages-partners")
    return found.unionByName(compared(partners, "passages-of-others")).distinct()
