"""Brute-force checks of the corpus operators on small fixtures."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import common, decontaminate, fingerprint, jaccard_join, language_id, line_dedup, mixing, quality, substring_dedup, tokens, url_filter, warc, zip_archive
from codeloom.operators import components, ranges

DOC = "doc_id long, text string, lang string, source string"


def words(n, seed, of=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(of)}x" for _ in range(n)]


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOC).repartition(3)


def grams(text, n=5):
    ws = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


# words and shingles


def test_words_and_shingles_follow_rows():
    text = pa.array(["Hello the World", "hello, THE x", None, "", "É é", "a", "!!", "x" * 5000])
    w, ptr = tokens.hash_words(text)
    assert ptr.tolist() == [0, 3, 6, 6, 6, 8, 9, 9, 10] and w[0] == w[3] and w[1] == w[4] and w[6] == w[7]
    s, at = tokens.shingles(w, ptr, 2)
    assert at.tolist() == [0, 2, 4, 4, 4, 5, 6, 6, 7] and s[0] == s[2]
    sliced, _ = tokens.hash_words(text[1:2])
    assert sliced.tolist() == w[3:6].tolist()


# 2: lines


def lines_by_hand(rows, least=5):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(strip(line)) >= 40:
                held[strip(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held[strip(x)]) >= least and i != max(held[strip(x)]) if strip(x) in held else False for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    shared, upper, accent = "the same line in many documents, of forty and more", "THE SAME LINE IN MANY DOCUMENTS, OF FORTY AND MORE  ", "É" * 45
    rows = [(i, f"own {i}\n{shared if i % 2 else upper}\n\n{accent if i < 4 else accent.lower()}\n{shared}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, shared), (3, shared), (23, "z" * 39), (24, "x\n" * 3000 + shared), (3, shared)]
    df = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id long, text string, n_lines string, drops int").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "drops", "n_lines_1", "n_dropped"]
    assert sorted([(r.doc_id, r.text, r.n_lines_1, r.n_dropped) for r in got.collect()], key=str) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", F.lit(1).alias("text_hash_r"), F.lit(2).alias("dropped_hash"), F.lit(3).alias("Text_Hash_1"), F.lit(4).alias("dropped_id"), F.lit(5).alias("lines"))
    again = line_dedup.dedup_lines(clash)
    assert again.columns[:7] == clash.columns and sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in again.collect()], key=str) == lines_by_hand(rows)


# ranges


@pytest.mark.parametrize("most", [512, 2])
def test_range_buckets_and_running_totals(spark, monkeypatch, most):
    monkeypatch.setattr(ranges, "_MOST_CASES", most)
    bounds = [(3, "b"), (3, "d"), (7, "")]
    df = spark.createDataFrame([(i, c) for i in range(10) for c in "abcde"], "i int, c string")
    for r in df.select("i", "c", common.range_bucket([F.col("i"), F.col("c")], bounds).alias("b")).collect():
        assert r.b == sum(b <= (r.i, r.c) for b in bounds)
    rows = [(i % 7, i, i * 3 % 11) for i in range(300)]
    got = common.global_prefix(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), ["k", "i"], "v", "upto", 9).collect()
    total = 0
    for r in sorted(got):
        total += r.v
        assert r.upto == total


# 3: urls


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("", "/", "block"), (None, None, "block")]
    urls = ["http://a.example.net/en/x1", "https://b.example.net/en/", "https://B.EXAMPLE.net/fr/", "http://net/", "http://internet/", "http://x.org/fr/a?q", "http://x.org/fr", "ftp://example.com/de/?x://y", "nothing", None, "", "://", "http://example.com#/de/", "http://xexample.com/de/", "http://example.com:80/de/"]
    urls += [f"http://hot.example.net/en/{i}" for i in range(60)]
    rng = random.Random(1)
    urls += ["http://" + ".".join(rng.choice(["a", "b", "net", "org", "example"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/en/", "/fr/1", "/en/x"]) for _ in range(200)]
    pages = spark.createDataFrame([(i if i != 7 else None, u, 0) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path_prefix string, action string"), n_ranges=5).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        want = (max(fits)[2], max(fits)[3]) if fits else (None, "allow")
        assert got[(i if i != 7 else None, host, path)] == want, u
    assert url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path_prefix string, action string").limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path_prefix string, action string")).count() == 0


# 5: mixing


def test_mixing_targets_and_cut(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(500, None, "a"), (501, "", "z"), (None, "x y", "a"), (7, "p q r", "b")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, taken int").repartition(3)
    got = mixing.mix_sources(df, n_ranges=4).collect()
    assert sorted([(r.doc_id, r.size, r.source) for r in got], key=str) == sorted([(i, len((t or "").split()), s) for i, t, s in rows], key=str)
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in fixed)) / sum(weight[s] for s in order if s not in fixed)
        over = {s for s in order if s not in fixed and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        assert targets[s] == pytest.approx(2 * sizes[s] if s in fixed else level * weight[s])
        assert abs(taken[s] - targets[s]) <= 120
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(df.repartition(5), n_ranges=3).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}
    assert mixing.mix_sources(df.limit(0)).count() == 0


# 7: fingerprints


def test_fingerprints(spark):
    base = words(300, 1)
    near = base[:]
    near[10] = "changed"
    texts = {0: " ".join(base), 1: " ".join(base), 2: " ".join(near), 3: " ".join(words(300, 2)), 4: "", 5: None, 6: "one two", 7: "ÉÀ one", 9: " ".join(words(4000, 3)), -5: "tail"}
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df, n_ranges=3).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        own, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        if grams(own) and grams(edited):
            assert abs(got[i].near_edited - jaccard(own, edited)) < 0.2
        if grams(own) and grams(nxt):
            assert abs(got[i].near_next - jaccard(own, nxt)) < 0.2
    assert got[0].fingerprint == got[1].fingerprint != got[3].fingerprint and len(got[0].fingerprint) == fingerprint.BINS * fingerprint.BITS // 4
    assert got[4].fingerprint == got[5].fingerprint == "" and got[5].near_next == 1.0 and got[6].near_next == 0.0
    assert fingerprint.fingerprint_documents(df.limit(0)).count() == 0
    assert fingerprint.fingerprint_documents(df.where("doc_id = 0")).first().near_next == 1.0


def spark_xxhash(values):
    """Spark's xxhash64: each value's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def spark_murmur(values):
    """Spark's hash of ints."""
    rotate, h, m = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF, 42, 0xFFFFFFFF
    for v in values:
        h = (rotate(h ^ rotate(v * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64) & m
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def minhash_by_hand(text, n=5, bins=128, draws=1024):
    ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    if not ws:
        return ""
    ws = [spark_xxhash([w]) for w in ws]
    runs = [spark_xxhash(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [spark_xxhash([" ".join(map(str, ws))])]
    least = {(h >> 57) + bins // 2: h for h in sorted(runs, reverse=True)}
    out = ""
    for b in range(bins):
        lender = next((x for x in ([b] if b in least else (spark_murmur([b, j]) % bins for j in range(draws))) if x in least), None)
        if lender is None:
            lender = (min(runs) >> 57) + bins // 2
        out += f"{least[lender] & 255:02x}"
    return out


def test_fingerprints_equal_plain_minhash_at_any_number_of_ranges(spark):
    rng = random.Random(70)
    texts = [" ".join(words(rng.choice([1, 3, 5, 8, 30, 200, 900]), 700 + i, 300)) for i in range(40)] + ["Ünï—Code 中文 ١٢", "", None]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, "again the same id"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprint.fingerprint_documents(df, n_ranges=2000).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), len(t or ""), minhash_by_hand(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint) for r in got) == expected
    again = {(r.doc_id, r.fingerprint, r.edited_sha256) for r in fingerprint.fingerprint_documents(df.repartition(5), n_ranges=2).collect()}
    assert again == {(r.doc_id, r.fingerprint, r.edited_sha256) for r in got}
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i in (20, 30):
        a, b = by_id[i].fingerprint, by_id[i].edited_fingerprint
        same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128
        assert by_id[i].near_edited == pytest.approx(min(1, max(0, (same - 1 / 256) / (1 - 1 / 256))))


# 8: Jaccard join


def joined_by_hand(texts, threshold=0.8):
    ids, links, root = sorted(texts), defaultdict(int), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(texts[a], texts[b]) >= threshold - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, texts = random.Random(8), {}
    for g in range(6):
        base = words(rng.randrange(20, 150), 100 + g)
        for _ in range(rng.randrange(1, 14)):
            own = base[:]
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    texts |= {900: "", 901: None, 902: "", 903: "one two", 904: "One, two!", 905: "...", 906: " ".join(words(20000, 77)), 907: texts[0].upper()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs_of(spark, texts), recall=0.9999).collect()}
    assert got == joined_by_hand(texts)


def test_jaccard_join_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_join(df).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0
    # an id with two texts that each have near copies elsewhere, ids that are text, and a column of a clashing name
    one, two = words(60, 810), words(60, 811)
    rows = [("1", " ".join(one)), ("1", " ".join(two)), ("2", " ".join(one[:59])), ("3", " ".join(two[1:])), ("3", " ".join(two[1:])), (None, " ".join(two))]
    many = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id string, text string, key binary")
    assert sorted(map(tuple, jaccard_join.jaccard_join(many).collect())) == [("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("3", "1", 1)]
    kept = jaccard_join.near_duplicate_rows(many).collect()
    assert sorted((r.id, r.n) for r in kept if r.keep) == [("1", 1), ("1", 1)] and len(kept) == 5
    bands, rows = jaccard_join.choose_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


# 1: decontamination


def test_tiles_are_greedy_and_do_not_overlap():
    assert decontaminate.tile([1, 2, 3, 4, 5, 6, 7, 8], [[5, 6, 7, 8, 9], [1, 2, 3, 4]], 4) == [(0, 1, 0, 4), (4, 0, 0, 4)]
    assert decontaminate.tile([1, 2, 1, 2], [[1, 2, 9, 9]], 2) == [(0, 0, 0, 2)]  # the part's words are used once


def tiles_by_hand(pattern, parts, shortest):
    own, used, tiles = [False] * len(pattern), [[False] * len(p) for p in parts], []
    while True:
        longest, found = shortest, []
        for i in range(len(pattern)):
            for k, part in enumerate(parts):
                for j in range(len(part)):
                    n = 0
                    while i + n < len(pattern) and j + n < len(part) and pattern[i + n] == part[j + n] and not own[i + n] and not used[k][j + n]:
                        n += 1
                    if n > longest:
                        longest, found = n, [(i, k, j)]
                    elif n == longest:
                        found.append((i, k, j))
        if not found:
            return tiles
        for i, k, j in found:
            if not any(own[i : i + longest]) and not any(used[k][j : j + longest]):
                own[i : i + longest] = used[k][j : j + longest] = [True] * longest
                tiles.append((i, k, j, longest))


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(40)
    for _ in range(300):
        of = rng.choice([2, 3, 8])
        pattern, parts = [rng.randrange(of) for _ in range(rng.randrange(1, 25))], [[rng.randrange(of) for _ in range(rng.randrange(18))] for _ in range(rng.randrange(1, 4))]
        shortest = rng.choice([2, 3, 5])
        assert decontaminate.tile(pattern, parts, shortest) == tiles_by_hand(pattern, parts, shortest)
    assert decontaminate.tile([1, 2] * 3000, [[1, 2] * 2000, [2, 1] * 3000], 5)[0] == (0, 1, 1, 5999)


def test_contamination_equals_tiling_all_pairs(spark):
    """Reordered, edited and repetitive items, ids that are text or repeat, and a phrase that all items share."""
    rng, phrase = random.Random(41), words(8, 42)
    items = [(f"i{k % 11}", words(rng.randrange(5, 40), 900 + k, 60) + phrase) for k in range(12)] + [("loop", words(5, 43) * 8), ("two", words(2, 44) * 20)]
    texts = []
    for k, (_, item) in enumerate(items):
        cut = rng.randrange(len(item))
        edited = item[:]
        edited[rng.randrange(len(item))] = "edited"
        texts += [(f"d{k}", words(20, 950 + k) + item[cut:] + ["and"] + item[:cut]), (f"d{k}", edited + words(10, 970 + k)), (f"e{k}", item[: 2 * len(item) // 3])]
    texts += [("f", phrase * 3), (None, items[0][1])]
    want = {}
    for i, text in texts:
        for j, item in items:
            covered = sum(t[3] for t in tiles_by_hand(item, [text], 5))
            if i is not None and covered >= 0.8 * len(item):
                want[i, j] = max(want.get((i, j), 0), covered / len(item))
    docs = spark.createDataFrame([(i, " ".join(t), 1) for i, t in texts], "doc_id string, text string, row int").repartition(3)
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in items], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == want and ("d12", "loop") in got and ("d13", "two") in got


def test_decontamination(spark):
    items = {0: words(30, 50), 1: words(40, 51), 2: ["short", "item"], 3: words(12, 52)}
    swapped = items[1][25:] + ["and"] + items[1][:25]
    texts = {
        0: " ".join(words(200, 60) + items[0] + words(50, 61)), 1: "Intro. " + " ".join(swapped).upper(), 2: " ".join(words(300, 62)), 3: " ".join(items[0][:15]), 4: "short item", 5: None, 6: "",
        7: " ".join(words(30000, 63) + items[3]), 8: " ".join(items[0] + items[1]),
    }
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None), (None, " ".join(items[0]))], "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (7, 3), (8, 0), (8, 1)}
    assert next([(s.begin, s.end) for s in r.spans] for r in got if r.doc_id == 0) == [(200, 230)]
    assert decontaminate.find_contamination(docs_of(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs_of(spark, texts), bench.limit(0)).count() == 0


# 4: passages


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(4)
    order = rng.permutation(400).astype(np.uint64)
    width = 12
    centres = sorted({i + int(np.argmin(order[i : i + width])) for i in range(len(order) - width + 1)})
    left, right = substring_dedup.compact_windows(order, np.array(centres), 0, len(order))
    for c, a, b in zip(centres, left.tolist(), right.tolist(), strict=True):
        lower = np.flatnonzero(order < order[c])
        assert (a, b) == (max([-1, *lower[lower < c]]) + 1, min([len(order), *lower[lower > c]]) - 1)


def test_cells_cover_each_start_once():
    w = np.arange(700, dtype=np.uint64) % np.uint64(230)
    g, at = tokens.shingles(tokens.mix(w), np.array([0, 300, 320, 700]), 5)
    width = 46
    for band, (signature, _, first, last) in enumerate(substring_dedup.cells(g, at, width)):
        starts = [s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1) if any(at[r] <= s <= at[r + 1] - width for r in range(3))]
        assert starts == [s for r in range(3) for s in range(at[r], at[r + 1] - width + 1)]
        for sig, a, b in zip(signature.tolist(), first.tolist(), last.tolist(), strict=True):
            for s in (a, b):
                f, h = (s + int(np.argmin(tokens.mix(g[s : s + width], 100 + 2 * band + k) & ~np.uint64((1 << 26) - 1))) for k in (0, 1))
                assert sig == int(tokens.mix(g[[f]] + np.uint64(3) * tokens.mix(g[[h]], 7), 200 + band)[0])


def test_repeated_passages(spark):
    passage, other = words(60, 70), words(80, 71)
    edited = other[:]
    edited[40] = "edit"
    line = words(12, 72)
    texts = {i: " ".join(words(100, 200 + i) + passage + words(30, 300 + i)) for i in range(0, 40, 4)}
    texts |= {101: " ".join(other), 102: " ".join(words(50, 73) + edited), 103: " ".join(words(400, 74))}
    texts |= {200 + i: " ".join(words(80, 400 + i) + line + words(80, 500 + i)) for i in range(20)}
    texts |= {301: None, 302: "", 303: "few words", 304: " ".join(passage[:45]), 305: " ".join(words(20000, 75))}
    got = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    pairs = {(r.doc_id, r.source_doc_id) for r in got}
    assert {(i, 0) for i in range(4, 40, 4)} | {(102, 101)} <= pairs
    assert all(b < a and a < 40 for a, b in pairs - {(102, 101)})  # others that share a signature but for the first document
    for r in got:
        assert (r.begin, r.end) == ((100, 160) if r.doc_id < 100 else (50, 130)) and r.similarity >= 0.8
    assert substring_dedup.repeated_passages(docs_of(spark, texts).limit(0)).count() == 0


def test_passages_on_every_shift(monkeypatch):
    code = np.random.default_rng(5).permutation(60_000).astype(np.uint16)
    own, other = code[:160], np.concatenate((code[1000:1040], code[50:80], code[2000:2001], code[80:110], code[3000:3040]))
    assert substring_dedup.shared_runs(own, other, 5).tolist() == [[80, 71, 26], [50, 40, 26]]
    assert [m[:4] for m in substring_dedup.matching_passages(own, other, 5, 50, 0.8)] == [(50, 110, 40, 101)]
    looped = np.tile(code[:7], 30)
    monkeypatch.setattr(substring_dedup, "_SLICE", 40)
    runs = substring_dedup.shared_runs(looped, looped[:100], 5)
    assert (runs[:, 0] - runs[:, 1]).tolist() == list(range(-91, 204, 7)) and runs[:, 2].max() == 96


@pytest.mark.parametrize(("length", "cut", "resume", "edit", "similarity"), [(98, 49, 49, 8, 90 / 106), (100, 47, 53, 6, 86 / 106), (98, 49, 49, 14, 90 / 112), (98, 49, 49, 15, None), (60, 30, 31, 1, 51 / 61)])
def test_passages_chain_over_any_gap(length, cut, resume, edit, similarity):
    code = np.random.default_rng(6).permutation(60_000).astype(np.uint16)
    own, other = code[:length], np.concatenate((code[1000:1020], code[:cut], code[2000 : 2000 + edit], code[resume:length], code[3000:3020]))
    got = substring_dedup.matching_passages(own, other, 5, 50, 0.8)
    assert got == ([(0, length, 20, 20 + cut + edit + length - resume, pytest.approx(similarity))] if similarity else [])


def test_many_runs_cover_what_few_find(monkeypatch):
    """Texts of lines that vary by a word, periodic ones and noise: the bands find a passage wherever the whole search does, and each is one."""
    rng = np.random.default_rng(9)

    def lines(n, of):
        fixed = rng.integers(0, 60_000, of)
        return lambda: np.concatenate([np.append(fixed, rng.integers(0, 60_000)) for _ in range(n)]).astype(np.uint16)

    pairs = [(f(), f()) for f in (lines(20, 12), lines(12, 22), lines(8, 42), lines(6, 60))]
    base = rng.integers(0, 60_000, 400).astype(np.uint16)
    for k in (3, 8, 20):
        edited = base.copy()
        edited[rng.integers(0, 400, k)] = 1
        pairs.append((base, np.delete(edited, rng.integers(0, 400, 3))))
    pairs.append((np.tile(np.arange(7), 60).astype(np.uint16), np.ones(90, np.uint16)))
    for own, other in pairs:
        whole = substring_dedup.matching_passages(own, other, 5, 50, 0.8)
        monkeypatch.setattr(substring_dedup, "MANY_RUNS", 0)
        parts = substring_dedup.matching_passages(own, other, 5, 50, 0.8)
        monkeypatch.undo()
        assert bool(whole) == bool(parts)
        for a, b, c, d, similarity in parts:
            assert b - a >= 50 and similarity >= 0.8 and any(min(b, p[1]) - max(a, p[0]) >= 50 for p in whole)


def test_passages_by_brute_force(spark):
    """Edited passages of known similarity in random surroundings: nine tenths of those at 0.8 or more are found, and nothing else."""
    rng, texts, truth = random.Random(44), {}, {}
    for case in range(60):
        passage = words(rng.randrange(52, 130), 3000 + case, 10**6)
        edited = passage[:]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(1, len(edited) - 1)
            edited[k : k + rng.randrange(2)] = words(rng.randrange(1, 3), 4000 + rng.randrange(10**6), 10**6)
        around = lambda k: words(rng.randrange(60, 90), 100_000 + 10 * case + k, 10**6)  # noqa: B023, E731
        texts[2 * case], texts[2 * case + 1] = " ".join(around(0) + passage + around(1)), " ".join(around(2) + edited + around(3))
        truth[2 * case + 1, 2 * case] = jaccard(" ".join(passage), " ".join(edited))
    got = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    found = {(r.doc_id, r.source_doc_id) for r in got}
    near = {p for p, similarity in truth.items() if similarity >= 0.8}
    assert len(near) > 30 and found <= set(truth) and len(found & near) >= 0.9 * len(near)
    for r in got:
        a, b = texts[r.doc_id].split()[r.begin : r.end], texts[r.source_doc_id].split()[r.source_begin : r.source_end]
        assert len(a) >= 50 and jaccard(" ".join(a), " ".join(b)) >= 0.79


@pytest.mark.parametrize("block", [4096, 4])
def test_passages_of_others_than_the_first(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts, want = {}, set()
    for case in range(6):
        passage, at = words(60, 800 + case, 10**6), 100 * case
        for i in range(20):  # each a variant below the threshold
            variant = passage[:]
            for k in random.Random(case * 100 + i).sample(range(3), 1):
                variant[10 + k : 60 : 15] = words(len(variant[10 + k : 60 : 15]), 5000 + 100 * case + i, 10**6)
            texts[at + i] = " ".join(words(60, 6000 + at + i) + variant + words(60, 7000 + at + i))
        for i in (50, 51):
            texts[at + i] = " ".join(words(60, 6000 + at + i) + passage + words(60, 7000 + at + i))
        want.add((at + 51, at + 50))
    assert want <= {(r.doc_id, r.source_doc_id) for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect()}


def test_signatures_pass_only_if_both_parts_of_the_filter_hold_them():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words(120, 77, 10**6))])], ["id", "text"])
    parts = np.full((2, 1 << (substring_dedup.FILTER_BITS - 6)), np.uint64(2**64 - 1))
    passed = lambda *on: [list(x) for x in substring_dedup._regions(5, 46, 70, parts * np.array(on, np.uint64)[:, None])(iter([batch]))]
    assert passed(1, 1) and not passed(1, 0) and not passed(0, 1)


def test_runs_within_longer_ones_go():
    rng = np.random.default_rng(5)
    runs = rng.integers(0, 60, (600, 3)) + [0, 0, 1]
    runs = runs[np.argsort(-runs[:, 2], kind="stable")]
    kept: list[list[int]] = []
    for a, b, size in runs.tolist():
        if not any(c <= a and d <= b and a + size <= c + more and b + size <= d + more for c, d, more in kept):
            kept.append([a, b, size])
    assert substring_dedup._outer(runs).tolist() == kept


def test_gains_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(6)
    lengths, x = rng.integers(46, 120, 50), rng.integers(0, 46, 50)
    rows = [rng.random(k) < 0.9 for k in lengths]
    filled = np.array([np.pad(r, (0, 120 - len(r))) for r in rows])
    want = [substring_dedup.most_gain(r, 46, 0.8, int(k)) for r, k in zip(rows, x, strict=True)]
    assert np.allclose(substring_dedup.most_gains(filled, 46, 0.8, x), want)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_passages_need_no_broadcast_and_move_words_once(spark, monkeypatch, few):
    """Words leave the regions for the compared stretches only; the tables of searched groups have them once."""
    monkeypatch.setattr(substring_dedup, "FEW", few)
    made = {}
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name: made.setdefault(name, common.materialize(df, name)) if name not in made else common.materialize(df, name))
    passage = " ".join(words(60, 900, 10**6))
    texts = {k: f"{' '.join(words(60, 910 + k, 10**6))} {passage} {' '.join(words(60, 920 + k, 10**6))}" for k in range(4)}
    assert {(r.doc_id, r.source_doc_id) for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect()} >= {(k, 0) for k in (1, 2, 3)}
    assert "words" not in made["passages-members"].columns and "words" in made["passages-worded"].columns


# 9: archives


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_round_trip(zip64):
    out = io.BytesIO()
    w = zip_archive.ZipWriter(out.write, zip64=zip64)
    members = {f"m{i}/é": bytes([i]) * (i * 1000) for i in range(5)}
    for k, v in members.items():
        w.add(k, v)
    w.close()
    for stub in (b"", b"#!stub\n"):
        data = stub + out.getvalue() if not zip64 else out.getvalue()
        read = lambda at, n, data=data: data[at : at + n]
        got = {m.name: read(zip_archive.data_offset(read, m), m.size) for m in zip_archive.read_directory(read, len(data))}
        assert got == members
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
    data = many.getvalue()
    assert len(zip_archive.read_directory(lambda at, n: data[at : at + n], len(data))) == 66_000
    with pytest.raises(ValueError, match="not a ZIP"):
        zip_archive.read_directory(lambda at, n: b"x" * n, 100)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü?x=1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nX: y", None), (4, "x", ""), (5, "y", "solo"), (None, "z", "solo"), (6, "v", "big" * 100_000), (6, "v", "again"), (7, "w", "again")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, archive int").repartition(2)
    got = warc.read_archives(spark, warc.write_archives(pages), payload=True).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        keeper = max(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        refers = None if i == keeper else keeper
        want.append((i, len(body), warc.sha1_base32(body), "response" if refers is None else "revisit", refers, body if refers is None else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got], key=str) == sorted(want, key=str)
    small = warc.read_archives(spark, warc.write_archives(pages, min_bytes=6)).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == {1}
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


# 10: languages


def naive_phrases(text, references):
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and any(text[at : end + 1] in r for r in references):
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_cross_parsing_equals_naive_matching():
    rng = random.Random(10)
    refs = {k: ["".join(rng.choice(a) for _ in range(60)) for _ in range(3)] for k, a in (("x", "abc"), ("y", "cde"))}
    model = language_id.Model(refs)
    texts = ["".join(rng.choice("abcdeq") for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    found, count, some = model.phrases(pa.array(texts))
    assert count.tolist() == [len(t) for t in texts] and some.all()
    for k, lang in enumerate(model.languages):
        assert found[k].tolist() == [naive_phrases(t, refs[lang]) for t in texts]


@pytest.mark.parametrize("common", [250, 3])
def test_all_letters_of_large_alphabets_count(monkeypatch, common):
    monkeypatch.setattr(language_id, "COMMON", common)
    rng = random.Random(12)
    alphabets = {"en": "abcdefghij", "ja": [chr(0x3041 + i) for i in range(80)], "ko": [chr(0xAC00 + 7 * i) for i in range(700)], "zh": [chr(0x4E00 + 5 * i) for i in range(1000)]}
    pools = {k: ["".join(rng.choice(a) for _ in range(4)) for _ in range(400)] for k, a in alphabets.items()}
    text_of = lambda k, n: "".join(rng.choice(pools[k]) for _ in range(n))
    refs = {k: [text_of(k, 40) for _ in range(10 + 5 * i)] for i, k in enumerate(pools)}
    model = language_id.Model(refs)
    texts = [(k, text_of(k, 12)) for k in pools for _ in range(10)]
    texts += [("", t[:9] + chr(0x9FFF) + u[:9]) for (_, t), (_, u) in zip(texts, reversed(texts), strict=True)]
    found, count, _ = model.phrases(pa.array([t for _, t in texts]))
    assert count.tolist() == [len(t) for _, t in texts]
    for k, lang in enumerate(model.languages):
        assert found[k].tolist() == [naive_phrases(t, refs[lang]) for _, t in texts]
    labels, _ = model.predict(pa.array([t for _, t in texts]))
    assert labels[:40] == [k for k, _ in texts[:40]]


def test_more_labels_than_fit_full_tables(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TABLE_BYTES", 8 << 20)
    monkeypatch.setattr(language_id, "REFERENCE_TOTAL", 90 * 1500)
    rng, rows = random.Random(13), []
    for k in range(90):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(60)), f"l{k}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(df)
    assert len(model.languages) == 90 and model.width < 20 and model.table.nbytes <= 8 << 20
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)


def test_language_id(spark):
    syllables = {"aa": ["ba", "bo", "bi"], "bb": ["ku", "ke", "ko"]}
    rng, rows = random.Random(11), []
    for i in range(80):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang))
    rows += [(100, None, "aa"), (101, "123 !!", "aa"), (102, "", None), (103, "ba" * 60_000, None), (None, "kuke", "bb")]
    df = spark.createDataFrame([(i, t, la, 0.5) for i, t, la in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    import zlib

    for i, t, lang in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if i is not None and i < 80:
            assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "aa", "bb"]
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none, language_id.fit(none)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), language_id.fit(df)).count() == 0


# 6: quality


def test_quality_classifier(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "good", "shout", "toxic"])
        ws = words(rng.randrange(40, 80), 1000 + i, 300)
        if kind == "shout":
            ws = [w.upper() + "!!" for w in ws]
        if kind == "toxic":
            ws[5] = ws[20] = rng.choice(["slur", "insult"])
        rows.append((i, " ".join(ws), "en", "bad.site" if i % 40 == 0 else f"s{i % 3}"))
        if i % 2:
            labels.append((i, int(kind != "shout"), int(kind == "toxic")))
        rows[-1] += (kind,)
    extra = [(900, None, None, None, "none"), (901, "", "en", "s0", "none"), (902, "word " * 30_000, "en", None, "none"), (None, rows[0][1], "en", "s1", "none")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, kind string").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    judged = quality.classify(df, quality.fit(df, lab))
    got = {r.id: r for r in judged.collect()}
    wrong = [i for i, _, _, _, kind in rows if got[i].keep != (kind == "good")]
    assert len(got) == len(rows) + 4 and len(wrong) <= 8
    free = quality.classify(df, quality.fit(df, lab.limit(0)))
    assert free.where("keep").count() == len(rows) + 4
    assert quality.classify(df.limit(0), None).count() == 0
    # the site posteriors recomputed by hand
    rows = [(r.host, r.path, r.p_low, r.p_toxic, r.low, r.toxic) for r in got.values()]
    logit = lambda p: np.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for k in (0, 1):
        p_of, shown_of = [r[2 + k] for r in rows], [r[4 + k] for r in rows]
        mean = min(1 - 1e-6, max(1e-6, sum(p_of) / len(rows)))
        groups = {}
        for level, key in (("host", lambda r: r[0]), ("path", lambda r: r[:2])):
            held = defaultdict(list)
            for r, p in zip(rows, p_of, strict=True):
                held[key(r)].append(p)
            spread = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in held.values()) - len(held) * mean * (1 - mean)
            strength = min(1e6, max(1.0, mean * (1 - mean) / max(1e-9, spread / len(rows)) - 1))
            groups[level] = ({x: (len(v), sum(v)) for x, v in held.items()}, strength)
        (hosts, top), (paths, mid) = groups["host"], groups["path"]
        for r, p, shown in zip(rows, p_of, shown_of, strict=True):
            host = (top * mean + hosts[r[0]][1] - p) / (top - 1 + hosts[r[0]][0])
            own = (mid * host + paths[r[:2]][1] - p) / (mid - 1 + paths[r[:2]][0])
            assert shown == pytest.approx(1 / (1 + np.exp(-(logit(p) + logit(own) - np.log(mean / (1 - mean))))), abs=2e-6)


def test_quality_held_out(spark):
    """Fitted on two thirds of the (few) labels, right on most of the others, of either kind."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    judged = quality.classify(docs, quality.fit(docs, labels.where(~held)))
    test = judged.select("id", "keep").join(labels.where(held), F.col("id") == F.col("doc_id")).withColumn("good", F.expr("quality = 1 AND toxic = 0"))
    right = {r.good: r.right for r in test.groupBy("good").agg(F.avg((F.col("keep") == F.col("good")).cast("int")).alias("right")).collect()}
    assert right[True] >= 0.95 and right[False] >= 0.75, right
