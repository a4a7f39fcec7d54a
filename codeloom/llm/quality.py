"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized
from .tokens import chunks, hash_words, mix

#: Labelled documents that the classifier is fitted on, at most: those with the least hash of the id.
MOST_TRAINING = 12_000
#: Word weights are kept by so many bits of the word's hash.
WORD_BITS = 18
#: Documents of a kind that must hold a word before it weighs.
LEAST_DOCS = 4
HEADS = ("quality", "toxic")
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 other letters and digits, 3 symbols, 0 white space
_CLASS[33:127] = 3
_CLASS[48:58] = _CLASS[97:123] = _CLASS[128:] = 2
_CLASS[65:91] = 1
_SHIFT = np.uint64(64 - WORD_BITS)


def _slots(words: np.ndarray) -> np.ndarray:
    return (mix(words, 5) >> _SHIFT).astype(np.int64)


def _shape(text: pa.Array, words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per row: logarithms of the words, and of the shares of upper-case, symbols, repeats next to and two words after each other."""
    n = len(text)
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = _CLASS[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    edges = offsets - offsets[0]

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (run[at[1:]] - run[at[:-1]]).astype(float)

    count = np.diff(ptr).astype(float)
    upper, symbols, plain = (total(raw == k, edges) for k in (1, 3, 2))
    row = np.repeat(np.arange(n), np.diff(ptr))
    again = np.zeros((2, len(words)), bool)
    for k in (1, 2):
        again[k - 1, k:] = (words[k:] == words[:-k]) & (row[k:] == row[:-k])
    letters, some = np.maximum(1, upper + plain), np.maximum(1, count)
    shares = np.stack([upper / letters, symbols / np.maximum(1, letters + symbols), total(again[0], ptr) / some, total(again[1], ptr) / some], axis=1)
    return np.concatenate([np.log1p(count)[:, None], np.log(shares + 0.01)], axis=1)


def _top(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per row the largest of the values, and the sum of their excess over 2 (at most 20)."""
    out = np.zeros((len(ptr) - 1, 2))
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        out[some, 0] = np.maximum.reduceat(values, ptr[some])
        out[some, 1] = np.minimum(20, np.add.reduceat(np.maximum(values - 2, 0), ptr[some]))
    return out


@dataclass
class Classifier:
    """Log odds of words by head, and a logistic regression by head on shape and words."""

    words: np.ndarray  # [head, slot]
    weights: np.ndarray  # [head, feature + 1]

    def features(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for begin, end in chunks(text):
            words, ptr = hash_words(text[begin:end])
            slots = _slots(words)
            shape = _shape(text[begin:end], words, ptr)
            yield begin, end, np.stack([np.concatenate([shape, _top(w[slots], ptr), np.ones((end - begin, 1))], axis=1) for w in self.words])

    def score(self, text: pa.Array) -> np.ndarray:
        """[head, row]: the probability of low quality, and of toxicity."""
        out = np.zeros((len(HEADS), len(text)))
        for begin, end, x in self.features(text):
            z = np.einsum("hrf,hf->hr", x, self.weights)
            out[:, begin:end] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on scaled features (the last is 1), its weights for features as they are."""
    scale, middle = np.maximum(x.std(axis=0), 1e-6), x.mean(axis=0)
    scale[-1], middle[-1] = 1, 0
    x = (x - middle) / scale
    w, fixed = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    fixed[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(fixed), x.T @ (y - p) - fixed * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w /= scale
    w[-1] -= w @ middle
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a word of each slot, by fold and label (bad: low quality, toxic)."""
    held = np.zeros((2, 1 + len(HEADS), 1 << WORD_BITS), np.int32)
    for batch in batches:
        fold = batch.column(0).to_numpy()
        marks = [np.asarray(batch.column(i)) for i in (1, 2)]
        for begin, end in chunks(batch.column(3)):
            words, ptr = hash_words(batch.column(3)[begin:end])
            slots = _slots(words)
            for i in range(end - begin):
                own = np.unique(slots[ptr[i] : ptr[i + 1]])
                k = int(fold[begin + i])
                held[k, 0, own] += 1
                for h, mark in enumerate(marks):
                    if mark[begin + i]:
                        held[k, 1 + h, own] += 1
    for k in range(2):
        at = np.flatnonzero(held[k, 0])
        yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(at), k), pa.int32()), "slot": pa.array(at, pa.int64()), **{c: pa.array(held[k, i, at], pa.int64()) for i, c in enumerate(("docs", "low", "toxic"))}})


def _log_odds(count: np.ndarray, every: np.ndarray, bad: int, total: int) -> np.ndarray:
    rest = every - count
    odds = np.log((count + 0.5) / (bad + 1)) - np.log((rest + 0.5) / (total - bad + 1))
    return np.where(count >= LEAST_DOCS, odds, np.minimum(odds, 0))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """A classifier from labels (id, quality, toxic): None if there is no labelled document.

    At most ``MOST_TRAINING`` labelled documents, those with the least hash of
    the id, are used, so what reaches the driver is bounded: their features, and
    the counts of 2**``WORD_BITS`` word slots. Word weights for a document's
    features come from the other half of the sample, so they do not know it.
    Labels with nulls are ignored.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    chosen = usable.groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(MOST_TRAINING)
    chosen = materialize(chosen.select(F.col(id_col).alias("label_id"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") != 0).cast("int").alias("tox")), "quality-labels")
    sample = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("label_id"))  # MOST_TRAINING rows at most
    sample = materialize(sample.select(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fold")), F.lit(2)).cast("int").alias("fold"), "low", "tox", "text"), "quality-sample")
    n, low, tox = sample.agg(F.count("*"), F.sum("low"), F.sum("tox")).first()
    if not n:
        return None
    sizes = {r["fold"]: (r["n"], r["low"], r["tox"]) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("tox").alias("tox")).collect()}
    counted = sample.mapInArrow(_count_words, "fold int, slot long, docs long, low long, toxic long").groupBy("fold", "slot").agg(*[F.sum(c).alias(c) for c in ("docs", "low", "toxic")])
    counted = counted.toArrow()
    held = np.zeros((2, 1 + len(HEADS), 1 << WORD_BITS))
    for i, c in enumerate(("docs", "low", "toxic")):
        held[counted["fold"].to_numpy(), i, counted["slot"].to_numpy()] = counted[c].to_numpy()
    by_fold = [np.stack([_log_odds(held[k, 1 + h], held[k, 0], sizes.get(k, (0, 0, 0))[1 + h], sizes.get(k, (0, 0, 0))[0]) for h in range(2)]) for k in range(2)]
    empty = np.zeros((2, 8))
    models = [Classifier(w, empty) for w in by_fold]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, text = batch.column(0).to_numpy(), batch.column(3)
            x = np.zeros((2, len(batch), 8))
            for k in range(2):
                for begin, end, got in models[1 - k].features(text):
                    rows = np.flatnonzero(fold[begin:end] == k)
                    x[:, begin + rows] = got[:, rows]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x[0])), pa.array(list(x[1]))], ["low", "tox", "x0", "x1"])

    table = sample.mapInArrow(features, "low int, tox int, x0 array<double>, x1 array<double>").toArrow()
    weights = np.stack([_newton(np.array(table[f"x{h}"].to_pylist()), table[c].to_numpy().astype(float)) for h, c in enumerate(("low", "tox"))])
    both = np.stack([_log_odds(held[:, 1 + h].sum(0), held[:, 0].sum(0), (low, tox)[h], n) for h in range(2)])
    return Classifier(both.astype(np.float32), weights)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(level: DataFrame, p: str, mean: float) -> float:
    """Pseudo-documents that the level above is worth: from the spread of the groups' means beyond chance, by moments."""
    n, within, spread = F.col("n"), F.lit(mean * (1 - mean)), F.pow(F.col(p) / F.col("n") - F.lit(mean), 2)
    got = level.agg(F.sum(n * spread), F.sum(within), F.sum(n)).first()
    if not got[2]:
        return 1.0
    between = max(1e-9, (got[0] - got[1]) / got[2])
    return float(min(1e6, max(1.0, mean * (1 - mean) / between - 1)))


def _with_sites(scored: DataFrame, threshold: float) -> DataFrame:
    """Adds low, toxic and keep to a written table with host, path, p_low and p_toxic, from the sums over all of it."""
    sums = [F.count("*").alias("n"), F.sum("p_low").alias("s_low"), F.sum("p_toxic").alias("s_toxic")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s_low", "s_toxic")]), "quality-hosts")
    total = hosts.agg(F.sum("n"), F.sum("s_low"), F.sum("s_toxic")).first()
    n = max(1, total[0] or 0)
    site = paths.join(hosts.select(F.col("host").alias("host_"), F.col("n").alias("host_n"), F.col("s_low").alias("host_low"), F.col("s_toxic").alias("host_toxic")), F.col("host").eqNullSafe(F.col("host_")))
    site = site.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "s_low", "s_toxic", "host_n", "host_low", "host_toxic")
    out = scored.join(sized(materialize(site, "quality-sites")), F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    for i, head in enumerate(("low", "toxic")):
        mean = min(1 - 1e-6, max(1e-6, (total[1 + i] or 0.0) / n))
        top, mid = _strength(hosts, f"s_{head}", mean), _strength(paths, f"s_{head}", mean)
        p = F.col(f"p_{head}")
        host = (F.lit(top * mean) + F.col(f"host_{head}") - p) / (F.lit(top - 1) + F.col("host_n"))
        own = (F.lit(mid) * host + F.col(f"s_{head}") - p) / (F.lit(mid - 1) + F.col("n"))
        odds = _logit(p) + _logit(own) - F.lit(float(np.log(mean / (1 - mean))))
        out = out.withColumn(head, F.round(1 / (1 + F.exp(-odds)), 6))
    out = out.withColumn("keep", (F.col("low") < threshold) & (F.col("toxic") < threshold))
    return out


def classify(docs: DataFrame, model: Classifier | None, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, text_hash, host, path, p_low and p_toxic of the text, low and toxic with the site, keep.

    The classifier reads each whole text. Its probabilities are summed by host
    and path over all documents; a host's mean is shrunk to the global mean and
    a path's to its host's, by as many pseudo-documents as the spread of the
    groups' means calls for, so sparse sites stay near what is known above
    them. A document's own evidence is left out of its site's. The site's log
    odds, less the global ones, are added to the document's. A document is
    kept if both low and toxic are below ``threshold``.

    Sums are pre-aggregated, so a host with a third of all rows is a row per
    task. Null hosts and paths are sites of their own. Null or empty texts are
    scored as empty. Without a model (no labels) all probabilities are 0 and all is kept.
    Repeated rows are scored each. Null ids are kept as such. Other columns are not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(batch.column(4)) if model else np.zeros((2, len(batch)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(p[0]), pa.array(p[1])], ["id", "text_hash", "host", "path", "p_low", "p_toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = materialize(rows.mapInArrow(run, f"id {kind}, text_hash long, host string, path string, p_low double, p_toxic double"), "quality-scores")
    out = _with_sites(scored, threshold)
    return out.select("id", "text_hash", "host", "path", "p_low", "p_toxic", "low", "toxic", "keep")
