"""Language identification by cross-parsing: suffix automata of labelled text, fewest phrases win."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

#: Characters of reference text per language, at most, and of all languages together; many languages share the latter.
REFERENCE, REFERENCE_TOTAL = 12_000, 2_400_000
#: Characters taken from one document: references are put together of many.
PER_DOC = 150
#: Languages that are learned: of more labels, those with most documents.
MOST_LANGUAGES = 1000
#: Bytes of all tables together; with many languages, fewer letters have columns.
TABLE_BYTES = 128 << 20
#: A text is parsed in blocks of so many characters, all blocks side by side.
BLOCK = 2048
_CHUNK = 4 << 20
_UNKNOWN, _GAP, _FIRST = 0, 1, 2
#: Letters that have a column in the tables; the steps of rarer ones are looked up in a sorted list.
COMMON = 250
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def automaton(text: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix automaton of ``text``: a table [state, symbol] of next states, -1 where there is none, and (state, symbol, next state) of symbols past the table.

    ``_UNKNOWN`` parts documents: no match goes across it.
    """
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text:
        state = len(link)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    table = np.full((len(link), symbols), -1, np.int64)
    rare = []
    for state, steps in enumerate(step):
        for c, to in steps.items():
            if c < symbols:
                table[state, c] = to
            else:
                rare.append((state, c, to))
    table[:, _UNKNOWN] = -1
    return table, np.array(rare, np.int64).reshape(-1, 3)


class Model:
    """Per language a parsing table; all lie in one array of at most ``TABLE_BYTES`` (for references of ``REFERENCE_TOTAL`` characters)."""

    def __init__(self, references: dict[str, list[str]]) -> None:
        self.languages = sorted(references)
        seen = Counter(c for docs in references.values() for d in docs for c in d.lower() if c.isalpha())
        alphabet = sorted(seen, key=lambda c: (-seen[c], c))
        self.symbol = {c: i + _FIRST for i, c in enumerate(alphabet)}
        states = 2 * sum(len(d) + 1 for docs in references.values() for d in docs) + 1
        self.width, self.size = min(len(alphabet), COMMON, max(8, TABLE_BYTES // 4 // states)) + _FIRST, []
        self.symbols = len(alphabet) + _FIRST
        tables, self.offsets = [], []
        keys, values, self.missing = [], [], np.zeros((len(references), self.symbols - self.width), np.int64)
        at = 0
        for nth, language in enumerate(self.languages):
            text: list[int] = []
            for d in references[language]:
                text += [*self._codes(d), _UNKNOWN]
            self.size.append(max(2, len(text)))
            go, rare = automaton(text, self.width)
            # a missing step ends the phrase and begins the next with the same symbol, or skips one never seen
            again = np.where(go[0] >= 0, go[0], 0)
            ends = np.where(go[0] >= 0, 1, 2)
            following = np.where(go >= 0, go, again)
            phrases = np.where(go >= 0, 0, np.broadcast_to(ends, go.shape)).copy()
            phrases[0] = go[0] < 0
            tables.append(((at + following * self.width) << 2 | phrases).ravel().astype(np.int32))
            keys.append((at + rare[:, 0] * self.width) * self.symbols + rare[:, 1])
            values.append((at + rare[:, 2] * self.width) << 2)
            self.missing[nth] = at << 2 | 2
            first = rare[rare[:, 0] == 0]
            self.missing[nth, first[:, 1] - self.width] = (at + first[:, 2] * self.width) << 2 | 1
            self.offsets.append(at)
            at += go.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        key, value = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)])
        order = np.argsort(key)
        self.rare_key, self.rare_value = np.append(key[order], np.iinfo(np.int64).max), np.append(value[order], 0)

    def _rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What the table would hold for [language, text] states and the texts' symbols, none of which has a column."""
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.searchsorted(self.rare_key, key)
        missing = self.missing[:, symbol - self.width] - (state == np.asarray(self.offsets)[:, None])  # at the root no phrase ends
        return np.where(self.rare_key[at] == key, self.rare_value[at], missing)

    def _codes(self, text: str) -> list[int]:
        out: list[int] = []
        for c in text.lower():
            s = self.symbol.get(c, _UNKNOWN) if c.isalpha() else _GAP
            if s != _GAP or not out or out[-1] != _GAP:
                out.append(s)
        return out

    def phrases(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases [language, row], symbols parsed and whether there is a letter, of each row."""
        n = len(text)
        text = pc.utf8_lower(pc.fill_null(text, ""))
        lengths = np.asarray(pc.utf8_length(text), np.int64)
        points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), lengths)
        is_letter = letters()[points]
        code = np.full(0x110000, _UNKNOWN, np.int32)
        for c, s in self.symbol.items():
            code[ord(c)] = s
        symbols = np.where(is_letter, code[points], np.int32(_GAP))
        has_letter = np.bincount(row[is_letter], minlength=n) > 0
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP) | (row[1:] != row[:-1])
        symbols, row = symbols[keep], row[keep]
        count = np.bincount(row, minlength=n)
        blocks = -(-count // BLOCK)
        block_row = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(block_row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(count) - count)[block_row] + nth * BLOCK
        width = np.minimum(BLOCK, count[block_row] - nth * BLOCK)
        order = np.argsort(-width, kind="stable")
        block_row, begin, width = block_row[order], begin[order], width[order]
        roots = np.asarray(self.offsets, self.table.dtype)[:, None]
        state = np.repeat(roots, len(width), axis=1)
        found = np.zeros(state.shape, np.int32)
        symbols = symbols.astype(self.table.dtype)
        some_rare = bool((symbols >= self.width).any())
        active = np.searchsorted(-width, -np.arange(1, (width[0] if len(width) else 0) + 1), "right")
        for t, k in enumerate(active.tolist()):
            symbol = symbols[begin[:k] + t]
            rare = np.flatnonzero(symbol >= self.width) if some_rare else ()
            if len(rare):
                got = self.table[state[:, :k] + np.where(symbol < self.width, symbol, _UNKNOWN)]
                got[:, rare] = self._rare(state[:, rare], symbol[rare].astype(np.int64))
            else:
                got = self.table[state[:, :k] + symbol]
            found[:, :k] += got & 3
            np.right_shift(got, 2, out=state[:, :k])
        found += state != roots
        out = np.zeros((len(self.languages), n))
        for i in range(len(self.languages)):
            out[i] = np.bincount(block_row, weights=found[i], minlength=n)
        return out, count, has_letter

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        labels: list[str] = []
        scores: list[np.ndarray] = []
        for begin, end in chunks(text, _CHUNK):
            found, count, some = self.phrases(text[begin:end])
            if not self.languages:
                labels += ["und"] * (end - begin)
                scores.append(np.zeros(end - begin))
                continue
            # phrases by what one costs to point at, per symbol: the cross-entropy of the text
            cost = found * np.log2(np.asarray(self.size, float))[:, None] / np.maximum(count, 1)
            best = cost.argmin(axis=0)
            ranked = np.sort(cost, axis=0)
            sure = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(ranked) > 1 else np.ones(end - begin)
            labels += [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, np.clip(sure, 0, 1), 0.0))
        return labels, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (null: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled documents that are not held out.

    Labels are counted over all documents, and the ``MOST_LANGUAGES`` with most documents (then by name) are learned. A language's
    reference text has up to ``REFERENCE`` characters (fewer if ``REFERENCE_TOTAL`` shared by all languages is less): stretches of up to
    ``PER_DOC`` characters from hashed places of documents drawn by the hash of the id. Twice as many documents as this needs
    reach the driver, a bounded sample.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Model({})
    size = min(REFERENCE, REFERENCE_TOTAL // len(counts))
    wanted = 2 * -(-size // PER_DOC)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000_000)) / 1e9
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, wanted / n)) for lang, n in counts], f"learned {docs.schema[lang_col].dataType.simpleString()}, share double")
    drawn = usable.withColumn("draw", draw).join(F.broadcast(share), F.col("lang") == F.col("learned")).where("draw < share")  # MOST_LANGUAGES rows at most
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - PER_DOC + 1, F.lit(1))).cast("int")
    rows = drawn.select("draw", "id", "lang", F.substr("text", place + 1, F.lit(PER_DOC)).alias("text")).collect()
    references: dict[str, list[str]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)
    for _, _, lang, text in sorted(map(tuple, rows)):
        if held[lang] < size and any(c.isalpha() for c in text):
            references[lang].append(text)
            held[lang] += len(text)
    return Model(references)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from its whole text alone.

    The text is lower-cased; runs of other characters than letters are one gap.
    Each language's automaton parses it greedily into longest matches with the
    language's reference, in blocks of ``BLOCK`` symbols at which a phrase ends. The language with the least
    phrases, weighed by the log of its reference's length and divided by the
    text's, wins; ties go to the first by name. score is one less the best cost over the second best.

    Null text or no letter: ``und``, score 0. Letters that no reference has
    count as phrases of their own. Null ids count as not held out; repeated rows give a row each.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
