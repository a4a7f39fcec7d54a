"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Everything is built from DataFrame functions on arrays within a row; making a
fingerprint moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, range_bounds, range_bucket, shuffle_partitions

BINS = 128
BITS = 8
#: Draws by which an empty bin looks for a filled one.
DRAWS = 1 << 10
#: A bin is the top bits of the (signed) hash, so sorting hashes sorts bins.
_SHIFT = 64 - 7
_SPLIT = r"[^\p{L}\p{N}]+"


def add_fingerprint(df: DataFrame, text: str, out: str, *, n: int = 5) -> DataFrame:
    """Adds ``out``: ``BINS`` hex bytes of the densified one-permutation MinHash of the word ``n``-shingles of ``text``.

    Shingle hashes are made once, sorted, and the first of each bin is its
    minimum. An empty bin takes the value of the first filled one among up to ``DRAWS``
    hash draws from its number and the attempt, the same for all documents, so
    that two documents that fill the same bins borrow alike; should all draws
    miss, it takes that of the first filled bin. The low ``BITS`` bits of
    each value are kept. Without a word the fingerprint is empty.
    """
    words, hashed, sorted_, firsts, slots = (fresh(df.columns, f"{out}_{x}") for x in ("words", "hashed", "sorted", "firsts", "slots"))
    df = df.withColumn(words, F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPLIT), ""), lambda w: F.xxhash64(w)))
    w = F.col(words)
    runs = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).when(
        F.size(w) > 0, F.array(F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " ")))
    )
    df = df.withColumn(hashed, runs)
    df = df.withColumn(sorted_, F.sort_array(hashed))
    s = F.col(sorted_)
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))
    df = df.withColumn(firsts, first)
    f = F.col(firsts)
    bit = lambda x, high: F.when((x >= 0) == F.lit(high), F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright(x, _SHIFT).cast("int"), F.lit(BINS // 2)))).otherwise(F.expr("0L"))
    mask = lambda high: F.aggregate(f, F.expr("0L"), lambda acc, x: acc.bitwiseOR(bit(x, high)))
    filled = F.struct(mask(False).alias("low"), mask(True).alias("high"))
    df = df.withColumn(slots, filled)
    m = F.col(slots)
    half = BINS // 2
    low_bits = F.array(*[F.lit((1 << i) - 1).cast("long") for i in range(half)])
    def has(b: Column) -> Column:
        return F.getbit(F.when(b < half, m["low"]).otherwise(m["high"]), F.pmod(b, F.lit(half)))

    def nth(b: Column) -> Column:  # the number of filled bins below b
        inside = F.bit_count(F.when(b < half, m["low"]).otherwise(m["high"]).bitwiseAND(F.get(low_bits, F.pmod(b, F.lit(half)))))
        return F.when(b < half, inside).otherwise(inside + F.bit_count(m["low"]))

    def drawn(b: Column, begin: int, end: int) -> Column:
        at = F.transform(F.sequence(F.lit(begin), F.lit(end - 1)), lambda j: F.pmod(F.hash(b, j), F.lit(BINS)))
        return F.get(F.filter(at, lambda x: has(x) == 1), F.lit(0))

    any_filled = (F.shiftright(F.get(f, F.lit(0)), _SHIFT) + half).cast("int")
    lenders = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda b: F.when(has(b) == 1, b).otherwise(F.coalesce(drawn(b, 0, 4), drawn(b, 4, 32), drawn(b, 32, DRAWS), any_filled)),
    )
    digits = F.transform(lenders, lambda b: F.substr(F.hex(F.get(f, nth(b)).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(1 << BITS)), F.lit(2)))
    packed = F.lower(F.concat_ws("", digits))
    return df.withColumn(out, F.when(F.size(f) > 0, packed).otherwise("")).drop(words, hashed, sorted_, firsts, slots)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal bins, less what ``BITS`` bits match by chance."""
    d = BITS // 4
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * d + 1, F.lit(d)) == F.substr(b, i * d + 1, F.lit(d))))
    chance = 2.0**-BITS
    share = (equal / BINS - F.lit(chance)) / F.lit(1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by the first as
    many of the next document in descending order of id; the first document
    follows the last. Documents are cut into ranges of ids once, each range is
    sorted, and the text that a range's last row needs from the range below is
    sent along as one extra row, so texts move once and no range holds more than its share.

    Ids are whole numbers. Null text: empty. Null ids come last, in the order of a hash of the text; rows that share an id are ordered by
    text. A single document is its own next. No documents: no rows. Texts without a word have an empty fingerprint, likeness 1 to
    each other and 0 to the rest. Columns of ``docs`` other than id and text are not returned.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or shuffle_partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    no_id = F.col("id").isNull()
    base = base.withColumns({"none": no_id.cast("int"), "down": F.coalesce(-F.col("id"), F.lit(0))})
    # rows without an id are spread by their text; only if there are some does placing read the texts
    some = base.where(no_id).limit(1).count() > 0
    base = base.withColumn("tie", F.when(no_id, F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if some else F.lit(0).cast("long"))
    order = ["none", "down", "tie"]
    bounds = range_bounds(base.select(*order), order, n_ranges)
    part = range_bucket([F.col(c) for c in order], bounds)
    edges = sorted((r["part"], tuple(r["first"])) for r in base.select(*order).groupBy(part.alias("part")).agg(F.min(F.struct(*order)).alias("first")).collect())
    # the first rows of a range also go, as guests, to the end of the range before it
    doors = spark.createDataFrame([(*first, edges[i - 1][0]) for i, (_, first) in enumerate(edges)], "door_none int, door_down long, door_tie long, guest_of int")
    fp = add_fingerprint(base, "text", "fingerprint")
    met = (F.col("none") == F.col("door_none")) & (F.col("down") == F.col("door_down")) & (F.col("tie") == F.col("door_tie"))
    guest_of = F.col("guest_of")
    seats = fp.withColumn("part", part).join(F.broadcast(doors), met, "left").withColumn(  # n_ranges rows at most
        "seat", F.explode(F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("guest")), F.when(guest_of.isNotNull(), F.struct(guest_of.alias("part"), F.lit(1).alias("guest"))))))
    )
    seats = seats.select("id", "text", *order, "fingerprint", F.col("seat.part").alias("part"), F.col("seat.guest").alias("guest"))
    line = Window.partitionBy("part").orderBy("guest", *order, "text")
    paired = seats.withColumns({"next_text": F.lead("text").over(line), "next_fingerprint": F.lead("fingerprint").over(line)}).where("guest = 0").drop("guest", "part", *order)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    out = paired.withColumns({"n_chars": n.cast("long"), "edited": edited})
    out = add_fingerprint(out, "edited", "edited_fingerprint")
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
