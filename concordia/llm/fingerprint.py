"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

A text's words (runs of characters other than space and tab to carriage return, A-Z
lower-cased) form shingles of five; fewer words form one shingle.  Each shingle is hashed
once to 64 bits: the top bits name one of ``BINS`` bins, which keeps the least hash.  An
empty bin borrows from the filled bin that a random order of its own ranks first, which
is the optimal densification of Shrivastava (2017): the orders don't depend on the text,
so bins empty in two texts borrow alike.  Of every bin the low ``BITS`` bits are stored
as hex; likeness corrects for bits that agree by chance.

All of it is column expressions; nothing runs in Python on the executors.

Defined results: null and empty texts and those without words have the fingerprint '';
its likeness is 1 to itself and 0 to others; equal texts have equal fingerprints; a lone
document is its own next one; rows with equal ids follow each other in the order of their
texts, and rows without id come last; rows that repeat have equal fingerprints; texts are read whole whatever their length; an empty
table gives no rows; columns named like a result of ``with_next`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import table

BINS, BITS, SHINGLE = 128, 8, 5
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of neighbouring ids, about, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 4096, 16_384
LEAST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer does."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """One 64-bit hash for each shingle, in order of appearance, repeats included."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def shingles(hashed: Column) -> Column:
        n = F.size(hashed)
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (size - 1))), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(size))))
        return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))

    return let(words, shingles)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint as lowercase hex; ``bins`` is a power of two and ``bits`` a multiple of four."""
    shift, mask = 64 - (bins.bit_length() - 1), (1 << bits) - 1
    bin_of = lambda h: F.shiftrightunsigned(h, shift)

    def minima(ordered: Column) -> Column:
        """Of sorted hashes the first of each bin."""
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    def packed(least: Column) -> Column:
        def filled_bins(filled: Column) -> Column:
            def code(b: Column) -> Column:
                at = F.array_position(filled, b)
                borrowed = F.array_min(F.transform(least, lambda h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(~mask)).bitwiseOR(h.bitwiseAND(F.lit(mask)))))
                kept = F.when(at > 0, F.get(least, (at - 1).cast("int"))).otherwise(borrowed)
                return F.lpad(F.hex(kept.bitwiseAND(F.lit(mask))), bits // 4, "0")

            return F.lower(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), code), ""))

        return F.when(F.size(least) == 0, F.lit("")).otherwise(let(F.transform(least, bin_of), filled_bins))

    return let(let(F.sort_array(shingle_hashes(text)), minima), packed)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1."""
    wide = bits // 4
    part = lambda f, i: F.substring(f, i * wide + 1, F.lit(wide))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: part(a, i) == part(b, i))) / F.lit(float(bins))
    chance = 2.0**-bits
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.least(F.lit(1.0), estimate))


def _bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that end buckets of about BUCKET_ROWS rows each; the last is the largest id."""
    total = docs.count()
    n = min(MAX_BUCKETS, max(1, total // BUCKET_ROWS))
    row = docs.agg(F.percentile_approx(id_col, [(k + 1) / n for k in range(n)], max(10_000, 4 * n)).alias("cuts"), F.max(id_col).alias("top")).first()
    return sorted({*(row["cuts"] or []), row["top"]}) if row["top"] is not None else [LEAST]


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with next_<column> of the row that follows by descending id, and of the first row after the last.

    Rows go to buckets of neighbouring ids; the row that starts a bucket is sent to the
    bucket before it too, so that every row meets its successor there.  Each row is
    shuffled once, and no window spans the whole table.
    """
    bounds = _bounds(docs, id_col)
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    fine = F.array(*[F.array(*[F.lit(b).cast("bigint") for b in g]) for g in groups])
    ends = F.array(*[F.lit(g[-1]).cast("bigint") for g in groups])
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST))
    group = F.size(F.filter(ends, lambda e: e < F.col("__key")))
    place = F.size(F.filter(F.get(fine, F.col("__group")), lambda e: e < F.col("__key")))
    rows = docs.withColumn("__key", key).withColumn("__group", group).withColumn("__place", place)
    bucket = F.col("__group") * wide + F.col("__place")
    starts = F.get(F.get(fine, F.col("__group")), F.col("__place")) == F.col("__key")
    before = F.when(F.col("__key") == bounds[-1], F.lit(0)).otherwise(bucket + 1)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("sent"))
    sent = F.struct(before.alias("bucket"), F.lit(True).alias("sent"))
    rows = rows.withColumn("__to", F.explode(F.when(starts, F.array(own, sent)).otherwise(F.array(own))))
    rows = rows.withColumns({"__bucket": F.col("__to.bucket"), "__sent": F.col("__to.sent")}).drop("__to", "__group", "__place")
    order = Window.partitionBy("__bucket").orderBy("__sent", F.col("__key").desc(), text_col)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.filter(~F.col("__sent")).drop("__key", "__bucket", "__sent")


def edited(text: Column, following: Column, n_chars: Column) -> Column:
    """``text`` with its last third replaced by as many characters of ``following``."""
    cut = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - cut), F.substring(following, F.lit(1), cut))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprints of every document, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(docs, ["text", "fingerprint"]).withColumn("n_chars", F.length("text"))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("next_text"), F.col("n_chars")).alias("edited_text"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
