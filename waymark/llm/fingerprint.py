"""Threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps the 32-bit hash of every 5-word shingle that lies below a fixed fraction of the hash range, so sketches of any two
texts, however unequal, can be compared and merged: the share of one's hashes found in the other estimates containment. A text
none of whose hashes lies below keeps its true least hash in their place, which its value, at or above the threshold, tells from
the others; it shows whether two such texts are alike, but not what part of another text they are. Only texts without words have an empty
sketch. Hashes stand as signed ints, in the order of their unsigned values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
FRACTION = 0.25
BLANKS = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """A hash of each word of the text."""
    return F.transform(F.filter(F.split(text, BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def _unsigned(h: Column) -> Column:
    return h.cast("long").bitwiseAND(F.lit((1 << 32) - 1))


def _signed(h: Column) -> Column:
    """The low 32 bits of a long as an int."""
    return F.shiftright(F.shiftleft(h, 32), 32).cast("int")


def _below(h: Column, fraction: float) -> Column:
    """Whether a sketch's hash lies below the threshold; fractions are 0.5 at most, so those that do are positive ints."""
    return (h >= 0) & (h < int(fraction * (1 << 32)))


def _sorted(hashes: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(F.transform(hashes, _unsigned))), _signed)


def sketch(hashes: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The sketch of a column of word hashes. Texts of fewer than k words are one shingle. fraction: 0.5 at most."""
    n = F.size(hashes)
    run = F.slice(hashes, 1, F.greatest(n - (k - 1), F.least(n, F.lit(1))))
    shingles = F.transform(run, lambda h, i: F.shiftrightunsigned(F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, k))), 32))
    kept = F.filter(shingles, lambda h: h < int(fraction * (1 << 32)))
    least = F.filter(F.array(F.array_min(shingles)), lambda h: h.isNotNull())
    return F.transform(F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(least))), _signed)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none. Null where a has no hash below the threshold and another least one than b: nothing is known then."""
    kept = F.filter(a, lambda h: _below(h, fraction))
    return F.when(F.size(a) == 0, 1.0).when(F.size(kept) > 0, F.size(F.array_intersect(kept, b)) / F.size(kept)).when(F.size(F.array_intersect(a, b)) > 0, 1.0)


def merged(*sketches: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of the texts' shingles."""
    every = _sorted(F.flatten(F.array(*sketches)))
    kept = F.filter(every, lambda h: _below(h, fraction))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(every, 1, 1))


def text_of(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(_unsigned(h))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and sketch of every row. Repeated rows and null ids are rows of their own; further columns are left out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # a projection of its own: the shingles look their words' hashes up, and must not compute them again
    return rows.withColumn("hashes", word_hashes(F.col("text"))).select("doc_id", "text", sketch(F.col("hashes")).alias("sketch"))


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (doc_id, text, sketch) with next_text and next_sketch, those of the next lower doc_id; after the lowest comes the highest.

    Ties go by text; null ids come after all others. The ids are cut into ranges; a range also gets the first row of the next
    range, so each is one task's work and no order over all rows is needed; rows of one id stay in one range. A lone row is its own next, an
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    ids = rows.select("doc_id")
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    got = ids.agg(F.percentile_approx("doc_id", [*probs], 10_000).alias("b"), F.max("doc_id").alias("top")).first()
    bounds = [b for b in sorted(set(got.b or [])) if b < got.top]
    own = F.lit(0)
    if bounds:
        every = F.array(*(F.lit(b).cast("long") for b in bounds))
        own = F.coalesce(F.size(F.filter(every, lambda b: b < F.col("doc_id"))), F.lit(0))
    # what a range lacks is the first row of the next one: that of the bound's id, or of the highest id behind the lowest range
    ends = F.col("doc_id").eqNullSafe(F.lit(got.top).cast("long")) | (F.col("doc_id").isin(bounds) if bounds else F.lit(False))
    firsts = rows.filter(ends).groupBy("doc_id").agg(F.min(F.struct("text", "sketch")).alias("first")).select("doc_id", "first.text", "first.sketch")
    wraps = F.col("doc_id").eqNullSafe(F.lit(got.top).cast("long"))
    extra = firsts.select("*", F.when(wraps, F.lit(0)).otherwise(own + 1).cast("int").alias("bucket"), F.lit(True).alias("extra"), wraps.alias("wrap"))
    spread = rows.select("*", own.cast("int").alias("bucket"), F.lit(False).alias("extra"), F.lit(False).alias("wrap")).unionByName(extra)
    order = Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").desc_nulls_last(), "extra", "text")
    return spread.repartition(buckets, "bucket").withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("not extra").drop("bucket", "extra", "wrap")


def op4_fingerprint(spark, sf_dir):
    """Every document's fingerprint, that of its edited text and its likeness to both neighbours."""
    from .store import table

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    rows = with_next(fingerprints(table(spark, sf_dir, "documents")), 2 * n)
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), length - half), F.left(F.col("next_text"), half))
    made = rows.select("doc_id", length.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", word_hashes(F.col("edited")).alias("hashes"))
    made = made.select("doc_id", "n_chars", "edited_sha256", "sketch", "next_sketch", sketch(F.col("hashes")).alias("edited_sketch"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
