"""Bottom-k sketches of word shingles, in DataFrame functions only.

A text's fingerprint is the k least hashes of its distinct five-word shingles (lower-cased, words
parted by ASCII white space; a shorter text is one shingle). Fingerprints of
parts merge into that of the whole, and estimate resemblance, containment and the distinct shingle count.

Defined cases: null counts as empty; a text without words has an empty fingerprint, like itself
(likeness 1) and unlike any other (0); equal texts have equal fingerprints; rows of equal id are neighbours in the order
of their texts; a null id sorts after all others; an empty table gives an empty result; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import table

K = 128
SIZE = 5
SPACE = "[ \\t-\\r]+"
#: Ranges of ids at most: their bounds stand in the plan. Beyond it ranges grow, and their sorts spill.
RANGES = 16_384
#: Hashes are signed 64-bit integers; this is their number.
RANGE = 2.0**64


def sketch(text: Column, k: int = K, size: int = SIZE) -> Column:
    """array<bigint>: the k least distinct shingle hashes in order."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.transform(F.array(words), lambda w: _least(w, k, size))[0]


def _least(w: Column, k: int, size: int) -> Column:
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(size))))
    whole = F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    none = F.expr("cast(array() as array<bigint>)")
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= size, runs).when(n > 0, whole).otherwise(none))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    both = merge(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (F.element_at(a, -1).cast("double") / RANGE + 0.5))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): the next row in descending order of the id, the first after the last.

    Rows are dealt out by ranges of the id whose bounds are ids themselves: the greatest of each range. A bound's row goes
    to the range above as well, at the end, where it is the next row of the least there. So whole texts are shuffled once and no task has all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(RANGES, 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n)], min(20 * n, 100_000)).alias("q"), F.max("key").alias("top")).first()
    bounds = sorted({*(cuts["q"] or []), *([cuts["top"]] if cuts["top"] is not None else [0])})
    # Two levels of search keep the number of comparisons at the root of the number of ranges.
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*(F.lit(g[-1]) for g in groups))
    fine = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    coarse = F.size(F.filter(tops, lambda b: b < F.col("key")))
    inner = F.size(F.filter(F.get(fine, coarse), lambda b: b < F.col("key")))
    rows = rows.withColumn("range", (coarse * step + inner).cast("int"))
    is_bound = F.array_contains(F.get(fine, coarse), F.col("key"))
    homes = F.when(is_bound, F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(((F.col("range") + 1) % len(bounds)).alias("range"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))
    )
    dealt = rows.select("id", "key", "text", F.explode(homes).alias("h")).select("id", "key", "text", "h.range", "h.guest").repartition("range")
    dealt = dealt.withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    return dealt.select("id", "text", "sketch", "guest", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")).filter("not guest").drop("guest")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of all documents."""
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("*", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )
