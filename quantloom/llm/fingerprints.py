"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the ascending array of the K least distinct 48-bit hashes of a text's shingles of five words (fewer words:
the whole sequence is the one shingle; none: an empty sketch). Sketches of parts merge into the sketch of the whole,
and estimate resemblance, containment and the number of distinct shingles; with fewer than K shingles all are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE, HASH_BITS = 128, 5, 48
#: Bound on the doc_ids that cut the order of documents into ranges.
MAX_RANGES = 1 << 16


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """array<long> of a text; a null text counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return sketch_of_hashes(F.transform(words, lambda w: F.xxhash64(w)), k, width)


def sketch_of_hashes(h: Column, k: int = K, width: int = SHINGLE) -> Column:
    """array<long> from the hashes of a text's words in order."""
    drop = 64 - HASH_BITS
    cut = lambda x: F.shiftrightunsigned(x, drop)
    # the inner lambda binds the array once, so that words are hashed once
    body = lambda a: F.when(F.size(a) == 0, F.slice(a, 1, 0)).when(F.size(a) < width, F.array(cut(F.xxhash64(a)))).otherwise(
        F.slice(F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: cut(F.xxhash64(*(F.get(a, i + j) for j in range(width))))))), 1, k)
    )
    return F.get(F.transform(F.array(h), body), 0)


def packed(sk: Column) -> Column:
    """A sketch as a string: base64 of its hashes, six bytes each."""
    joined = F.array_join(F.transform(sk, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")
    return F.translate(F.base64(F.unhex(joined)), "\r\n", "")


def _union(a: Column, b: Column, k: int) -> Column:
    both = F.array_union(a, b)
    return F.when((F.size(a) < k) & (F.size(b) < k), both).otherwise(F.slice(F.sort_array(both), 1, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches' texts, 0 to 1; of two empty ones 1, of an empty and another 0."""
    u = _union(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.size(u))


def distinct_shingles(sk: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    return F.when(F.size(sk) < k, F.size(sk).cast("double")).otherwise((k - 1) * F.lit(2.0**HASH_BITS) / F.element_at(sk, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in anything."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge(parts: DataFrame, keys: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """keys, col: the sketch of each key's parts taken together. Parts of one key are reduced hash by hash, so that
    no key's parts meet in one task before they are distinct; null sketches count as empty."""
    each = parts.select(*keys, F.explode_outer(col).alias("_h")).distinct()
    low = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))).where(f"_r <= {k}")
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(col))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts (ascending) that are at most doc_id, by bisection; nulls are below all."""
    if not cuts:
        return F.lit(0)
    a, n = F.lit(cuts), len(cuts)
    step = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
        F.when(F.get(a, F.shiftright(s.lo + s.hi, 1)) <= doc_id, F.struct((F.shiftright(s.lo + s.hi, 1) + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), F.shiftright(s.lo + s.hi, 1).alias("hi")))
    )
    end = F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step)
    return F.when(doc_id.isNull(), 0).otherwise(end.lo)


def with_next(docs: DataFrame, rows_a_range: int = 512, finish=lambda d: d) -> DataFrame:
    """id, text, next_text and what finish adds: every row with the next one by descending doc_id (after the last
    the first; of one row itself). Null doc_ids come last; rows of one doc_id are in the order of their texts' hashes.

    The order is cut into ranges at a bounded sample of doc_ids (at most MAX_RANGES), each row is shuffled once to its
    range, and a guest row from the range below closes each. finish: columns to add before the window, which must
    keep id, text and the columns that start with an underscore; they come back as they are and as next_<name>."""
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select("id")
    n = ids.count()
    want = min(MAX_RANGES, n // rows_a_range)
    cuts = sorted({r[0] for r in ids.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(want).collect()}) if want else []
    ranged = ids.withColumn("_range", _range_of(F.col("id"), cuts))
    tops = ranged.groupBy("_range").agg(F.max("id").alias("id")).collect()  # a row a range
    tops = sorted((r["_range"], r["id"]) for r in tops)
    above = {low: high for (low, _), (high, _) in zip(tops, tops[1:], strict=False)} | ({tops[-1][0]: tops[0][0]} if tops else {})
    spark = docs.sparkSession
    guests = spark.createDataFrame([(top, above[r]) for r, top in tops], "top long, _range int")
    first = base.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("top"))).groupBy("top", "_range").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    first = first.select(F.col("top").alias("id"), "text", "_range", F.lit(1).alias("_guest"))
    rows = base.withColumns({"_range": _range_of(F.col("id"), cuts), "_guest": F.lit(0)}).unionByName(first)
    rows = finish(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_range"))
    w = Window.partitionBy("_range").orderBy("_guest", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    more = [c for c in rows.columns if not c.startswith("_") and c != "id"]
    out = rows.select("id", "_guest", *more, *(F.lead(c).over(w).alias(f"next_{c}") for c in more))
    return out.where("_guest = 0").drop("_guest")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; then containment of
    the text in the edited one and the estimated number of its distinct shingles. One row for each row of docs."""
    pairs = with_next(docs, finish=lambda d: d.withColumn("sketch", sketch(F.col("text"), k)))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(next_text, half)"))
    pairs = pairs.withColumn("n_chars", n).withColumn("half", half).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited"), k))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(a).alias("fingerprint"),
        packed(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"),
        containment(a, b, k).alias("contained_in_edited"),
        distinct_shingles(a, k).alias("distinct_shingles"),
    )
