"""Bottom-k fingerprints of documents (op7), with DataFrame functions only.

A fingerprint is the ``k`` smallest distinct 64-bit hashes of a text's shingles (``width`` words apart by ASCII
white space; a text with fewer words is one shingle, one without words has an empty fingerprint). Two
fingerprints merge into that of both texts together, and give their resemblance, how far one is contained in
the other, and the number of distinct shingles.

null text: as empty. Two empty fingerprints have likeness 1, an empty and another 0. Equal texts have equal
fingerprints. Repeated rows and equal doc_ids: each row for itself, in the order of doc_id, then text; a null
doc_id comes first. Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, read_table, text_col

K, WIDTH = 128, 5
#: Bytes of text of a range of doc_ids, and most ranges.
RANGE_BYTES, RANGES = 64 << 20, 1 << 13
SPACE = "[\\x20\\x09-\\x0D]+"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the column ``out``: the sorted ``k`` least shingle hashes of the column ``text`` (no nulls)."""
    words_, shingles_ = free_names(df, "words", "shingles")
    words = F.transform(F.filter(F.split(F.col(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn(words_, words)
    shingle = lambda i: F.xxhash64(*[F.col(words_)[i + j] for j in range(width)])
    some = F.when(F.size(words_) >= width, F.transform(F.sequence(F.lit(0), F.size(words_) - width), shingle))
    few = F.when(F.size(words_) > 0, F.array(F.xxhash64(words_))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(shingles_, F.coalesce(some, few)).drop(words_)
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles_)), 1, k)).drop(shingles_)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: how much of the merged fingerprint both hold."""
    both = F.size(F.array_intersect(F.array_intersect(merged(a, b, k), a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1), F.least(F.lit(k), F.size(F.array_union(a, b)))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, F.lit(k)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (an empty a: 1)."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(F.lit(1.0), distinct_shingles(a, k))))


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One fingerprint per group of ``keys``. Hashes are counted apart before they meet, so that a group with
    many parts is merged by many tasks, each of which gives out at most ``k`` hashes for a group."""
    spread = df.select(*keys, F.pmod(F.xxhash64(sketch), F.lit(256)).alias("_part"), F.explode_outer(sketch).alias("_hash"))
    least = lambda by: Window.partitionBy(*by).orderBy("_hash")
    for by in ([*keys, "_part"], keys):
        spread = spread.select(*by, "_hash").distinct().withColumn("_n", F.row_number().over(least(by))).where(F.col("_n") <= k)
    return spread.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("_hash")), 1, k).alias(sketch))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_range(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """``df`` with ``_range``, the number of its range of ``key`` (about equal in rows; at least ``parts``, more where they
    would be of over ``RANGE_BYTES``), and (range, least key) of each."""
    size = sum(F.octet_length(c) for c, t in df.dtypes if t == "string")
    most = max(parts, RANGES)
    ends, total = df.agg(F.percentile_approx(key, [i / most for i in range(1, most)], 4 * most), F.sum(size)).first()
    parts = max(parts, min(most, (total or 0) // RANGE_BYTES))
    ends = sorted({x for i, x in enumerate(ends or []) if (i + 1) * parts // most != i * parts // most})
    step = isqrt(len(ends)) + 1
    all_, coarse = F.lit(ends).cast("array<bigint>"), F.lit(ends[step - 1 :: step]).cast("array<bigint>")
    c = F.size(F.filter(coarse, lambda x: x <= F.col("_key")))
    number = F.when(F.col("_key").isNull(), F.lit(0)).otherwise(F.col("_coarse") * step + F.size(F.filter(F.slice(all_, F.col("_coarse") * step + 1, step), lambda x: x <= F.col("_key"))))
    keyed = df.withColumn("_key", F.col(key)).withColumn("_coarse", F.when(F.col("_key").isNull(), F.lit(0)).otherwise(c)).withColumn("_range", number.cast("int")).drop("_coarse", "_key")
    firsts = keyed.groupBy("_range").agg(F.min(key).alias("k"), F.count(key).alias("n"), F.count(F.lit(1)).alias("m")).collect()  # a row per range
    return keyed, sorted((r["_range"], None if r["n"] < r["m"] else r["k"]) for r in firsts)


def with_next(df: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """``df`` with ``next_<c>``: the column of the next row in the order of (key, columns); after the last, the first.

    Rows are dealt by range of the key. Each range also gets the row that begins the next one, so no range
    has to see another and no task sees the whole order.
    """
    ranged, firsts = with_range(df.select(key, *columns), key, parts)
    if not firsts:
        firsts = [(0, None)]
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    heads = ranged.where(F.col(key).isin([k for k in before if k is not None]) | (F.col(key).isNull() if None in before else F.lit(False)))
    to = F.create_map(*[x for k, r in before.items() if k is not None for x in (F.lit(k).cast("bigint"), F.lit(r))]) if any(k is not None for k in before) else None
    place = F.lit(before.get(None, 0)) if to is None else F.when(F.col(key).isNull(), F.lit(before.get(None, 0))).otherwise(to[F.col(key).cast("bigint")])
    rows = ranged.withColumn("_extra", F.lit(0)).unionByName(heads.withColumn("_range", place.cast("int")).withColumn("_extra", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_extra", F.col(key).asc_nulls_first(), *columns)
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_extra = 0").drop("_extra", "_range")


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, text, sketch of every document."""
    return with_sketch(docs.select("doc_id", text_col().alias("text")), "text", "sketch", k, width)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = with_next(fingerprints(read_table(spark, sf_dir, "documents")), "doc_id", ["text", "sketch"], parts)
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), (F.col("n_chars") - kept).cast("int")))
    docs = docs.withColumn("edited", edited).drop("text", "next_text")
    docs = with_sketch(docs, "edited", "edited_sketch")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
