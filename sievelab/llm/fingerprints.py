"""Bottom-k sketches of word shingle hashes, made, merged and compared by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelab.llm.common import LONG_MIN, bucket_of, cut_points, full_text

K = 128
SHINGLE_WORDS = 5
ROWS_PER_BUCKET = 2_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(words: Column, k: int, size: int) -> Column:
    """The k smallest distinct shingle hashes, ascending; a shorter text is one shingle, an empty one has none.

    ``words`` must be a column and not an expression: it is read for every shingle.
    """
    n = F.size(words)
    shingles = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    )
    hashes = F.when(n >= size, shingles).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    return df.withColumn("__words", word_hashes(text)).withColumn(name, sketch_of(F.col("__words"), k, size)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; exact for sets below k. Two empty sets are alike."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; an empty a is contained in anything."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(df: DataFrame, by: list[str], sketch: str, k: int = K, parts: int = 64) -> DataFrame:
    """One sketch per group of ``by`` from the sketches of its rows, for instance of the parts of a text.

    Every part of a group first keeps its own k smallest hashes, so a group holding most rows is many tasks.
    """
    hashes = df.select(*by, F.explode(sketch).alias("__h")).withColumn("__p", F.pmod(F.xxhash64("__h"), F.lit(parts)))

    def smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))
        return rows.withColumn("__n", order).filter(F.col("__n") <= k).drop("__n")

    kept = smallest(smallest(hashes.groupBy(*by, "__p", "__h").agg(F.count("*").alias("__c")), [*by, "__p"]), by)
    grouped = kept.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch))
    keys = df.select(*by).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    empty = F.array().cast("array<bigint>")
    return (
        keys.alias("a")
        .join(grouped.alias("b"), same, "left")
        .select(*[F.col(f"a.{c}") for c in by], F.coalesce(F.col(f"b.{sketch}"), empty).alias(sketch))
    )


def fingerprint_documents(
    docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to it and to the next document.

    Edited: the last half of the code points replaced by the first as many of the next document in ascending doc_id, the
    first one after the last. Null texts are empty; null ids come first; equal ids go by their text. Documents are dealt
    into ranges of the id, and each range's first rows also go to the range before, so the next row is found without a
    global order. The text is shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN))
    cuts = cut_points(docs, key, rows_per_bucket) or [0]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("__key"), full_text().alias("__text"))
    base = base.withColumn("__bucket", bucket_of(F.col("__key"), cuts))
    before = F.when(F.col("__bucket") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("__bucket") - 1)
    starts = F.array(*[F.lit(c) for c in cuts])
    opens = F.get(starts, F.col("__bucket")) == F.col("__key")
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("copy")))
    copied = F.array(F.struct(before.cast("int").alias("b"), F.lit(1).alias("copy")))
    dealt = base.withColumn("__to", F.explode(F.when(opens, F.concat(places, copied)).otherwise(places)))
    # columns and not fields, else the second window does not see that the first one's partitions are its own
    dealt = dealt.select("doc_id", "__key", "__text", F.col("__to.b").alias("__range"), F.col("__to.copy").alias("__copy"))

    order = Window.partitionBy("__range").orderBy("__copy", "__key", "__text")
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    rows = (
        dealt.withColumn("__next", F.coalesce(F.lead("__text").over(order), F.lit("")))
        .withColumn("n_chars", n.cast("long"))
        .withColumn(
            "__edited", F.concat(F.substring("__text", F.lit(1), n - half), F.substring("__next", F.lit(1), half))
        )
    )
    rows = with_sketch(rows, F.col("__text"), "__sketch", k, size)
    rows = with_sketch(rows, F.col("__edited"), "__edited_sketch", k, size)
    rows = rows.withColumn("__next_sketch", F.lead("__sketch").over(order)).filter(F.col("__copy") == 0)
    a, e, b = F.col("__sketch"), F.col("__edited_sketch"), F.col("__next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"),
        resemblance(a, b, k).alias("near_next"),
        distinct_count(a, k).alias("distinct_shingles"),
        containment(a, e, k).alias("contained_in_edited"),
    )
