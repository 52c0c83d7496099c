"""Bottom-k fingerprints of shingle hashes, in DataFrame functions only (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barlight.session import removed, written, written_at

K = 128
WORDS = 5
#: Hashes keep their upper 48 bits: written as twelve hex digits, in order of size.
BITS = 48
#: A bucket of neighbours holds some BUCKET_ROWS rows; larger groups are split FAN ways, again and
#: again for up to LEVELS times: some FAN ** LEVELS buckets, two million, beyond which they grow.
BUCKET_ROWS = 1500
FAN = 128
LEVELS = 3
LEAST = -(1 << 63)


def hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct shingle hashes of a text, ascending (null text: as empty).

    Words are lower-cased runs of letters and digits. A text of fewer words than a shingle has
    one shingle of all its words; one without words has the whole text for a shingle, so that
    only empty texts have none.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = F.transform(parts, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(h) - words + 1),
            lambda i: F.xxhash64(*[F.get(h, i - 1 + j) for j in range(words)]),
        )
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).when(text != "", F.array(F.xxhash64(text)))
        return F.when(F.size(h) >= words, runs).otherwise(F.coalesce(whole, F.array().cast("array<bigint>")))

    # a one-element array keeps the word hashes from being computed for each use
    found = F.flatten(F.transform(F.array(each), shingled))
    return F.array_distinct(F.sort_array(F.transform(found, lambda x: F.shiftrightunsigned(x, 64 - BITS))))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes; fewer mean that these are all."""
    return F.slice(hashes(text, words), 1, k)


def merged(sketches: Column, k: int = K) -> Column:
    """The sketch of a union from an array of sketches: the k smallest of all."""
    return F.slice(F.array_distinct(F.sort_array(F.flatten(sketches))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest that both hold.

    Two empty sketches are alike (1), an empty and another are not (0).
    """
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    kth = (F.element_at(a, -1).cast("double") + 1) / float(1 << BITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and distinct counts."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0)))
    )


def as_text(a: Column) -> Column:
    """A sketch as a string: twelve hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def from_text(s: Column) -> Column:
    n = F.length(s) / (BITS // 4)
    at = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(s, (i - 1) * (BITS // 4) + 1, F.lit(BITS // 4)), 16, 10).cast("long"))


def _within(rows: DataFrame, split: DataFrame) -> DataFrame:
    """rows(__key, __tie, __bucket) in the finer buckets of a table of knots, which is sent to all tasks.

    It has a row of less than 2 FAN numbers for each bucket above BUCKET_ROWS rows, of no numbers
    for others: (2 FAN) ** (LEVELS - 1) rows at most.
    """
    value = F.when(F.col("__by_tie"), F.col("__tie")).otherwise(F.col("__key"))
    at = F.size(F.filter("__knots", lambda k: k <= F.col("__value")))
    finer = rows.join(F.broadcast(split), "__bucket").withColumn("__value", value)
    return finer.withColumn("__bucket", F.col("__bucket") * (2 * FAN) + at).drop("__knots", "__by_tie", "__value")


def _bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with __key, __tie and __bucket, ascending with both and of some BUCKET_ROWS rows each.

    Also these three columns alone, as a table. Bounds are quantiles of the ids, or of the ties where
    a group has one id only, taken group by group until all are small; the steps are the same for
    a table of any size. Null ids count as smallest. The tie is a hash of the text: rows that repeat
    id and text stay together.
    """
    keyed = docs.withColumns(
        {"__key": F.coalesce("doc_id", F.lit(LEAST)), "__tie": F.xxhash64("text"), "__bucket": F.lit(0).cast("long")}
    )
    keys, path = written_at(keyed.select("__key", "__tie", "__bucket"), "keys")
    q = [(i + 1) / FAN for i in range(FAN - 1)]
    for _ in range(LEVELS):
        groups = keys.groupBy("__bucket").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("__key").alias("low"),
            (F.min("__key") == F.max("__key")).alias("__by_tie"),
            F.percentile_approx("__key", q, 10_000).alias("k"),
            F.percentile_approx("__tie", q, 10_000).alias("t"),
        )
        # every s-th knot, for buckets of the wanted size
        s = F.greatest(F.lit(1), F.floor(F.lit(FAN * BUCKET_ROWS) / F.col("n")))
        knots = F.filter(F.when(F.col("__by_tie"), F.col("t")).otherwise(F.col("k")), lambda x, i: (i + 1) % s == 0)
        groups = groups.select("__bucket", "__by_tie", "low", "n", knots.alias("knots"))
        # an id that fills a bucket by itself also ends there
        own = F.filter("knots", lambda x, i: (x == F.get("knots", i - 1)) | ((x == F.col("low")) & ~F.col("__by_tie")))
        own = F.transform(own, lambda x: x + 1)
        none = F.array().cast("array<bigint>")
        knots = F.when(F.col("n") > BUCKET_ROWS, F.array_union("knots", own)).otherwise(none)
        split = written(groups.select("__bucket", "__by_tie", knots.alias("__knots")), "knots")
        keyed, before = _within(keyed, split), path
        keys, path = written_at(_within(keys, split), "keys")
        removed(docs.sparkSession, before)
    return keyed, keys


def with_next(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """docs(doc_id, text) by bucket, and the window in which the next row is the next document.

    The next document has the next smaller id; after the smallest comes the greatest. The first
    row of each bucket is also sent to the bucket before it (column __ghost), so neighbours
    meet without a global order; documents that share an id follow each other by a hash of the text.
    Bucket bounds are a broadcast table of four numbers a bucket.
    """
    placed, keys = _bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    up = Window.orderBy("__bucket")  # over the buckets, not over rows
    heads = (
        keys.groupBy("__bucket")
        .agg(F.max("__key").alias("__head"), F.max_by("__tie", F.struct("__key", "__tie")).alias("__head_tie"))
        .withColumn("__to", F.coalesce(F.lead("__bucket").over(up), F.min("__bucket").over(up)))
    )
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("__to").alias("b"), F.lit(1).alias("g"))
    first = (F.col("__key") == F.col("__head")) & (F.col("__tie") == F.col("__head_tie"))
    copies = F.when(first, F.array(own, ghost)).otherwise(F.array(own))
    sent = placed.join(F.broadcast(heads), "__bucket").select("doc_id", "text", "__key", "__tie", F.explode(copies).alias("c"))
    window = Window.partitionBy("__bucket").orderBy("__ghost", F.desc("__key"), F.desc("__tie"))
    return sent.select("doc_id", "text", "__key", "__tie", F.col("c.b").alias("__bucket"), F.col("c.g").alias("__ghost")), window


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and likeness of each pair.

    Edited: the last third of the code points gives way to as many from the start of the next
    document. Null texts are empty; repeated rows give repeated results; null ids come last;
    a single document is its own next; an empty table gives no rows; other columns aren't read.
    """
    rows, window = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substr(F.col("text"), F.lit(1), F.length("text") - third),
        F.substr(F.coalesce(F.col("__next"), F.lit("")), F.lit(1), third),
    )
    made = rows.withColumn("__next", F.lead("text").over(window)).select(
        "doc_id",
        "__bucket",
        "__ghost",
        "__key",
        "__tie",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, words).alias("sketch"),
        sketch(edited, k, words).alias("edited_sketch"),
    )
    # the same window again: no further exchange or sort
    return (
        made.withColumn("__next", F.lead("sketch").over(window))
        .filter("__ghost = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "sketch",
            "edited_sketch",
            resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
            resemblance(F.col("sketch"), F.col("__next"), k).alias("near_next"),
        )
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document of the table and of its edited text."""
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
