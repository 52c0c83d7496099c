"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import WordHasher, arrow_map, mix64, removed, shingles, slices, words_of, written, written_at

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: A task compares two blocks of a bucket; a block has about so many shingles and members.
BLOCK_SHINGLES = 1 << 20
BLOCK_MEMBERS = 1024
COLUMNS = 4096


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows that make pairs of this similarity candidates with this probability.

    Of the choices with at most `most` hashes, the one with the most rows a band: it brings the
    fewest candidates that are less alike.
    """
    best = (1, 1)
    for rows in range(1, 17):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, tag, key, size, bands: what is known of each text without its n-gram set.

    key is a 128-bit hash of the n-gram set; texts without a word take that of the text and are
    alike only if equal. tag is a hash of the text by which its row is found again.
    """
    rng = np.random.default_rng(20_240_501)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def made(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, 512):
                keys, sizes, found = [], [], []
                for text in part["text"]:
                    grams = shingles(hasher(words_of(text)), words)
                    keys.append(set_key(grams, text))
                    sizes.append(len(grams))
                    if not len(grams):
                        found.append(None)
                        continue
                    low = np.full(bands * rows, 2**64 - 1, np.uint64)
                    for i in range(0, len(grams), 1024):
                        np.minimum(low, (grams[i : i + 1024, None] * a + b).min(axis=0), out=low)
                    h = salt.copy()
                    for r in range(rows):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + low[r::rows])
                    found.append(h.view(np.int64).tolist())
                yield {"doc_id": part["doc_id"], "tag": part["tag"], "key": keys, "size": sizes, "bands": found}

    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return arrow_map(tagged, made, "doc_id long, tag long, key binary, size long, bands array<long>")


def set_key(grams: np.ndarray, text: str | None) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(grams.tobytes() if len(grams) else b"\0" + (text or "").encode("utf-8", "surrogatepass"))


#: A bitmap of wanted rows has 32 bits a row, within these bounds (8 KB and 16 MB).
BITMAP = (1 << 16, 1 << 27)
CHUNK = 1 << 16


def bitmap(tags: DataFrame) -> tuple[int, dict[int, bytes]]:
    """A bitmap of hashed (doc_id, tag) in chunks, and its size in bits: a first test of membership.

    Its size is bounded whatever the number of tags; a full one only lets more rows through.
    """
    bits = BITMAP[0]
    wanted = 32 * tags.count()
    while bits < min(wanted, BITMAP[1]):
        bits *= 2

    def made(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot in batch["slot"]:
                chunks.setdefault(slot // CHUNK, np.zeros(CHUNK, bool))[slot % CHUNK] = True
        yield {"chunk": list(chunks), "bits": [np.packbits(c).tobytes() for c in chunks.values()]}

    slots = tags.select(slot_of(F.col("tag"), bits).alias("slot")).distinct()
    # a chunk's slots meet in one task: at most CHUNK of them
    slots = slots.repartition(F.floor(F.col("slot") / CHUNK))
    found = arrow_map(slots, made, "chunk long, bits binary").collect()
    return bits, {r["chunk"]: bytes(r["bits"]) for r in found}


def slot_of(tag: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(tag, F.col("doc_id")), F.lit(bits))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, grams: the n-gram sets of the wanted rows, made anew from their texts.

    Rows outside the bitmap of wanted rows aren't read as text at all, so that only sets which
    are wanted (and few others) are shuffled; the join on key and id decides.
    """
    bits, chunks = bitmap(wanted.select("doc_id", "tag"))
    shared = docs.sparkSession.sparkContext.broadcast(chunks)

    def made(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        hasher = WordHasher()
        chunks = shared.value

        def there(slot: int) -> bool:
            chunk = chunks.get(slot // CHUNK)
            at = slot % CHUNK
            return chunk is not None and bool(chunk[at >> 3] & (128 >> (at & 7)))

        for batch in batches:
            for part in slices(batch, 512):
                rows = [i for i, s in enumerate(part["slot"]) if there(s)]
                grams = [shingles(hasher(words_of(part["text"][i])), words) for i in rows]
                yield {
                    "__id": [part["doc_id"][i] for i in rows],
                    "__key": [set_key(g, part["text"][i]) for g, i in zip(grams, rows, strict=True)],
                    "grams": [g.tobytes() for g in grams],
                }

    tagged = docs.select("doc_id", "text", slot_of(F.xxhash64("text"), bits).alias("slot"))
    made_sets = arrow_map(tagged, made, "__id long, __key binary, grams binary")
    least = wanted.select("key", F.col("doc_id").alias("__least"))
    found = made_sets.join(least, (F.col("__key") == F.col("key")) & F.col("__id").eqNullSafe(F.col("__least")))
    return found.select("key", "grams").dropDuplicates(["key"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets (of hashes), all left ones with all right ones.

    Only values in more than one set take part; they become columns of 0/1 matrices, a bounded
    number of columns at a time.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = times > 1
    number = np.cumsum(useful) - 1
    keep = useful[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n_left = len(left)
    out = np.zeros((n_left, len(sets) - n_left if right is not None else n_left), np.float32)
    total = int(useful.sum())
    for begin in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, total - begin)), np.float32)
        x[owner[lo:hi], column[lo:hi] - begin] = 1
        out += x[:n_left] @ (x[n_left:] if right is not None else x).T
    return out


def linked(
    left: list[dict], right: list[dict] | None, bucket: int, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which members of two blocks (or of one, right=None) are alike; a pair counts in one bucket.

    A pair that shares several buckets belongs to the least of them.
    """
    both = [[m["grams"] for m in side] for side in (left, right or [])]
    common = shared_counts(both[0], both[1] if right is not None else None)
    sizes = [np.array([len(g) for g in side], np.float32) for side in both]
    other = sizes[1] if right is not None else sizes[0]
    like = common >= similarity * (sizes[0][:, None] + other[None, :] - common) - 1e-3
    if right is None:
        np.fill_diagonal(like, False)
    if like.any():
        earlier = [[np.array([h for h in m["buckets"] if h < bucket], np.int64) for m in side] for side in (left, right or [])]
        if any(len(e) for side in earlier for e in side):
            like &= shared_counts(earlier[0], earlier[1] if right is not None else None) == 0
    return like, common


def spanning(like: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges (node, least node of its component) of the graph given by a link matrix.

    Nodes are numbered left then right; square: both sides are the same nodes.
    """
    rows, columns = like.shape
    label = np.arange(rows if square else rows + columns)
    right = label if square else label[rows:]
    none = len(label)
    while True:
        before = label.copy()
        right = label if square else label[rows:]
        low = np.where(like, right[None, :], none).min(axis=1, initial=none)
        label[:rows] = np.minimum(label[:rows], low)
        if not square:
            low = np.where(like, label[:rows, None], none).min(axis=0, initial=none)
            label[rows:] = np.minimum(label[rows:], low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return [(i, int(r)) for i, r in enumerate(label) if i != r]


def _compare(similarity: float):
    """Rows sorted by (bucket, lo, hi) to links per member and edges between members."""

    def result(group: list[dict], bucket: int, lo: int, hi: int) -> dict[str, list]:
        left = [m for m in group if m["block"] == lo]
        right = None if lo == hi else [m for m in group if m["block"] == hi]
        out: dict[str, list] = {"key": [], "root": [], "links": []}
        if not left or right == []:
            return out
        like, _ = linked(left, right, bucket, similarity)
        nodes = left + (right or [])
        copies = np.array([m["copies"] for m in nodes], np.int64)
        counts = like @ copies[len(left) :] if right is not None else like @ copies
        if right is not None:
            counts = np.concatenate([counts, like.T @ copies[: len(left)]])
        roots = dict(spanning(like, right is None))
        for i, n in enumerate(counts.tolist()):
            if n:
                out["key"].append(nodes[i]["key"])
                out["root"].append(nodes[roots.get(i, i)]["key"])
                out["links"].append(n)
        return out

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        at, group = None, []
        for batch in batches:
            columns = list(batch)
            for values in zip(*batch.values(), strict=True):
                m = dict(zip(columns, values, strict=True))
                here = (m["bucket"], m["lo"], m["hi"])
                if here != at:
                    if len(group) > 1:
                        yield result(group, *at)
                    at, group = here, []
                m["grams"] = np.frombuffer(m["grams"], np.uint64)
                group.append(m)
        if len(group) > 1:
            yield result(group, *at)

    return rows


def components(edges: DataFrame) -> DataFrame:
    """key, label for edges(key, root): the least key of each connected component.

    Labels fall along edges and are then replaced by their own labels, until none changes. Each
    round is written to the shared folder, and the one before it removed.
    """
    spark = edges.sparkSession
    pairs = edges.filter("key <> root").select("key", "root").distinct()
    both = written(pairs.unionByName(pairs.select(F.col("root").alias("key"), F.col("key").alias("root"))), "edges")
    start = both.groupBy("key").agg(F.min("root").alias("low")).select("key", F.least("key", "low").alias("label"))
    labels, path = written_at(start, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "root"), "root").groupBy("key").agg(F.min("label").alias("low"))
        lower = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        fallen = lower.join(jump, "label", "left")
        found = fallen.select("key", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        new, new_path = written_at(found, "labels")
        removed(spark, path)
        labels, path = new.select("key", "label"), new_path
        if new.filter("label <> old").isEmpty():
            return labels


def _solved(docs: DataFrame, similarity: float, words: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, tag, key), and their n-gram sets with class, links, copies and least document.

    Both are tables in the shared folder, so that a join of a much copied set with its documents is of
    plain exchanges, of which AQE splits the large partitions.
    """
    bands, rows = banding(similarity, recall)
    known = written(signatures(docs, bands, rows, words), "signatures")
    node = known.groupBy("key").agg(
        F.min(F.struct("doc_id", "tag")).alias("least"),
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
    )
    node = written(node.select("key", "least.*", "rep", "copies", "size", "bands"), "nodes")
    each = node.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = (
        each.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("size").alias("shingles"),
            F.bit_xor(F.xxhash64("key")).alias("x"),
            F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
        )
        .filter("members > 1")
        .groupBy("members", "shingles", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_MEMBERS))
    members = written(
        each.select("key", "bucket").join(buckets.select("bucket", blocks.cast("int").alias("blocks")), "bucket"), "members"
    )
    candidate = members.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
    wanted = node.join(candidate, "key").select("key", "doc_id", "tag", "copies", "buckets")
    wanted = written(wanted, "candidates")
    sets = _sets(docs, wanted.select("key", "doc_id", "tag"), words).join(
        wanted.select("key", "copies", "buckets"), "key"
    )
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = placed.select(
        "key",
        "bucket",
        "block",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
    )
    work = (
        placed.join(sets, "key")
        .select("bucket", "lo", "hi", "block", "key", "copies", "buckets", "grams")
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi")
    )
    found = written(arrow_map(work, _compare(similarity), "key binary, root binary, links long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found)
    classes = (
        node.select("key", "doc_id", "tag", "rep", "copies")
        .join(links, "key", "left")
        .join(labels, "key", "left")
        .select("key", "doc_id", "tag", "rep", "copies", "links", F.coalesce("label", "key").alias("label"))
    )
    least = classes.join(labels.select("label").distinct(), "label", "left_semi")
    least = least.groupBy("label").agg(F.min("rep").alias("class_rep"))
    classes = classes.join(least, "label", "left").select(
        "key",
        F.struct("doc_id", "tag").alias("least"),
        F.coalesce("class_rep", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        "copies",
        F.col("label").alias("class_key"),
    )
    return known.select("doc_id", "tag", "key"), written(classes, "classes")


def jaccard_classes(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """A row per document of docs(doc_id, text): class_id, links, copies, tag and class_key.

    Documents are linked when the Jaccard likeness of their sets of `words`-word runs is at least
    `similarity`; links counts the documents linked to this one, copies included, class_id is
    the least doc_id of the connected class, copies how many documents have this n-gram set, tag a
    hash of the text, class_key the class's own name, which tells classes of null ids apart. Copies
    are joined once, as one set. Texts of fewer words are one run; texts without words (null and
    empty ones too) are alike only if equal. Rows with null or repeated ids count as documents
    of their own; a class of null ids has a null class_id. An empty table gives no rows.

    Only documents in a shared band bucket are compared, in pairs of bounded blocks of a bucket, and
    only counts and a spanning forest leave a task: no list of pairs is made, whatever the size
    of a group. Buckets with the same members are compared once. A bucket of m different sets costs
    m^2 / 2 comparisons, as links are exact; each set goes to m / BLOCK_MEMBERS tasks.
    """
    known, classes = _solved(docs, similarity, words, recall)
    return known.join(classes, "key").select("doc_id", "class_id", "links", "copies", "tag", "class_key")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id and tag (a hash of the text) of the least document of each class of near copies, nulls least.

    Classes are those of jaccard_classes; they are taken from n-gram sets, not from all documents.
    """
    classes = _solved(docs, similarity, words, recall)[1]
    return classes.groupBy("class_key").agg(F.min("least").alias("least")).select("least.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    found = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "links", "copies")
