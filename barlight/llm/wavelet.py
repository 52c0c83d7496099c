"""Token ids as wavelet matrices, one compressed shard per run of documents (operator 2).

A shard holds the ids of whole documents in ascending doc_id order as one succinct bit plane per
id bit, most significant first. Rank and select on the planes give token access, counting and
occurrence lookup without decoding the shard: planes are compressed in chunks, and a question
inflates the chunks that it looks at, two a plane at most for a token, a count or an occurrence.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import arrow_map, shared_dir, slices
from barlight.llm.tokens import default_tokenizer, encoder

MAGIC = b"WVMX0002"
BLOCK = 512  # bits between stored ranks
CHUNK = 64 * BLOCK  # bits that are compressed together
HELD = 16  # inflated chunks that a stored plane remembers
SHARD_TOKENS = 1 << 17


class Plane:
    """A bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray, n: int, ranks: np.ndarray | None = None) -> None:
        self.bytes, self.n = bits, n
        self.words = np.frombuffer(bits.tobytes() + bytes(-len(bits) % 8), "<u8")
        if ranks is None:
            counts = np.bitwise_count(self.words).astype(np.uint32)
            counts = np.pad(counts, (0, -len(counts) % (BLOCK // 64))).reshape(-1, BLOCK // 64).sum(1)
            ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        self.ranks = ranks

    @property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.bytes[i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i (0 to n)."""
        i = np.asarray(i, np.int64)
        block = i // BLOCK
        out = self.ranks[block].astype(np.int64)
        first = block * (BLOCK // 64)
        for k in range(BLOCK // 64):
            at = first + k
            left = np.clip(i - at * 64, 0, 64)
            word = self.words[np.minimum(at, len(self.words) - 1)] if len(self.words) else np.zeros(i.shape, np.uint64)
            mask = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(word & mask)
        return out

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        ranks = self.ranks.astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        begin = block * BLOCK
        part = np.unpackbits(self.bytes[begin // 8 : (begin + BLOCK) // 8], bitorder="little")[: self.n - begin]
        return begin + int(np.flatnonzero(part == bit)[k - int(ranks[block])])

    def select_all(self, bit: int, ks: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bits == bool(bit))[ks]


class StoredPlane:
    """A bit vector in compressed chunks, of which only those in question are inflated.

    `ones` counts the ones before each chunk, and all in the end; `inflated` the bytes inflated so far.
    """

    def __init__(self, n: int, ones: np.ndarray, chunks: list[memoryview], expand: Callable[[memoryview], bytes]) -> None:
        self.n, self.ones, self.chunks, self.expand = n, ones.astype(np.int64), chunks, expand
        self.starts = np.minimum(np.arange(len(ones)) * CHUNK, n)
        self.held: dict[int, Plane] = {}
        self.inflated = 0

    def _opened(self, c: int) -> bytes:
        out = self.expand(self.chunks[c])
        self.inflated += len(out)
        return out

    def chunk(self, c: int) -> Plane:
        if c not in self.held:
            if len(self.held) >= HELD:
                self.held.pop(next(iter(self.held)))
            size = int(self.starts[c + 1] - self.starts[c])
            out = self._opened(c)
            ranks = np.frombuffer(out, "<u2", -(-size // BLOCK) + 1)
            self.held[c] = Plane(np.frombuffer(out, np.uint8, offset=ranks.nbytes), size, ranks)
        return self.held[c]

    @property
    def bits(self) -> np.ndarray:
        parts = []
        for c in range(len(self.chunks)):
            ranks = 2 * (-(-int(self.starts[c + 1] - self.starts[c]) // BLOCK) + 1)
            parts.append(self._opened(c)[ranks:])
        return np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), count=self.n, bitorder="little").view(bool)

    def _each(self, at: np.ndarray, out: np.ndarray, found: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        """out, where what is found in chunk at[..] is added."""
        for c in np.unique(at).tolist():
            here = at == c
            out[here] += found(c, here)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return self._each(i // CHUNK, np.zeros(i.shape, np.int64), lambda c, here: self.chunk(c).get(i[here] % CHUNK))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i (0 to n)."""
        i = np.asarray(i, np.int64)
        out = self.ones[i // CHUNK]
        inside = np.where(i % CHUNK > 0, i // CHUNK, -1)

        def found(c: int, here: np.ndarray) -> np.ndarray:
            return self.chunk(c).rank1(i[here] % CHUNK) if c >= 0 else np.zeros(int(here.sum()), np.int64)

        return self._each(inside, out, found)

    def _before(self, bit: int) -> np.ndarray:
        return self.ones if bit else self.starts - self.ones

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        before = self._before(bit)
        c = int(np.searchsorted(before, k, "right")) - 1
        return int(self.starts[c]) + self.chunk(c).select(bit, k - int(before[c]))

    def select_all(self, bit: int, ks: np.ndarray) -> np.ndarray:
        before = self._before(bit)
        at = np.searchsorted(before, ks, "right") - 1
        return self._each(at, self.starts[at], lambda c, here: self.chunk(c).select_all(bit, ks[here] - before[c]))


class WaveletMatrix:
    """ids of at most `width` bits as planes; after each plane zeros come before ones, in order."""

    def __init__(self, n: int, planes: list[Plane] | list[StoredPlane], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        order = np.ascontiguousarray(ids, np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(width - 1, -1, -1):
            ones = (order & order.dtype.type(1 << shift)).astype(bool)
            planes.append(Plane(np.packbits(ones, bitorder="little"), len(order)))
            low = order.compress(~ones)
            zeros.append(len(low))
            order = np.concatenate([low, order.compress(ones)])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order, the stable partitions undone from the last plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = self.planes[level].bits
            up = np.empty_like(out)
            up[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            up[np.flatnonzero(ones)] = out[self.zeros[level] :] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = up
        return out

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        i = np.asarray(positions, np.int64)
        out = np.zeros(i.shape, np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i).astype(np.int64)
            ones = plane.rank1(i)
            i = np.where(bit == 1, zeros + ones, i - ones)
            out = out * 2 + bit
        return out

    def _range(self, symbol: int, begin: int, end: int) -> tuple[int, int]:
        if symbol >> len(self.planes):
            return 0, 0
        ends = np.array([begin, end], np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank1(ends)
            ends = zeros + ones if symbol >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, symbol: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [begin, end)."""
        low, high = self._range(symbol, begin, self.n if end is None else end)
        return high - low

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id; IndexError beyond the last."""
        low, high = self._range(symbol, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(f"{high - low} occurrences")
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].select(bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of an id in [begin, end), ascending: select of all of them, plane by plane."""
        i = np.arange(*self._range(symbol, begin, self.n if end is None else end))
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            if len(i):
                i = self.planes[level].select_all(bit, i - self.zeros[level] if bit else i)
        return i


def to_bytes(doc_ids: list[int | None], lengths: list[int], matrix: WaveletMatrix) -> bytes:
    """The shard file: header, directory, document table, then the chunks of each plane, compressed one by one.

    The directory has the size of each chunk and the ones before it; a chunk has its own ranks.
    """
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids])
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    table = squeeze(known.tobytes() + ids.tobytes() + np.array(lengths, "<i8").tobytes())
    sizes, ones, parts = [], [], []
    for p in matrix.planes:
        for begin in range(0, p.n, CHUNK):
            end = min(begin + CHUNK, p.n)
            ranks = p.ranks[begin // BLOCK : -(-end // BLOCK) + 1]
            parts.append(squeeze((ranks - ranks[0]).astype("<u2").tobytes() + p.bytes[begin // 8 : -(-end // 8)].tobytes()))
            sizes.append(len(parts[-1]))
            ones.append(int(ranks[0]))
        ones.append(int(p.ranks[-1]))
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<QQIQ", len(doc_ids), matrix.n, len(matrix.planes), len(table)))
    out.write(np.array(matrix.zeros, "<u8").tobytes() + np.array(sizes, "<u4").tobytes() + np.array(ones, "<u8").tobytes())
    out.write(table + b"".join(parts))
    return out.getvalue()


def opened(blob: bytes) -> tuple[Callable[[], tuple[list[int | None], list[int]]], WaveletMatrix]:
    """A shard's wavelet matrix, of which nothing is inflated yet, and a function that reads its document table."""
    import zstandard

    if blob[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    expand = zstandard.ZstdDecompressor().decompress
    docs, n, width, table = struct.unpack_from("<QQIQ", blob, 8)
    chunks = -(-n // CHUNK)
    at = 36
    zeros = np.frombuffer(blob, "<u8", width, at).tolist()
    sizes = np.frombuffer(blob, "<u4", width * chunks, at + 8 * width).tolist()
    at += 8 * width + 4 * width * chunks
    ones = np.frombuffer(blob, "<u8", width * (chunks + 1), at).reshape(width, chunks + 1)
    at += 8 * width * (chunks + 1)
    view = memoryview(blob)
    begin = at
    ends = (at + table + np.cumsum([0, *sizes])).tolist()
    parts = [view[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    planes = [StoredPlane(n, ones[i], parts[i * chunks : (i + 1) * chunks], expand) for i in range(width)]

    def documents() -> tuple[list[int | None], list[int]]:
        raw = expand(view[begin : begin + table])
        known = np.frombuffer(raw, bool, docs)
        ids = np.frombuffer(raw, "<i8", docs, docs).tolist()
        return [i if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(raw, "<i8", docs, docs * 9).tolist()

    return documents, WaveletMatrix(n, planes, zeros)


def from_bytes(blob: bytes) -> tuple[list[int | None], list[int], WaveletMatrix]:
    """Open a shard: its doc_ids, their token counts and the wavelet matrix."""
    documents, matrix = opened(blob)
    return *documents(), matrix


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    shard_tokens: int = SHARD_TOKENS,
    partitions: int | None = None,
) -> None:
    """Write docs(doc_id, text) as shards in ascending doc_id order (nulls first).

    Rows of a Parquet table carry the shard files, so that any store that Spark writes to will do
    and a task that runs twice is committed once. A document is never split: a shard ends with
    the document that reaches `shard_tokens`. Null texts are empty; repeated doc_ids keep a row
    each, in the order of a hash of the text; rows that repeat both are told apart by a seeded
    number, so that any much-repeated id, null too, is dealt to several ranges. Other columns are
    not read; an empty table gives an empty folder table.
    """
    tokenizer = tokenizer or default_tokenizer()

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        encode = encoder(tokenizer, end_id)
        bits = (max(encode.vocabulary, end_id + 1) - 1).bit_length()
        part, begin, number = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> dict[str, list]:
            nonlocal begin, number, size
            lengths = [len(p) // 4 for p in parts]
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4"), bits)
            out = {"part": [part], "shard": [number], "begin": [begin], "n_tokens": [size], "blob": [to_bytes(ids, lengths, matrix)]}
            begin, number, size = begin + size, number + 1, 0
            ids.clear()
            parts.clear()
            return out

        for batch in batches:
            for some in slices(batch, 64):
                for doc_id, tokens in zip(some["doc_id"], encode(some["text"]), strict=True):
                    ids.append(doc_id)
                    parts.append(tokens)
                    size += len(tokens) // 4
                    if size >= shard_tokens:
                        yield flush()
        if parts:
            yield flush()

        encode.forget()

    n = partitions or max(1, docs.rdd.getNumPartitions())
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.rand(29).alias("salt"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("salt")]
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = arrow_map(ordered, rows, "part int, shard int, begin long, n_tokens long, blob binary")
    # blobs are compressed already; small row groups keep a reader's memory low
    shards.write.option("compression", "none").option("parquet.block.size", 8 << 20).option(
        "parquet.block.size.row.check.min", 8
    ).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document, decoded."""

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        for batch in batches:
            for part, begin, blob in zip(batch["part"], batch["begin"], batch["blob"], strict=True):
                doc_ids, lengths, matrix = from_bytes(blob)
                ids = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths).tolist()
                starts = [e - n for e, n in zip(ends, lengths, strict=True)]
                yield {
                    "doc_id": doc_ids,
                    "part": [part] * len(doc_ids),
                    "local": [begin + s for s in starts],
                    "n_tokens": lengths,
                    "ids": [ids[4 * s : 4 * e] for s, e in zip(starts, ends, strict=True)],
                }

    shards = spark.read.parquet(path)
    # one row per partition of the writer: thousands at most, whatever the input, so it is sent to all tasks
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select(
        "part",
        F.coalesce(
            F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    read = arrow_map(
        shards.select("part", "begin", "blob"), rows, "doc_id long, part int, local long, n_tokens long, ids binary"
    )
    return read.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids"
    )


def count_ids(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id and n, how often each of these ids occurs in the shards: counted on the compressed files, 0 where it doesn't."""
    wanted = sorted(set(ids))

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        for batch in batches:
            for blob in batch["blob"]:
                matrix = opened(blob)[1]
                yield {"id": wanted, "n": [matrix.count(i) for i in wanted]}

    found = arrow_map(spark.read.parquet(path).select("blob"), rows, "id long, n long")
    none = spark.createDataFrame([(i, 0) for i in wanted], "id long, n long")
    return found.unionByName(none).groupBy("id").agg(F.sum("n").alias("n"))


def find_ids(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, doc_id and position (tokens of the document before it) of every occurrence of these ids.

    Looked up in the compressed files; the document table of a shard is read only where one is found.
    """
    wanted = sorted(set(ids))

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        for batch in batches:
            for blob in batch["blob"]:
                documents, matrix = opened(blob)
                doc_ids = ends = None
                for i in wanted:
                    at = matrix.occurrences(i)
                    if not len(at):
                        continue
                    if ends is None:
                        doc_ids, lengths = documents()
                        ends = np.cumsum(lengths)
                        starts = ends - lengths
                    doc = np.searchsorted(ends, at, "right")
                    yield {"id": [i] * len(at), "doc_id": [doc_ids[d] for d in doc.tolist()], "position": (at - starts[doc]).tolist()}

    return arrow_map(spark.read.parquet(path).select("blob"), rows, "id long, doc_id long, position long")


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to wavelet shards and read back; a row per document."""
    path = shared_dir(spark, "wavelet")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
