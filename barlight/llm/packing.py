"""Hierarchical multi-length packing of tokenised documents (operator 1).

Documents are routed to context-size tiers by length, each tier is packed into windows of its
size, gaps of long windows are filled from shorter tiers, and windows are dealt to step groups
of near-equal token counts. Packing is local to a task's stream of rows: no shuffle, no group
that grows with the data, and a lost task is simply run again on its own split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import arrow_map, slices
from barlight.llm.tokens import default_tokenizer, encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 16
#: About so many pieces go out at a time.
OUT_PIECES = 512
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


class Pool:
    """Pieces by length; the longest one under a bound is found in a bit mask of lengths."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def add(self, length: int, piece: tuple[int, int]) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.mask |= 1 << length

    def longest(self, bound: int) -> int:
        """The greatest length up to bound, 0 if there is none."""
        return max((self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1, 0)

    def shortest_over(self, bound: int) -> int:
        above = self.mask >> (bound + 1)
        return (above & -above).bit_length() + bound if above else 0

    def take(self, length: int) -> tuple[int, int]:
        at = self.by_length[length]
        piece = at.pop()
        if not at:
            self.mask ^= 1 << length
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list, list]:
    """Windows of pieces for documents of these lengths, and the pieces left over.

    A window is (tier, [(document, start, length)]). Whole windows of the largest tier are cut
    from the front of long documents; the rest of each goes to the smallest tier that holds it.
    Every window but the last ones is exactly full: its gap takes the longest fitting pieces of
    shorter tiers, and at last the head of a longer piece. What can't fill a window is returned,
    or with last=True cut into windows of powers of two, with under 32 tokens in one short window.
    """
    top = tiers[-1]
    pool, windows = Pool(), []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= top:
            windows.append((top, [(d, start, top)]))
            start += top
        if n > start:
            pool.add(n - start, (d, start))
    rest: list[tuple[int, int, int]] = []
    for i in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[i], tiers[i - 1] if i else 0
        while pool.longest(tier) > below:
            length = pool.longest(tier)
            window, gap = [(*pool.take(length), length)], tier - length
            while gap and pool.mask:
                if length := pool.longest(gap):
                    window.append((*pool.take(length), length))
                    gap -= length
                else:
                    length = pool.shortest_over(gap)
                    d, start = pool.take(length)
                    window.append((d, start, gap))
                    pool.add(length - gap, (d, start + gap))
                    gap = 0
            if gap:
                rest += window
            else:
                windows.append((tier, window))
    if not last:
        return windows, rest
    while rest:
        total = sum(x[2] for x in rest)
        size = 1 << (total.bit_length() - 1) if total >= 32 else total
        window, room = [], size
        while room:
            d, start, length = rest.pop()
            if length > room:
                rest.append((d, start + room, length - room))
                length = room
            window.append((d, start, length))
            room -= length
        windows.append((size, window))
    return windows, []


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: longest first, each to the group with fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        total, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (total + sizes[i], g))
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = 1 << 21,
) -> DataFrame:
    """Pack docs(doc_id, text) into sequences; a row per piece with its token ids.

    Null and empty texts are just the end id. Null or repeated doc_ids are packed like others,
    each row on its own; other columns of docs are not read. An empty table gives no rows.
    A text of any length is cut into whole windows. `block_tokens` bounds what a task holds:
    a block is packed and returned before the next is read, its leftover moving on with it. Step
    groups are balanced within a block and hold windows of all tiers.
    sequence_id and step_group carry the partition number in their upper bits.
    """
    path = tokenizer or default_tokenizer()
    width = 4
    names = [c.split()[0] for c in PIECES.split(", ")]

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        encode = encoder(path, end_id)
        base = TaskContext.get().partitionId() << 32
        made = steps = 0
        held: list[tuple[int | None, int, int, bytes]] = []  # doc_id, tokens before, all tokens, ids

        def flush(last: bool) -> Iterator[dict[str, list]]:
            nonlocal made, steps, held
            windows, rest = pack([len(x[3]) // width for x in held], tiers, last)
            group = balanced([w[0] for w in windows], step_tokens)
            out: dict[str, list] = {c: [] for c in names}
            for (tier, window), g in zip(windows, group, strict=True):
                if len(out["tier"]) >= OUT_PIECES:
                    yield out
                    out = {c: [] for c in names}
                offset = 0
                for d, start, length in window:
                    doc_id, before, total, ids = held[d]
                    piece = ids[start * width : (start + length) * width]
                    values = (doc_id, before + start, length, piece, total, base + made, offset, tier, base + steps + g)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    offset += length
                made += 1
            steps += max(group, default=-1) + 1
            held = [(held[d][0], held[d][1] + s, held[d][2], held[d][3][s * width : (s + n) * width]) for d, s, n in rest]
            yield out

        size = 0
        for batch in batches:
            for part in slices(batch, 32):
                for doc_id, ids in zip(part["doc_id"], encode(part["text"]), strict=True):
                    held.append((doc_id, 0, len(ids) // width, ids))
                    size += len(ids) // width
                if size >= block_tokens:
                    yield from flush(False)
                    size = sum(len(x[3]) // width for x in held)
        if held:
            yield from flush(True)
        encode.forget()

    return arrow_map(docs.select("doc_id", "text"), rows, PIECES)


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table packed into windows of at most 2048 tokens; a row per piece."""
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        ids_crc32(F.col("ids")).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "tier",
        "step_group",
    )
