"""Shared helpers of the training-data operators: the shared folder, Arrow maps, word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from barlight.session import removed, shared_dir, ship, written, written_at

__all__ = [
    "arrow_map", "columns_added", "free_name", "mix64", "one_row_each", "Remembered", "removed", "shared_dir", "shingles", "slices", "WordHasher",
    "words_of", "written", "written_at",
]
WORD = re.compile(r"\w+")
PART_BYTES = 8 << 20


def free_name(columns: Sequence[str], base: str) -> str:
    """base, with underscores before it until no column has that name (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def _unhashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _unhashable(kind.elementType)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, StructType) and any(_unhashable(f.dataType) for f in kind)


def one_row_each(df: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows that agree on the key columns (never null) the one with the least hash of its columns.

    Repeats are dropped before the shuffle, too, so that a much repeated row is no hot key. Columns that
    hold maps, which have no hash, count by their JSON.
    """
    whole, row = free_name(df.columns, "whole"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in key])
    columns = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    hashed = [F.to_json(F.struct(c.alias("of"))) if _unhashable(kind) else c for c, kind in columns]
    return df.groupBy(*key).agg(F.min_by(row, F.xxhash64(*hashed)).alias(whole)).select(*key, f"{whole}.*")


def _target(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches a few megabytes at a time, as Python values take several times that."""
    for b in batches:
        step = max(1, min(512, b.num_rows * PART_BYTES // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU C library
        return lambda _: 0


def release() -> None:
    """Give memory back at a task's end: Python workers live on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def arrow_map(
    df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, object]]], schema: str
) -> DataFrame:
    """mapInArrow with plain Python columns: `rows` gets {column: list} and yields the same.

    Arrow keeps 64-bit ids with nulls exact, which pandas columns do not. A batch is turned into
    Python values a few megabytes at a time.
    """
    ship(df.sparkSession)
    target = _target(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({f: p.column(i).to_pylist() for i, f in enumerate(p.schema.names)} for p in _parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        release()

    return df.mapInArrow(run, schema)


def columns_added(
    df: DataFrame,
    keep: list[str],
    made: Callable[[], Callable[..., dict[str, list]]],
    schema: str,
    inputs: tuple[str, ...] = ("text",),
) -> DataFrame:
    """The columns `keep` of df and those that a function makes from the input columns, row by row.

    `made` is called once a task and gives that function of lists. Kept columns stay in Arrow,
    whatever their type. `schema` names the new columns, which must not be among `keep`.
    """
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    whole = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [schema])
    new = _target(schema)
    names = [*keep, *(c for c in inputs if c not in keep)]
    at = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = made()
        for p in _parts(batches):
            found = fn(*[p.column(i).to_pylist() for i in at])
            arrays = [p.column(i) for i in range(len(keep))] + [pa.array(found[f.name], f.type) for f in new]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new.names])
        del fn
        release()

    return df.select(*[f"`{c}`" for c in names]).mapInArrow(run, whole)


def slices(columns: dict[str, list], size: int) -> Iterator[dict[str, list]]:
    """Parts of at most `size` rows."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, size):
        yield {k: v[i : i + size] for k, v in columns.items()}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Remembered(dict):
    """A dict that computes what it lacks and keeps it, up to some bytes; long keys aren't kept.

    Keys that come often come early, so a full one keeps what it has and only computes the rest.
    When these have become many, `trimmed` forgets all and starts anew: callers ask between texts.
    """

    def __init__(self, compute: Callable[[str], object], most_bytes: int, each: int = 200, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.longest = compute, longest
        self.limit = max(1, most_bytes // each)
        self.passed = 0

    def __missing__(self, key: str) -> object:
        value = self.compute(key)
        if len(self) < self.limit and len(key) <= self.longest:
            self[key] = value
        else:
            self.passed += 1
        return value

    def trimmed(self) -> None:
        if self.passed > 4 * self.limit:
            self.clear()
            self.passed = 0


def word_hash(word: str) -> bytes:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")).to_bytes(8, "little")


class WordHasher:
    """64-bit hashes of words, remembered per task up to `most_bytes`."""

    def __init__(self, most_bytes: int = 48 << 20) -> None:
        self.known = Remembered(word_hash, most_bytes)

    def __call__(self, words: list[str]) -> np.ndarray:
        self.known.trimmed()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u8")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return WORD.findall(text.lower()) if text else []


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of n words, ascending.

    Fewer than n words give one shingle of all; no word gives none.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix64(out + np.uint64(n)))
