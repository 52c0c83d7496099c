"""Near copies among vectors by an exact metric range join over pivot cells (operator 12)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from barlight.llm.common import arrow_map, release, written
from barlight.llm.jaccard import components, spanning
from barlight.session import ship

COSINE = 0.98
#: A cell with more vectors of its own is cut by pivots, one for so many vectors, at most PIVOTS at a time.
CELL, PER_PIVOT, PIVOTS = 1024, 256, 64
#: Pivots are taken from about so many vectors of a cell, which also tell whether they cut it well: to GAIN of the pairs or less.
SAMPLE, GAIN = 1024, 0.9
#: Rows of a cell that one task cuts; vectors of a block that is compared with another; rounds of cuts.
SALT_ROWS, BLOCK, ROUNDS = 8192, 1024, 6
#: Angles are compared with this much to spare, more than their rounding; cosines decide.
SPARE = 1e-6
MEMBER = "node binary, cell string, home boolean, copies long, vec binary"


def units(vectors: Iterable[bytes], dtype: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.array([np.frombuffer(v, dtype) for v in vectors], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _dtype(vectors: DataFrame) -> str:
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def _nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, node, cell, vec: bytes of each vector that can link, its hash with its label, and the label's cell; else nulls."""
    ship(vectors.sparkSession)
    dtype = _dtype(vectors)
    out = pa.schema([("vec_id", pa.int64()), ("node", pa.binary()), ("cell", pa.string()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            held = []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                x = None if label is None or v.values is None else v.values.to_numpy(zero_copy_only=False).astype(dtype)
                if x is None or not np.isfinite(x).all() or not x.any():
                    held.append((None, None, None))
                    continue
                cell = f"{label}/{len(x)}"
                held.append((xxh3_128_digest(cell.encode() + b"/" + x.tobytes()), cell, x.tobytes()))
            columns = zip(*held, strict=True) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True)]], schema=out)
        release()

    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return given.mapInArrow(run, "vec_id long, node binary, cell string, vec binary")


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x, each the farthest from those before, so that a tight group has one."""
    found = [0]
    near = angles(x, x[:1])[:, 0]
    while len(found) < k:
        found.append(int(near.argmax()))
        near = np.minimum(near, angles(x, x[found[-1:]])[:, 0])
    return x[found]


def visits(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of x (its nearest pivot), and in which other cells a vector within `reach` of it may lie.

    If y of cell i is near x, then angle(x, i) <= angle(y, i) + reach <= angle(y, j) + reach <= angle(x, j) + 2 reach for any
    pivot j: cells beyond that are ruled out. The great circle halfway between two pivots, which y is
    on the other side of, must be within reach, too: on a sphere that rules out some more.
    """
    a, c = angles(x, pivots), x @ pivots.T
    own = a.argmin(axis=1)
    rows = np.arange(len(x))
    nearest, cosine = a[rows, own][:, None], c[rows, own][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[own]
    may = (a - nearest <= 2 * reach + SPARE) & (cosine - c <= apart * np.sin(reach) + SPARE)
    may[rows, own] = False
    return own, may


def one_way(own: np.ndarray, k: int) -> np.ndarray:
    """Of two cells, vectors of one visit the other and not the other way: each cell visits about half of the others."""
    gap = (own[:, None] - np.arange(k)[None, :]) % k
    return np.where(2 * gap == k, own[:, None] > np.arange(k)[None, :], (gap > 0) & (2 * gap < k))


def _pivots(sample: DataFrame, dtype: str, reach: float) -> DataFrame:
    """cell, pivots, salts for the cells that pivots cut well, from a sample of each (cell, vec, home, homes, members)."""

    def choose(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("vec")
        x, at_home = units(sample["vec"], dtype), sample["home"].to_numpy(bool)
        cell, homes, members = sample[["cell", "homes", "members"]].iloc[0]
        k = min(PIVOTS, max(2, -(-int(homes) // PER_PIVOT)), int(at_home.sum()))
        none = pd.DataFrame({"cell": [], "pivots": [], "salts": []}, dtype=object)
        if k < 2:
            return none
        p = far_apart(x[at_home], k)
        own, may = visits(x, p, reach)
        # pairs to compare after the cut, those of guests too, against those before
        home = np.bincount(own[at_home], minlength=k)
        guests = (may & (one_way(own, k) | ~at_home[:, None])).sum(axis=0) + np.bincount(own[~at_home], minlength=k)
        if (home * (home / 2 + guests)).sum() > GAIN * at_home.sum() * (len(x) - at_home.sum() / 2):
            return none
        return pd.DataFrame({"cell": [cell], "pivots": [p.astype("<f8").tobytes()], "salts": [-(-int(members) // SALT_ROWS)]})

    # grouped, not repartitioned and mapped: a repartition by the key of the join before may be left out, and that join's partitions be split
    return sample.select("cell", "vec", "home", "homes", "members").groupBy("cell").applyInPandas(choose, "cell string, pivots binary, salts int")


def _cut(members: DataFrame, pivots: DataFrame, dtype: str, reach: float) -> DataFrame:
    """Members of the cells that have pivots in their new cells: at home in one, as guests in others.

    Pairs of two vectors at home meet in one cell, where one is at home; guests of the old cell go to all cells
    that they may reach, and meet there who is at home. So each pair of the old cell is met once.
    """
    salted = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    rows = members.join(pivots.drop("pivots"), "cell").select("cell", salted.alias("salt"), F.lit(1).alias("kind"), "node", "home", "copies", "vec")
    heads = pivots.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("pivots").alias("vec")
    )
    work = rows.unionByName(heads, allowMissingColumns=True).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        pivot = None
        for b in batches:
            kinds = np.array(b["kind"])
            # stretches of rows under one head
            cuts = [0, *(np.flatnonzero(kinds == 0)).tolist(), len(kinds)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end and kinds[begin] == 0:
                    pivot, begin = b["vec"][begin], begin + 1
                for lo in range(begin, end, 512):
                    hi = min(end, lo + 512)
                    x = units(b["vec"][lo:hi], dtype)
                    p = np.frombuffer(pivot, "<f8").reshape(-1, x.shape[1])
                    own, may = visits(x, p, reach)
                    home = np.array(b["home"][lo:hi])
                    may &= one_way(own, len(p)) | ~home[:, None]
                    who, where = np.nonzero(may)
                    who, where = np.concatenate([np.arange(hi - lo), who]) + lo, np.concatenate([own, where])
                    stays = np.concatenate([home, np.zeros(len(where) - (hi - lo), bool)])
                    yield {
                        "node": [b["node"][i] for i in who],
                        "cell": [f"{b['cell'][i]}/{c}" for i, c in zip(who, where, strict=True)],
                        "home": stays.tolist(),
                        "copies": [b["copies"][i] for i in who],
                        "vec": [b["vec"][i] for i in who],
                    }

    return arrow_map(work, run, MEMBER)


def cells(nodes: DataFrame, dtype: str, reach: float) -> DataFrame:
    """nodes(node, cell, copies, vec) dealt to cells, with `home`. Any two within reach meet in exactly one, where one is at home.

    Cells that are too large are cut in rounds. One that pivots don't cut (all its vectors are within reach of each other, say)
    stays whole: it is compared in blocks. Rounds are written tables; pivots are joined, not broadcast.
    """
    columns = ("node", "cell", "home", "copies", "vec")
    members, done = written(nodes.withColumn("home", F.lit(True)).select(*columns), "cells"), None
    for depth in range(ROUNDS):
        sizes = members.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
        large = sizes.filter(F.col("homes") > CELL)
        sample = members.join(large, "cell").filter(F.pmod(F.xxhash64("node", F.lit(depth)), F.col("members")) < SAMPLE)
        pivots = written(_pivots(sample, dtype, reach), "pivots")
        if pivots.isEmpty():
            break
        rest = members.join(pivots.select("cell"), "cell", "left_anti").select(*columns)
        done = rest if done is None else done.unionByName(rest)
        members = written(_cut(members, pivots, dtype, reach), "cells")
    return members if done is None else done.unionByName(members)


def _compare(dtype: str, cosine: float):
    """Rows sorted by (cell, lo, hi) to links and edges: those at home in block lo against each other, or against the other rows."""

    def result(group: list[tuple], lo: int, hi: int) -> dict[str, list]:
        left = [r for r in group if r[3] and r[4] == lo]
        right = [r for r in group if not (r[3] and r[4] == lo)]
        out: dict[str, list] = {"key": [], "root": [], "links": []}
        if not left:
            return out
        nodes = left + right
        x = units([r[5] for r in nodes], dtype)
        like = np.empty((len(left), len(nodes)), bool)
        for i in range(0, len(nodes), BLOCK):
            like[:, i : i + BLOCK] = x[: len(left)] @ x[i : i + BLOCK].T >= cosine
        own, other = like[:, : len(left)], like[:, len(left) :]
        if lo == hi:
            own |= own.T
            np.fill_diagonal(own, False)
        else:
            own[:] = False
        copies = np.array([r[6] for r in nodes], np.int64)
        links = np.concatenate([own @ copies[: len(left)] + other @ copies[len(left) :], other.T @ copies[: len(left)]])
        edges = [(i, r) for i, r in spanning(own, True)] if lo == hi else []
        edges += spanning(other, False) if len(right) else []
        for i, root in edges:
            out["key"].append(nodes[i][2])
            out["root"].append(nodes[root][2])
            out["links"].append(0)
        for i in np.flatnonzero(links).tolist():
            out["key"].append(nodes[i][2])
            out["root"].append(nodes[i][2])
            out["links"].append(int(links[i]))
        return out

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        at, group = None, []
        for b in batches:
            for row in zip(b["lo"], b["hi"], b["node"], b["home"], b["block"], b["vec"], b["copies"], b["cell"], strict=True):
                here = (row[7], row[0], row[1])
                if here != at:
                    if len(group) > 1:
                        yield result(group, *at[1:])
                    at, group = here, []
                group.append(row)
        if len(group) > 1:
            yield result(group, *at[1:])

    return rows


def _links(dealt: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """key, root, links: what the pairs of each cell bring, in blocks of at most about BLOCK vectors where a cell is large."""
    sizes = dealt.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).filter("h > 0 and h + v > 1")
    small = (F.col("h") <= BLOCK) & (F.col("v") <= 4 * BLOCK)
    n_home, n_guest = (F.when(small, low).otherwise(F.ceil(F.col(c) / BLOCK)).cast("int").alias(f"n_{c}") for c, low in (("h", 1), ("v", 0)))
    placed = dealt.join(sizes.select("cell", n_home, n_guest), "cell")
    own = F.pmod(F.xxhash64("node"), F.col("n_h")).cast("int")
    guest = F.when(F.col("n_v") > 0, F.col("n_h") + F.pmod(F.xxhash64("node"), F.greatest("n_v", F.lit(1)))).otherwise(0).cast("int")
    placed = placed.withColumn("block", F.when(F.col("home"), own).otherwise(guest))
    blocks = F.sequence(F.lit(0), F.col("n_h") + F.col("n_v") - 1)
    other = F.when(F.col("home") | (F.col("n_v") == 0), blocks).otherwise(F.slice(blocks, 1, F.col("n_h")))
    work = placed.withColumn("other", F.explode(other)).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    work = work.select("cell", "lo", "hi", "node", "home", "block", "vec", "copies")
    work = work.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return written(arrow_map(work, _compare(dtype, cosine), "key binary, root binary, links long"), "links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null and their cosine, in double precision, is `cosine` or
    more. n_links counts the vectors linked directly, component_id is the least vec_id reachable by
    links, kept tells whether that is its own. Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
    those of different lengths. Equal vectors of a label are compared as one, with their number. Rows that repeat a vec_id are
    vectors of their own; null ids count as none: a component of such only has a null id, and keeps all. An
    empty table gives no rows; other columns aren't read.
    """
    reach, dtype = float(np.arccos(cosine)), _dtype(vectors)
    rows = written(_nodes(vectors), "vectors")
    linking = rows.filter("node is not null")
    nodes = linking.groupBy("node").agg(F.first("cell").alias("cell"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = written(nodes, "nodes")
    links = _links(cells(nodes, dtype, reach), dtype, cosine)
    counts = links.groupBy(F.col("key").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(links).withColumnRenamed("key", "node")
    found = nodes.select("node", "copies", "least").join(counts, "node", "left").join(labels, "node", "left")
    found = found.withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(found.join(least, "label").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    known = linking.select("vec_id", "node").join(found, "node").select("vec_id", "n_links", "component_id")
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its component at cosine 0.98 within its label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> str:
    """All pairs of a label, and components by the least id that recursion reaches."""
    return f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach as (
  select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on l.a = r.b
), component as (select a, min(b) as component_id from reach group by a),
links as (select a, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join component c on c.a = vec_id left join links l on l.a = vec_id
"""
