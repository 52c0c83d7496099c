"""Merkle manifest of a dataset: trees of digests by windows of lag and lead (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import written
from barlight.llm.runs import CRC32
from barlight.operators.ordered import ordered_index

#: Children of a node, and levels that are built in one pass over chunks of WIDTH ** LEVELS nodes.
WIDTH = 3
LEVELS = 6
CHUNK = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def told(value: Column) -> Column:
    """A value as it is hashed: its bytes in UTF-8, a colon, the value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(told, fields)), 256)


class Trees:
    """A tree of digests for each group of nodes(by.., digest, ..), in a given order.

    Every WIDTH consecutive nodes of a level (the last ones: fewer, even one) make one of the next by the digest of
    their digests, until one is left. by columns must not be null. Nodes are numbered over ranges, so
    that no group is one task, and hashed in chunks of CHUNK rows; the chunks' tops are the nodes
    of the next pass, CHUNK times fewer. Each pass is a written table.
    """

    def __init__(self, nodes: DataFrame, by: list[str], order: list[str | Column]) -> None:
        self.by = by
        numbered = ordered_index(nodes, order, by=by, size="n").withColumn("i", F.col("rn") - 1).drop("rn")
        self.passes = [written(self._climbed(numbered), "tree")]
        while True:
            last = self.passes[-1]
            tops = last.filter(F.col("i") % CHUNK == 0).select(
                *by, F.col("chunk").alias("i"), F.ceil(F.col("n") / CHUNK).alias("n"), F.col("top").alias("digest")
            )
            if (last.agg(F.max("n")).first()[0] or 0) <= CHUNK:
                break
            self.passes.append(written(self._climbed(tops), "tree"))
        #: by.., root: a row per group.
        self.roots = tops.select(*by, F.col("digest").alias("root"))

    def _climbed(self, nodes: DataFrame) -> DataFrame:
        """Rows (by.., i, n, digest, ..) with `top`, the node LEVELS levels above, on the first row of each chunk, and own steps.

        Nodes of level k are the rows whose number is a multiple of WIDTH ** k; their neighbours stand
        at the fixed offset of so many rows, masked by the slot in the run and the run's length. First children
        hash the parent. step<k> is what stands before and after a node in its run; a level of
        one node has none. All windows have one partitioning and order: a pass is one exchange and sort.
        """
        chunk = Window.partitionBy(*self.by, "chunk").orderBy("i")
        out = nodes.withColumn("chunk", F.floor(F.col("i") / CHUNK)).withColumn("top", F.col("digest"))
        for k in range(LEVELS):
            span = WIDTH**k
            at, size = F.floor(F.col("i") / span), F.ceil(F.col("n") / span)
            slot = at % WIDTH
            length = F.least(F.lit(WIDTH), size - (at - slot))
            node, many = F.col("i") % span == 0, size > 1
            lags = {f"__lag{d}": F.lag("top", d * span).over(chunk) for d in range(1, WIDTH)}
            leads = {f"__lead{d}": F.lead("top", d * span).over(chunk) for d in range(1, WIDTH)}
            out = out.withColumns(lags | leads)
            left = F.concat_ws("", *[F.when(slot >= d, F.col(f"__lag{d}")) for d in reversed(range(1, WIDTH))])
            right = F.concat_ws("", *[F.when(slot + d < length, F.col(f"__lead{d}")) for d in range(1, WIDTH)])
            parent = F.when(node & (slot == 0), F.sha2(F.concat("top", right), 256))
            step = F.when(node & many, F.struct(left.alias("left"), right.alias("right")))
            out = out.withColumns({f"step{k}": step, "top": F.when(many, parent).otherwise(F.col("top"))}).drop(*lags, *leads)
        return out

    def _with_steps(self, climbed: DataFrame) -> DataFrame:
        """Rows with `steps`, those of the nodes above them in their chunk: the last ones at or before a row."""
        before = Window.partitionBy(*self.by, "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        names = [f"step{k}" for k in range(LEVELS)]
        found = climbed.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in names})
        return found.withColumn("steps", F.array_compact(F.array(*map(F.col, names)))).drop(*names)

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with `path`, the steps from each up to its group's root and on by above(by.., rest, ..).

        A step is a struct of what is hashed before and after the node. Other columns of above are
        passed on. Chunks are joined with their tops' paths pass by pass: no level is joined by itself.
        """
        upper = above.withColumn("chunk", F.lit(0).cast("long"))
        for climbed in reversed(self.passes):
            down = self._with_steps(climbed).join(upper, [*self.by, "chunk"])
            down = down.withColumn("path", F.concat("steps", "rest")).drop("steps", "rest", "chunk", "top")
            upper = down.drop("n", "digest").withColumnsRenamed({"i": "chunk", "path": "rest"})
        return down.drop("n", "i")


def manifest(docs: DataFrame, fields: list[Column], by: Column, order: list[Column], keep: dict[str, Column]) -> DataFrame:
    """A row per row of docs: the columns `keep`, leaf, subroot, root and path (steps from the leaf to the root).

    A leaf is the digest of its fields. The rows of each value of `by` (null is one) in the given order,
    rows that tie by digest, have a tree; the roots of all trees, by that value (null first, bytewise), have one in turn. Null,
    empty and very long texts and nulls in any field make leaves like others; repeated rows have a
    leaf each; an empty table gives no rows; columns that aren't named are not read.
    """
    group = {"__g": told(by), "__b": by.cast("string")}
    sort = {f"__o{i}": c for i, c in enumerate(order)}
    rows = docs.select(*[c.alias(n) for n, c in (group | sort | {"digest": leaf_of(fields)} | keep).items()])
    low = Trees(written(rows, "leaves"), ["__g"], [*sort, "digest"])
    names = low.passes[0].filter("i = 0").select("__g", "__b")
    groups = low.roots.join(names, "__g").select(F.lit(0).alias("__all"), "__g", "__b", F.col("root").alias("digest"))
    high = Trees(groups, ["__all"], [F.col("__b").asc_nulls_first()])
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = high.paths(high.roots.withColumn("rest", none))
    above = above.select("__g", F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root")
    return low.paths(above).select(*keep, F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path, bottom up and left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by the siblings of a path."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, and the root that its leaf gives once half of the ids have lost their line ends.

    A null id has no digits: its text stays as it is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in FIELDS]
    cut = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_of(cut))
    found = manifest(docs, fields, F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "tampered": tampered})
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """Levels by recursion: nodes grouped by three, and each leaf folded with its siblings."""

    def value(c: str, text: str) -> str:
        return f"coalesce(strlen(cast({text} as varchar)) || ':' || {text}, '-')"

    whole = " || ".join(value(c, c) for c in FIELDS)
    cut = " || ".join(value(c, "replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)
    run = "concat(lag(d, 2) over w, lag(d, 1) over w) as l, concat(lead(d, 1) over w, lead(d, 2) over w) as r"
    return f"""
with recursive leaf as (
  select *, row_number() over (partition by source order by doc_id nulls first, d) - 1 as i, count(*) over (partition by source) as n,
    row_number() over () as doc
  from (select doc_id, source, sha256({whole}) as d, case when {CRC32} % 2 = 0 then sha256({cut}) end as changed from documents)
), node as (
  select source, 0 as k, i, n, d from leaf
  union all
  select source, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from node where n > 1 group by source, k, i // 3, n
), step as (
  select source, k, i, {run} from node where n > 1 window w as (partition by source, k, i // 3 order by i)
), top as (
  select 0 as k, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n, d, source from node where n = 1
  union all
  select k + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)), null from top where n > 1 group by k, i // 3, n
), top_step as (
  select k, i, {run} from top where n > 1 window w as (partition by k, i // 3 order by i)
), low as (
  select doc, source, 0 as k, i, coalesce(changed, d) as d, '' as proof from leaf
  union all
  select doc, x.source, x.k + 1, x.i // 3, sha256(l || d || r), proof || l || r
  from low x join step s on s.source is not distinct from x.source and s.k = x.k and s.i = x.i
), high as (
  select x.doc, 0 as k, t.i, x.d, x.proof, t.d as subroot
  from low x join node e on e.n = 1 and e.source is not distinct from x.source and e.k = x.k
  join top t on t.k = 0 and t.source is not distinct from x.source
  union all
  select doc, x.k + 1, x.i // 3, sha256(l || d || r), proof || l || r, subroot from high x join top_step s on s.k = x.k and s.i = x.i
)
select doc_id, e.d as leaf, subroot, t.d as root, sha256(proof) as proof_sha256, x.d as folded_root, x.d = t.d as verified
from high x join top t on t.n = 1 and t.k = x.k join leaf e on e.doc = x.doc
"""
