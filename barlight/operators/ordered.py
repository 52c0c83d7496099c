"""Order over groups too long for one task: row numbers, running aggregates, quantiles and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barlight.functions.stats import KEY
from barlight.session import written

CHUNK = 100_000


def ordered_index(
    df: DataFrame,
    order: list[str | Column],
    partitions: int | None = None,
    by: list[str] | None = None,
    weight: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """df with `rn`, the row number from 1 within `by`, without a task per group; with `size`, a column of the group's number of rows, too.

    Rows are range-partitioned by group and order; each range counts its rows, and the counts before
    it (one row a range and group) are added to numbers inside the range. With `weight`, a
    column of whole numbers, rn is its running sum.
    """
    by = [KEY] if by is None else by
    columns = [*map(F.col, by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    spread = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    # written once: the ranges are sampled, and another run of the plan could draw others
    spread = written(spread.withColumn("__part", F.spark_partition_id()), "ranges")
    one = F.col(weight) if weight else F.lit(1)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(*by, "__part").agg(F.sum(one).alias("__n"))
    whole = [F.sum("__n").over(Window.partitionBy(*by)).alias(size)] if size else []
    offsets = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *whole)
    inside = F.sum(one).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        spread.withColumn("__inside", inside)
        .join(offsets, [*by, "__part"])
        .withColumn("rn", F.col("__before") + F.col("__inside"))
        .drop("__part", "__inside", "__before")
    )


def haloed(numbered: DataFrame, before: int = 1, after: int = 0, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """Rows numbered by `rn` in chunks of `chunk` rows, each with the `before` rows before it and the `after` rows after it.

    For windows of a bounded reach: partitioned by group and `__chunk` they see all rows that they look at, and no
    task has a whole group. Rows lent to a neighbour have false in `__own`, to be dropped after use.
    """
    size = max(chunk, before, after)
    at, place = F.floor((F.col("rn") - 1) / size), (F.col("rn") - 1) % size
    lent = [F.when(place >= size - before, at + 1)] if before else []
    lent += [F.when((place < after) & (at > 0), at - 1)] if after else []
    spread = numbered.withColumn("__at", at).withColumn("__chunk", F.explode(F.array_compact(F.array(at, *lent))))
    return spread.withColumn("__own", F.col("__chunk") == F.col("__at")).drop("__at")


def in_chunk(by: list[str] | None = None, *extra: str) -> WindowSpec:
    """The rows of a chunk in order."""
    return Window.partitionBy(*([KEY] if by is None else by), "__chunk", *extra).orderBy("rn")


def owned(haloed: DataFrame) -> DataFrame:
    return haloed.filter("__own").drop("__own", "__chunk")


def with_previous(df: DataFrame, columns: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """df with columns (name to source) of the row before in its series, null on the first; numbered by `rn`, chunk by chunk."""
    numbered = df if "rn" in df.columns else ordered_index(df, ["ts"])
    rows = haloed(numbered, 1, 0, chunk)
    return owned(rows.withColumns({new: F.lag(c).over(in_chunk()) for new, c in columns.items()}))


def scanned(rows: DataFrame, states: str, maps: dict[str, Column], start: str) -> DataFrame:
    """chunk totals (by series and `__chunk`, from 0 without a gap) to the state before each chunk.

    An automaton over a long series: `maps` tells for each state (a letter) the state after the chunk. One
    row a chunk meets in a task, which goes through them in order. The result has KEY, __chunk and `__state`.
    """
    each = F.sort_array(F.collect_list(F.struct("__chunk", *[m.alias(k) for k, m in maps.items()])))
    last = lambda told: F.substring(told, F.length(told), F.lit(1))

    def on(told: Column, step: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in states:
            out = F.when(last(told) == k, step[k]).otherwise(out)
        return F.concat(told, out)

    told = rows.groupBy(KEY).agg(F.aggregate(each, F.lit(start), on).alias("told"), F.count(F.lit(1)).alias("n"))
    chunks = told.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return chunks.select(KEY, "__chunk", F.substring("told", F.col("__chunk").cast("int") + 1, F.lit(1)).alias("__state"))


def running(
    df: DataFrame,
    aggregates: dict[str, tuple[Callable[[Column], Column], Column]],
    joined: dict[str, Callable[[Column, Column], Column]],
    chunk: int = CHUNK,
    by: list[str] | None = None,
) -> DataFrame:
    """df, numbered by `rn`, with running aggregates from the first row of each group on.

    aggregates: name to (aggregate, value); joined: how the result before a chunk and that inside
    it make one. Rows are cut into chunks of `chunk` rows; one row a chunk meets in one task.
    """
    by = [KEY] if by is None else by
    cut = df.withColumn("__chunk", F.floor((F.col("rn") - 1) / chunk))
    names = list(aggregates)
    totals = cut.groupBy(*by, "__chunk").agg(*[agg(value).alias(n) for n, (agg, value) in aggregates.items()])
    chunks = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    befores = [aggregates[n][0](F.col(n)).over(chunks).alias(f"__before_{n}") for n in names]
    inside = Window.partitionBy(*by, "__chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(totals.select(*by, "__chunk", *befores), [*by, "__chunk"])
    found = {n: agg(value).over(inside) for n, (agg, value) in aggregates.items()}
    whole = {n: F.coalesce(joined[n](F.col(f"__before_{n}"), f), f, F.col(f"__before_{n}")) for n, f in found.items()}
    return out.withColumns(whole).drop("__chunk", *[f"__before_{n}" for n in names])


def running_product(df: DataFrame, value: Column, name: str, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """Product of `value` from the first row on, in order of `rn`."""
    return running(df, {name: (F.product, value)}, {name: lambda a, b: a * b}, chunk, by)


def running_sum(df: DataFrame, value: Column, name: str, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    return running(df, {name: (F.sum, value)}, {name: lambda a, b: a + b}, chunk, by)


def running_max(df: DataFrame, value: Column, name: str, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    return running(df, {name: (F.max, value)}, {name: lambda a, b: F.greatest(a, b)}, chunk, by)


def quantiles(df: DataFrame, value: Column, by: list[str], points: dict[str, float]) -> DataFrame:
    """A row per group with exact quantiles (linear) of `value`, nulls left out.

    Equal values are counted before they are dealt to ranges, so that a value which much of a group
    has is one row of one range. All groups share one numbering: they follow each other in its ranges.
    """
    values = df.select(*by, value.alias("__v")).filter("__v is not null")
    counts = values.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__times"))
    rows = ordered_index(counts, ["__v"], by=by, weight="__times", size="n")
    out = []
    for name, q in points.items():
        at = (F.col("n") - 1) * F.lit(q)
        low = F.floor(at)

        def ranked(rank: Column) -> Column:
            return F.max(F.when((F.col("rn") - F.col("__times") < rank) & (rank <= F.col("rn")), F.col("__v")))

        first, second = ranked(low + 1), ranked(F.least(low + 2, F.col("n")))
        out.append((first + (second - first) * F.max(at - low)).alias(name))
    return rows.groupBy(*by).agg(*out)


def with_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """df with `<column>_rank`, from 1 with ties at their mean: counts of equal values, summed up in order."""
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
        placed = ordered_index(counts, [c], by=by, weight="__n")
        df = df.join(placed.select(*by, c, (F.col("rn") - (F.col("__n") - 1) / F.lit(2.0)).alias(f"{c}_rank")), [*by, c])
    return df


class Expanding:
    """What came before each of some periods, without copying rows to all later periods.

    rows(by.., period, value) are counted by value and period, numbered by value and cut into blocks of `block`
    counts, so that a value which many rows have is as many rows as it has periods. Unless given, a block has the
    square root of its group's number of counts: the table of blocks and periods and the counts that a
    bound looks at then grow alike. How many rows
    of a block belong to periods before `until` is a small table; a wanted rank or bound lies in
    one block, and only that block's counts are looked at. `untils` has by.. and `until`, which is
    compared with `period`: a list per group that the calendar bounds. Null values are left out.
    """

    def __init__(self, rows: DataFrame, value: Column, by: list[str], period: Column, untils: DataFrame, block: int | None = None) -> None:
        self.by, self.at = by, [*by, "until"]
        values = rows.select(*by, period.alias("period"), value.alias("v")).filter("v is not null")
        counted = values.groupBy(*by, "v", "period").agg(F.count(F.lit(1)).alias("times"))
        numbered = ordered_index(counted, ["v", "period"], by=by, size="__size")
        size = F.lit(block) if block else F.ceil(F.sqrt("__size"))
        self.rows = written(numbered.withColumn("block", F.floor((F.col("rn") - 1) / size)).drop("__size"), "blocks")
        blocks = self.rows.groupBy(*by, "block").agg(F.max("v").alias("high"))
        lower = F.lag("high").over(Window.partitionBy(*by).orderBy("block"))
        counts = self.rows.groupBy(*by, "block", "period").agg(F.sum("times").alias("c"))
        grid = blocks.withColumn("low", lower).join(untils.select(*self.at).distinct(), by)
        held = grid.join(counts, [*by, "block"]).groupBy(*self.at, "block", "low", "high")
        held = held.agg(F.coalesce(F.sum(F.when(F.col("period") < F.col("until"), F.col("c"))), F.lit(0)).alias("c"))
        order = Window.partitionBy(*self.at).orderBy("block")
        before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        self.blocks = written(held.withColumn("before", before), "grid")
        self.sizes = self.blocks.groupBy(*self.at).agg(F.sum("c").alias("n"))

    def _inside(self, wanted: DataFrame) -> DataFrame:
        """Counts of earlier periods in the wanted blocks (by.., until, block, ..)."""
        return self.rows.join(wanted, [*self.by, "block"]).filter(F.col("period") < F.col("until"))

    def quantiles(self, points: list[float]) -> DataFrame:
        """by.., until, n and q: exact quantiles (linear) of the n values of earlier periods; no row where n is 0."""
        low = [F.floor((F.col("n") - 1) * F.lit(p)) + 1 for p in points]
        ranks = F.array_distinct(F.array(*low, *[F.least(x + 1, F.col("n")) for x in low]))
        here = F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("c")))
        wanted = self.blocks.join(self.sizes, self.at).withColumn("ranks", here).filter(F.size("ranks") > 0)
        wanted = wanted.select(*self.at, "block", "before", "ranks")
        upto = Window.partitionBy(*self.at, "block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        placed = self._inside(wanted).withColumn("place", F.sum("times").over(upto) + F.col("before"))
        own = F.filter("ranks", lambda r: (r > F.col("place") - F.col("times")) & (r <= F.col("place")))
        found = placed.withColumn("rank", F.explode(own)).groupBy(*self.at).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
        q = []
        for p, x in zip(points, low, strict=True):
            a, b = F.try_element_at("of", x), F.try_element_at("of", F.least(x + 1, F.col("n")))
            q.append(a + (b - a) * ((F.col("n") - 1) * F.lit(p) + 1 - x))
        return found.join(self.sizes, self.at).select(*self.at, "n", F.array(*q).alias("q"))

    def below(self, bounds: DataFrame) -> DataFrame:
        """bounds(by.., until, bound) with `less`, how many values of earlier periods are under the bound.

        A bound must not be above the greatest value of all periods.
        """
        here = (F.col("low").isNull() | (F.col("bound") > F.col("low"))) & (F.col("bound") <= F.col("high"))
        wanted = self.blocks.join(bounds, self.at).filter(here).select(*self.at, "block", "bound", "before")
        inner = self._inside(wanted).groupBy(*self.at, "bound").agg(F.sum(F.when(F.col("v") < F.col("bound"), F.col("times")).otherwise(0)).alias("inner"))
        out = wanted.join(inner, [*self.at, "bound"], "left")
        return out.select(*self.at, "bound", (F.col("before") + F.coalesce("inner", F.lit(0))).alias("less"))
