"""Mixing sources to target weights through a tree of groups (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import free_name, one_row_each, written

LEVELS = ("domain", "lang", "source")
#: Production parameters of the query: weights by level and name; a name without one weighs 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"core": 3.0, "extra": 2.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 2.0},
}
#: The domain of each source; others are OTHER.
DOMAINS: dict[str, str] = {f"src{i}": "core" for i in range(10)}
OTHER = "extra"
SHARE = 0.8
EPOCHS = 3
SEED = 17
BUCKET_DOCS = 2000
#: A table of up to so many leaves is sent to all tasks.
BROADCAST_LEAVES = 100_000
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Tokens of a text for budgets: its runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: dict[str, str] | None = None, other: str = OTHER) -> Column:
    """The domain that a source belongs to, by a mapping; null sources and unknown ones are `other`."""
    found = F.lit(None).cast("string")
    names = DOMAINS if domains is None else domains
    for domain in sorted(set(names.values())):
        found = F.when(source.isin([s for s, d in names.items() if d == domain]), domain).otherwise(found)
    return F.coalesce(found, F.lit(other))


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` among its children by `weight`, none above its `cap`.

    What a child can't take goes to its siblings in proportion to their weights. With children
    in order of cap / weight, the level at which all unfilled ones stand is the greatest of
    (budget - caps before) / (weights from here on).
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("__level", (F.col("budget") - before) / onward)
    return rows.withColumn("budget", F.least("cap", F.max("__level").over(group) * F.col("weight"))).drop("__level")


def budgets(leaves: DataFrame, total: Column, levels: tuple[str, ...], weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """leaves(levels.., docs, tokens) with `budget` tokens each.

    A group's cap is what all under it can give in `epochs` passes, so a shortage is shared
    among siblings first and reaches the ancestors only when a whole group runs short.
    """
    held = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    # the root: at most all that there is
    plan = held.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).select(
        F.lit(0).alias("__root"), F.least(F.floor(total).cast("double"), F.col("cap")).alias("budget")
    )
    above: list[str] = ["__root"]
    for level in levels:
        here = [*above[1:], level]
        nodes = held.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("__root", F.lit(0))
        nodes = nodes.withColumn("weight", weight_of(level, weights)).join(plan, above)
        plan = filled(nodes.select("__root", *here, "cap", "weight", "budget"), above, level)
        above = ["__root", *here]
        plan = plan.select(*above, "budget")
    return leaves.join(plan.drop("__root"), list(levels))


def mix(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: dict[str, dict[str, float]] | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Select from docs(doc_id, text, levels..) `share` of all tokens in the target proportions.

    Returns doc_id, tag, the levels, tokens, epoch, begin, taken: a row for each pass in which a
    document is selected. Each leaf's documents are ordered anew by a seeded hash in each epoch;
    whole epochs are taken, then of the last one the documents that begin before the leaf's rest
    of tokens, the last of them cut to `taken` tokens. Null names form a group of their own. Rows
    that repeat doc_id, text and group count as one document. A null doc_id is a value like
    others. Texts without tokens can be selected but need no budget. An empty table gives no rows.

    A leaf of any size is ordered in hash buckets of some BUCKET_DOCS documents: prefix
    sums over bucket totals, then inside each bucket; no group of documents meets in one task.
    """
    weights = WEIGHTS if weights is None else weights
    names = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels]
    rows = docs.select("doc_id", *names, F.xxhash64("text").alias("tag"), tokens(F.col("text")).alias("tokens"))
    rows = rows.dropDuplicates()
    leaves = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    leaves = written(leaves, "leaves")
    plan = budgets(leaves, F.col("tokens") * share, levels, weights, epochs)
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    plan = plan.select(
        *levels,
        F.greatest(F.ceil(F.col("docs") / BUCKET_DOCS), F.lit(1)).alias("buckets"),
        F.when(F.col("tokens") > 0, F.floor(whole / F.col("tokens"))).otherwise(0).cast("int").alias("full"),
        F.when(F.col("tokens") > 0, whole % F.col("tokens")).otherwise(0).alias("rest"),
    )
    if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)  # else a join by leaf, whose large partitions AQE splits
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))))
    placed = rows.join(plan, list(levels)).withColumn("order", order)
    part = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = placed.withColumn("bucket", F.floor(part * F.col("buckets")))
    key = [*levels, "bucket"]
    sums = placed.groupBy(*key).agg(F.sum("tokens").alias("held"))
    earlier = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    # dealt out by bucket again: else the join would take the documents, too, by leaf
    sums = sums.repartition(*key)
    inside = Window.partitionBy(*key).orderBy("order", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = placed.withColumn("within", begin).join(sums, key)
    placed = placed.withColumn("begin", F.col("before") + F.col("within"))
    last = F.when(F.col("begin") < F.col("rest"), F.col("full")).otherwise(F.col("full") - 1)
    chosen = placed.withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    final = F.col("epoch") == F.col("full")
    return chosen.select(
        "doc_id",
        "tag",
        *levels,
        "tokens",
        "epoch",
        F.when(final, F.col("begin")).alias("begin"),
        F.when(final, F.least(F.col("tokens"), F.col("rest") - F.col("begin"))).otherwise(F.col("tokens")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, selected: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The columns of docs for each selected pass of mix(docs, levels), the text cut to the tokens taken.

    Rows that repeat doc_id, text and group were budgeted once, so one of them is given back for
    each pass: the one with the least hash of its columns. Leading blanks stay with the first
    token of a cut text. Column names of docs may be any; its levels must be columns.
    """
    names = [free_name(docs.columns, n) for n in ("id", "null", "tag", *[f"level{i}" for i in range(len(levels))])]

    def key(tag: Column) -> list[Column]:
        groups = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)) for c in levels]
        values = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), tag, *groups]
        return [v.alias(n) for v, n in zip(values, names, strict=True)]

    one = one_row_each(docs.select("*", *key(F.xxhash64("text"))), names)
    taken, of = free_name(docs.columns, "taken"), free_name(docs.columns, "of")
    few = selected.select(*key(F.col("tag")), F.col("taken").alias(taken), F.col("tokens").alias(of))
    joined = one.join(few, names)
    # a leading run of white space is a piece of its own, but no token
    pieces = F.split("text", r"(?<=\s)(?=\S)")
    blank = F.regexp_like("text", F.lit(r"^\s+\S")).cast("int")
    most = F.greatest(F.col(taken), F.lit(0)).cast("int")
    head = F.when(most == 0, "").otherwise(F.array_join(F.slice(pieces, F.lit(1), most + blank), ""))
    text = F.when(F.col(taken) < F.col(of), head).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected from domains, languages and sources by weight; a row per pass."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", domain_of(F.col("source")))
    return mix(docs).drop("tag")


def _level_sql(above: str, here: str, level: str, weight: str) -> str:
    """One level of the budget tree: children of table `p` (columns above, budget) to table `n`."""
    keys = f"{above}, {level}" if above else level
    on = f"USING ({above})" if above else "ON true"
    group = f"PARTITION BY {above}" if above else ""
    return f"""
n_{level} AS (SELECT {keys}, sum(tokens) * {float(EPOCHS)} AS cap FROM leaves GROUP BY {keys}),
l_{level} AS (SELECT n_{level}.*, p.budget AS given, {weight} AS weight FROM n_{level} JOIN {here} p {on}),
m_{level} AS (SELECT *, (given - coalesce(sum(cap) OVER ({group} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({group} ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM l_{level}),
b_{level} AS (SELECT {keys}, least(cap, max(lev) OVER ({group}) * weight) AS budget FROM m_{level})"""


def oracle_sql() -> str:
    """DuckDB SQL for op8_mixing."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, w in WEIGHTS[level].items())
        return f"CASE {level} {cases} ELSE 1.0::DOUBLE END"

    names = {d: ", ".join(f"'{s}'" for s, x in DOMAINS.items() if x == d) for d in sorted(set(DOMAINS.values()))}
    domain = "CASE " + " ".join(f"WHEN source IN ({n}) THEN '{d}'" for d, n in names.items()) + f" ELSE '{OTHER}' END"
    return f"""
WITH rows_ AS (
  SELECT DISTINCT doc_id, {domain} AS domain,
    coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, text,
    coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
root AS (SELECT least(floor(sum(tokens) * {SHARE}::DOUBLE), sum(tokens) * {float(EPOCHS)}) AS budget FROM leaves),
{_level_sql("", "root", "domain", weight("domain"))},
{_level_sql("domain", "b_domain", "lang", weight("lang"))},
{_level_sql("domain, lang", "b_lang", "source", weight("source"))},
plan AS (SELECT leaves.*, floor(budget + 1e-6)::BIGINT AS whole FROM leaves JOIN b_source USING (domain, lang, source)),
parts AS (SELECT domain, lang, source,
    CASE WHEN tokens > 0 THEN whole // tokens ELSE 0 END AS n_full,
    CASE WHEN tokens > 0 THEN whole % tokens ELSE 0 END AS rest FROM plan),
placed AS (SELECT r.*, n_full, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat_ws(':', {SEED}, n_full, coalesce(doc_id::VARCHAR, '{NONE}'))), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
  FROM rows_ r JOIN parts USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, epoch::INTEGER AS epoch,
  CASE WHEN epoch = n_full THEN begin_ END AS "begin",
  CASE WHEN epoch = n_full THEN least(tokens, rest - begin_) ELSE tokens END AS taken
FROM placed, unnest(range(n_full + CASE WHEN begin_ < rest THEN 1 ELSE 0 END)) AS e(epoch)
"""
