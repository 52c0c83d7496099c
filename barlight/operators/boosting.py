"""Stage-wise boosting of Spark ML's regression trees: any loss, early stopping as it goes, several models in step."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.session import removed, written, written_at

#: Learning rate of the trees.
STEP = 0.03
#: Residuals beyond this count as it in the Huber loss.
HUBER = 0.9
#: Medians of leaves and of targets are exact up to so many values, and within 1 in so many ranks beyond.
ACCURACY = 10_000
#: After so many stages the rows are written, which cuts their lineage: all jobs of a stage carry what came since.
CUT = 3
#: Off while stages are cached: an adaptive plan holds its first and its last form, and a cached plan those of the one before, twice as many a stage.
ADAPTIVE_CACHE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


@dataclass(frozen=True)
class Loss:
    """slope(residual): what a stage's tree is fitted to; size(residual): what early stopping compares."""

    slope: Callable[[Column], Column]
    size: Callable[[Column], Column]
    #: Start and leaves are medians of residuals, not means of slopes.
    median: bool = False


def _huber(r: Column) -> Column:
    return F.when(F.abs(r) <= HUBER, r * r / 2).otherwise(HUBER * (F.abs(r) - HUBER / 2))


LOSSES = {
    "squared": Loss(lambda r: r, lambda r: r * r),
    "absolute": Loss(F.signum, F.abs, True),
    "huber": Loss(lambda r: F.greatest(F.lit(-HUBER), F.least(F.lit(HUBER), r)), _huber),
}


@dataclass(frozen=True)
class Job:
    """A model to fit: on which rows, to which column, with which loss, on which rows to stop early, and how many trees at most."""

    fit: Column
    target: str
    loss: str
    trees: int
    valid: Column | None = None


@dataclass(frozen=True)
class Trees:
    """Shape and penalties of the trees; the share of features is drawn anew for each tree. l1 and l2 shrink leaves of means."""

    depth: int = 5
    least_rows: int = 20
    features: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    seed: int = 42


@dataclass
class Boosted:
    """A start value and stages of (features, tree, what each leaf adds). best: the number of stages that are used."""

    start: float
    stages: list[tuple[list[int], DecisionTreeRegressionModel, list[float]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0

    def score(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """rows (with the features as vector __x) with the model's prediction."""
        out = rows.withColumn(name, F.lit(self.start))
        for i, stage in enumerate(self.stages[: self.best]):
            if i and i % CUT == 0:
                out = written(out, "scored")
            out = _moved(out, {name: stage})
        return out


def _moved(rows: DataFrame, stages: dict[str, tuple[list[int], DecisionTreeRegressionModel, list[float]]]) -> DataFrame:
    """rows with each named column moved by its stage."""
    names = rows.columns
    for i, (name, (chosen, tree, adds)) in enumerate(stages.items()):
        rows = VectorSlicer(inputCol="__x", outputCol=f"__s{i}", indices=chosen).transform(rows)
        leaf = f"__leaf{i}"
        rows = tree.copy().setFeaturesCol(f"__s{i}").setLeafCol(leaf).transform(rows)
        add = F.element_at(F.array(*map(F.lit, adds)), F.col(leaf).cast("int") + 1)
        rows = rows.withColumn(name, F.col(name) + add).select(*names, *[c for c in rows.columns if c.startswith(("__s", "__leaf")) and c not in names])
    return rows.select(*names)


def _stage(rows: DataFrame, name: str, job: Job, chosen: list[int], trees: Trees, step: float) -> tuple[list[int], DecisionTreeRegressionModel, list[float]]:
    """One more tree of a job: fitted to the slopes of its loss, its leaves set by a grouped aggregate of residuals."""
    loss, residual = LOSSES[job.loss], F.col(job.target) - F.col(name)
    part = rows.filter(job.fit & F.col(job.target).isNotNull()).select("__x", residual.alias("__r"), loss.slope(residual).alias("__y"))
    part = VectorSlicer(inputCol="__x", outputCol="__s", indices=chosen).transform(part)
    learner = DecisionTreeRegressor(featuresCol="__s", labelCol="__y", predictionCol="", maxDepth=trees.depth, minInstancesPerNode=trees.least_rows)
    tree = learner.fit(part.select("__s", "__y"))
    total = F.sum("__y")
    mean = F.signum(total) * F.greatest(F.abs(total) - trees.l1, F.lit(0.0)) / (F.count("__y") + trees.l2)
    value = F.percentile_approx("__r", 0.5, ACCURACY) if loss.median else mean
    leaves = tree.setLeafCol("__leaf").transform(part).groupBy(F.col("__leaf").cast("int").alias("leaf")).agg(value.alias("value")).collect()
    adds = [0.0] * (max((r.leaf for r in leaves), default=0) + 1)
    for r in leaves:
        adds[r.leaf] = step * r.value
    return chosen, tree, adds


def grow(
    rows: DataFrame, jobs: dict[str, Job], patience: int = 50, step: float = STEP, trees: Trees | None = None, parallel: int = 6
) -> tuple[DataFrame, dict[str, Boosted]]:
    """rows (with the features as vector __x) with a prediction of each job, a column of its name, and the models.

    All jobs go on in step over one cached table, which has a number a row and job: the prediction so
    far. A stage fits a tree a job to the slopes of its loss, sets the leaves by one aggregate, adds
    them to the predictions of all rows, and takes the loss of the rows to stop on from the same pass. A
    job ends at its number of trees, or when its loss has not fallen for `patience` stages; its
    prediction is then that of its best stage. No tree is fitted twice. Rows outside of `fit` are predicted, too.
    Leaves of the absolute loss are medians, of the other losses shrunken means of slopes.
    """
    trees = trees or Trees()
    if rows.isEmpty():
        raise ValueError("no rows to fit on")
    spark = rows.sparkSession
    names = {name: f"__f{i}" for i, name in enumerate(jobs)}
    best = {name: f"__b{i}" for i, name in enumerate(jobs)}
    starts = []
    for job in jobs.values():
        here = F.when(job.fit, F.col(job.target))
        starts.append(F.percentile_approx(here, 0.5, ACCURACY) if LOSSES[job.loss].median else F.avg(here))
    row = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(starts)]).first()
    found = {name: Boosted(float(v or 0.0)) for name, v in zip(jobs, row, strict=True)}
    before = spark.conf.get(ADAPTIVE_CACHE, "true")
    spark.conf.set(ADAPTIVE_CACHE, "false")
    try:
        out = _grown(rows, jobs, found, names, best, patience, step, trees, parallel)
    finally:
        spark.conf.set(ADAPTIVE_CACHE, before)
    return out, found


def _grown(
    rows: DataFrame, jobs: dict[str, Job], found: dict[str, Boosted], names: dict[str, str], best: dict[str, str],
    patience: int, step: float, trees: Trees, parallel: int,
) -> DataFrame:
    """The stages of grow, told in `found`: rows with the prediction of each job's best stage."""
    spark, given, width = rows.sparkSession, rows.columns, len(rows.select("__x").first()[0])
    cached = rows.withColumns({c[n]: F.lit(found[n].start) for c in (names, best) for n in jobs}).persist(StorageLevel.MEMORY_AND_DISK)
    held, path, at = cached, None, 0
    active = [n for n in jobs if jobs[n].trees > 0]
    with ThreadPool(min(parallel, len(jobs))) as pool:
        while active:
            rng = np.random.default_rng([trees.seed, at])
            chosen = sorted(rng.choice(width, max(1, math.floor(trees.features * width)), replace=False).tolist())

            def one(name: str, held: DataFrame = held, chosen: list[int] = chosen) -> tuple:
                return _stage(held, names[name], jobs[name], chosen, trees, step)

            stages = dict(zip(active, pool.map(inheritable_thread_target(spark)(one), active, 1), strict=True))
            at, old, gone = at + 1, cached, None
            new = _moved(held, {names[n]: s for n, s in stages.items()})
            if at % CUT == 0:
                gone = path
                new, path = written_at(new, "stages")
            cached = new.persist(StorageLevel.MEMORY_AND_DISK)
            sizes = {n: LOSSES[jobs[n].loss].size(F.col(jobs[n].target) - F.col(names[n])) for n in active}
            told = [F.lit(None) if jobs[n].valid is None else F.avg(F.when(jobs[n].valid, v)) for n, v in sizes.items()]
            losses = cached.agg(F.count(F.lit(1)), *[t.cast("double").alias(f"l{i}") for i, t in enumerate(told)]).first()[1:]
            old.unpersist()
            if gone:
                removed(spark, gone)
            for n, loss in zip(active, losses, strict=True):
                model = found[n]
                model.stages.append(stages[n])
                if loss is None or loss < min(model.losses, default=math.inf):
                    model.best = at
                if loss is not None:
                    model.losses.append(loss)
            # the prediction of a job's best stage so far
            held = cached.withColumns({best[n]: F.col(names[n]) for n in active if found[n].best == at})
            active = [n for n in active if at < jobs[n].trees and at - found[n].best < patience]
    out = written(held.select(*given, *[F.col(best[n]).alias(n) for n in jobs]), "boosted")
    cached.unpersist()
    if path:
        removed(spark, path)
    return out
