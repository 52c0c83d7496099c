"""Baselines, ridge by moments, and models of boosted trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.stats import KEY, month
from barlight.operators import targets
from barlight.operators.boosting import STEP, Boosted, Job, Trees, grow
from barlight.operators.features import FEATURES, LABEL
from barlight.operators.metrics import decile_spread, monthly_ic, rank_ic, scores, tail_metrics, trimmed_ic, winner_removal
from barlight.session import shared_dir, written

#: Trees are many small jobs, so a fit's cached rows are read by tasks of at least so many.
TASK_ROWS = 20_000


def zero(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.lit(0.0))


def momentum(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.col("return_3"))


def ridge(train: DataFrame, rows: DataFrame, columns: list[str] = FEATURES, target: str = "target", alpha: float = 1.0) -> DataFrame:
    """rows with a ridge prediction, fitted on train.

    Features are standardised by population deviation, the intercept is not penalised. One
    aggregate gives all first and second moments; the driver solves a system of len(columns)
    unknowns, and the prediction is a linear expression. Constant features weigh nothing.
    """
    k = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = train.agg(
        F.count(F.lit(1)),
        F.avg(target),
        *[F.avg(c) for c in x],
        *[F.covar_pop(x[i], x[j]) for i, j in pairs],
        *[F.covar_pop(c, F.col(target)) for c in x],
    ).first()
    n, mean_y, means = row[0], row[1], np.array(row[2 : 2 + k], float)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[2 + k : 2 + k + len(pairs)], strict=True):
        cov[i, j] = cov[j, i] = v
    with_y = np.array(row[2 + k + len(pairs) :], float)
    std = np.sqrt(np.diag(cov))
    std[std == 0] = np.inf
    weights = np.linalg.solve(n * cov / np.outer(std, std) + alpha * np.eye(k), n * with_y / std) / std
    linear = F.lit(float(mean_y - weights @ means))
    for c, w in zip(x, weights, strict=True):
        linear = linear + c * float(w)
    return rows.withColumn("prediction", linear)


def assembled(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """rows with the features as one vector, added unless it is there."""
    return rows if "__x" in rows.columns else VectorAssembler(inputCols=columns, outputCol="__x").transform(rows)


def prepared(rows: DataFrame, keep: list[str], columns: list[str] = FEATURES) -> DataFrame:
    """The columns `keep` and the features as a vector, written once: every stage of all fits reads them in tasks of at least TASK_ROWS rows."""
    table = written(assembled(rows, columns).select(*keep, "__x"), "vectors")
    return table.coalesce(max(1, math.ceil(table.count() / TASK_ROWS)))


def boosted(
    rows: DataFrame, jobs: dict[str, Job], keep: list[str], patience: int = 50, step: float = STEP, trees: Trees | None = None
) -> tuple[DataFrame, dict[str, Boosted]]:
    """rows' columns `keep` with a prediction of each job (a column of its name), and the models, all fitted in step.

    The jobs' filters and targets are of columns in `keep`.
    """
    shared_dir(rows.sparkSession, "trees")  # sees to a folder for what stages write
    found, models = grow(prepared(rows, keep), jobs, patience, step, trees)
    return found.drop("__x"), models


def tagged(found: DataFrame, names: list[str]) -> DataFrame:
    """A row per row and model: `prediction` of each named column, tagged with `model`."""
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n in names])
    return found.withColumn("__each", F.explode(each)).select(*[c for c in found.columns if c not in names], "__each.*")


def comparison(
    rows: DataFrame, fit: Column, valid: Column, losses: dict[str, str], trees: int, patience: int = 50, step: float = STEP, keep: tuple[str, ...] = (LABEL,)
) -> DataFrame:
    """Predictions of `target` on the valid rows by a model per loss (squared, absolute or huber), rows tagged with `model`."""
    jobs = {name: Job(fit, "target", loss, trees, valid) for name, loss in losses.items()}
    found, _ = boosted(rows, jobs, [KEY, "ts", "target", *keep], patience, step)
    return tagged(found.filter(valid), list(jobs))


def model_scores(predicted: DataFrame) -> DataFrame:
    """Errors, correlations and trimmed correlations of each model.

    The ranks of a model's rows come from range partitions, as those of a series do.
    """
    trimmed = trimmed_ic(predicted, ["model"]).select(
        "model", F.col("pearson_ic").alias("trimmed_pearson_ic"), F.col("spearman_ic").alias("trimmed_spearman_ic")
    )
    return (
        scores(predicted, ["model"])
        .join(rank_ic(predicted, ["model"]).select("model", "spearman_ic"), "model")
        .join(trimmed, "model")
    )


def target_scores(predicted: DataFrame, tail: float = 0.01) -> DataFrame:
    """All scores of each model: as model_scores, deciles, tails, monthly correlations, winners removed."""
    out = model_scores(predicted)
    for part in (decile_spread(predicted, ["model"]), tail_metrics(predicted, ["model"], tail), monthly_ic(predicted, ["model"]), winner_removal(predicted, ["model"], tail)):
        out = out.join(part, "model")
    return out


def best_model(predicted: DataFrame) -> DataFrame:
    """Predictions of the model with the highest trimmed Spearman correlation, then Spearman."""
    top = model_scores(predicted).orderBy(F.desc_nulls_last("trimmed_spearman_ic"), F.desc_nulls_last("spearman_ic"), "model")
    return predicted.join(F.broadcast(top.limit(1).select("model")), "model", "left_semi")


def walkforward(
    rows: DataFrame,
    months: list[str],
    horizon_seconds: int,
    trees: int,
    inner_days: int = 30,
    skip_empty: bool = False,
    parallel: int = 6,
    clip: tuple[float, float] = (0.005, 0.995),
    patience: int = 50,
    step: float = STEP,
    loss: str = "absolute",
) -> DataFrame:
    """Predictions of each month by trees fitted on the purged past; folds are filters on one table.

    rows have `target`. The number of trees is chosen on the last `inner_days` before the purge.
    Targets are clipped to quantiles of their series: in the search to those of the rows that it fits
    on, in the refit to those of all purged rows before the month, which `targets.folds` lists too.
    Months without rows to predict are skipped; a month with nothing to fit or validate on raises
    an error, or is left out with skip_empty. `parallel` folds go on in step over one cached table, which
    has the features once, and a target and a prediction of each of these folds.
    """
    rows = prepared(rows, [KEY, "ts", "target"])
    seconds = F.unix_seconds("ts")
    folds = {}
    for at in months:
        begin = F.unix_seconds(F.to_timestamp(F.lit(f"{at}-01")))
        inner, end = begin - inner_days * 86_400, begin - horizon_seconds
        folds[at] = (seconds < inner - horizon_seconds, (seconds >= inner) & (seconds < end), seconds < end, month(F.col("ts")) == at)
    held = [F.count_if(c) for fit, valid, _, here in folds.values() for c in (fit, valid, here)]
    counts = rows.agg(F.count(F.lit(1)), *held).first()[1:]
    used = []
    for i, at in enumerate(folds):
        fit, valid, here = counts[3 * i : 3 * i + 3]
        if here and fit and valid:
            used.append(at)
        elif here and not skip_empty:
            raise ValueError(f"empty fold {at}")
    if not used:
        raise ValueError("no months to predict")
    used.sort()
    purged = {"fit": inner_days * 86_400 + horizon_seconds, "all": horizon_seconds}
    bounds = {kind: written(targets.past_bounds(rows, used, before, clip), "bounds") for kind, before in purged.items()}

    def with_targets(group: list[str], kind: str) -> DataFrame:
        """Rows up to the last month of a group, with a target clipped for each of its folds: a row of bounds a series is joined."""
        here = bounds[kind].filter(F.col("month").isin(group))
        wide = here.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("month", "q"))).alias("__q"))
        out = rows.filter(month(F.col("ts")) <= group[-1]).join(wide, KEY, "left")
        q = {at: F.try_element_at("__q", F.lit(at)) for at in group}
        return out.withColumns({f"t_{at}": targets.within(F.col("target"), q[at][0], q[at][1]) for at in group}).drop("__q", "target")

    out = None
    for i in range(0, len(used), parallel):
        group = used[i : i + parallel]
        search = {at: Job(folds[at][0], f"t_{at}", loss, trees, folds[at][1]) for at in group}
        best = {at: model.best for at, model in grow(with_targets(group, "fit"), search, patience, step)[1].items()}
        again = {at: Job(folds[at][2], f"t_{at}", loss, best[at]) for at in group}
        found = tagged(grow(with_targets(group, "all"), again, patience, step)[0].select(KEY, "ts", *group), group)
        found = found.filter(month(F.col("ts")) == F.col("model")).withColumnRenamed("model", "prediction_month")
        chosen = F.create_map(*[x for at in group for x in (F.lit(at), F.lit(best[at]))])
        found = found.withColumn("best_iteration", chosen[F.col("prediction_month")])
        found = found.select(KEY, "ts", "prediction", "prediction_month", "best_iteration")
        out = found if out is None else out.unionByName(found)
    return out


def fold_report(folds: DataFrame, predictions: DataFrame) -> DataFrame:
    """The fold table with the number of trees that each month's predictions were made with."""
    chosen = predictions.select(KEY, F.col("prediction_month").alias("month"), "best_iteration").distinct()
    return folds.join(chosen, [KEY, "month"])
