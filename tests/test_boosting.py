"""Stage-wise boosting against a plain second implementation."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from barlight.operators import boosting
from barlight.operators.boosting import Job, Trees

PLAIN = {
    "squared": (lambda r: r, lambda r: r * r),
    "absolute": (np.sign, np.abs),
    "huber": (lambda r: np.clip(r, -0.9, 0.9), lambda r: np.where(np.abs(r) <= 0.9, r * r / 2, 0.9 * (np.abs(r) - 0.45))),
}


def median(values):
    return np.sort(values)[(len(values) + 1) // 2 - 1]


def leaves_of(x, y, depth, least, rows=None):
    """Rows of each leaf of a regression tree, as (condition, fit rows) by greatest fall of variance."""
    rows = np.arange(len(y)) if rows is None else rows
    best = (1e-12, None)
    gains = {}
    for f in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, f])  # cuts are halfway between the values of all rows
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[rows, f] <= cut
            a, b = y[rows][low], y[rows][~low]
            if min(len(a), len(b)) >= least:
                gain = y[rows].var() - (len(a) * a.var() + len(b) * b.var()) / len(rows)
                gains[low.tobytes()] = gain
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
    if best[1] is None:
        return [([], rows)]
    assert sum(g > best[0] - 1e-9 for g in gains.values()) == 1  # no ties, which may go either way
    f, cut = best[1]
    out = []
    for side in (True, False):
        for conditions, held in leaves_of(x, y, depth - 1, least, rows[(x[rows, f] <= cut) == side]):
            out.append(([(f, cut, side), *conditions], held))
    return out


def plain(x, y, fit, valid, loss, trees, patience, step, depth, least, penalty=0.1):
    slope, size = PLAIN[loss]
    pred = np.full(len(y), median(y[fit]) if loss == "absolute" else y[fit].mean())
    best, errors, kept = 0, [], pred
    for at in range(1, trees + 1):
        residual = y - pred
        new = pred.copy()
        for conditions, held in leaves_of(x[fit], slope(residual[fit]), depth, least):
            total = slope(residual[fit][held]).sum()
            value = median(residual[fit][held]) if loss == "absolute" else np.sign(total) * max(abs(total) - penalty, 0) / (len(held) + penalty)
            here = np.all([(x[:, f] <= cut) == side for f, cut, side in conditions], axis=0) if conditions else np.ones(len(y), bool)
            new[here] += step * value
        pred = new
        errors.append(size(y[valid] - pred[valid]).mean())
        if errors[-1] < min(errors[:-1], default=np.inf):
            best, kept = at, pred
        if at - best >= patience:
            break
    return best, errors, kept


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((25, 3)), 3)[rng.integers(0, 25, (n, 3)), np.arange(3)]
    return x, 2 * x[:, 0] + np.sin(6 * x[:, 1]) + rng.standard_t(1.3, n)


def table(spark, n=200, seed=1):
    x, y = drawn(n, seed)
    rows = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="__x").transform(rows).select("i", "y", "__x"), x, y


def test_losses_equal_a_plain_implementation_and_differ(spark, monkeypatch):
    rows, x, y = table(spark)
    fitted = []
    fit_of = DecisionTreeRegressor.fit
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda self, part: fitted.append(1) or fit_of(self, part))
    fit, valid = np.arange(200) % 3 != 0, np.arange(200) % 3 == 0
    jobs = {loss: Job(F.col("i") % 3 != 0, "y", loss, 8, F.col("i") % 3 == 0) for loss in PLAIN}
    found, models = boosting.grow(rows, jobs, patience=3, step=0.3, trees=Trees(depth=3, least_rows=10, features=1.0))
    got = found.orderBy("i").toPandas()
    for loss in PLAIN:
        best, errors, want = plain(x, y, fit, valid, loss, 8, 3, 0.3, 3, 10)
        assert models[loss].best == best and len(models[loss].stages) == len(errors)
        np.testing.assert_allclose(models[loss].losses, errors, rtol=1e-9)
        np.testing.assert_allclose(got[loss], want, atol=1e-9)
    assert len(fitted) == sum(len(m.stages) for m in models.values())  # no tree twice
    assert np.abs(got.huber - got.squared).max() > 0.1 and np.abs(got.huber - got.absolute).max() > 0.01
    again = models["huber"].score(rows, "p").orderBy("i").toPandas().p
    np.testing.assert_allclose(again, got.huber, atol=1e-12)


def test_lineage_is_cut_and_jobs_end_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 2)
    rows, _, y = table(spark, 60)
    rows = rows.withColumn("y", F.when(F.col("i") == 7, F.lit(None)).otherwise(F.col("y")))
    jobs = {"few": Job(F.lit(True), "y", "squared", 1), "more": Job(F.col("i") < 50, "y", "huber", 5), "none": Job(F.lit(True), "y", "absolute", 0)}
    found, models = boosting.grow(rows, jobs, trees=Trees(depth=2, least_rows=5))
    assert [models[n].best for n in jobs] == [1, 5, 0] and found.columns == [*rows.columns, *jobs]
    got = found.orderBy("i").toPandas()
    known = np.delete(y, 7)
    assert (got.none == median(known)).all() and got.more.nunique() > 1 and got.notna().drop(columns="y").all().all()
    assert all(len(chosen) == 2 for chosen, _, _ in models["more"].stages)
    with pytest.raises(ValueError, match="no rows"):
        boosting.grow(rows.limit(0), jobs)
