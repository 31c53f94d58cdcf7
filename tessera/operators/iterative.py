"""ML-06 / ML-07 iterative fit: full-batch gradient descent per (ticker, parameter set) with
early stopping on the validation MAE.

One row of state per (ticker, parameter set); every epoch is one pass over the rows: errors are
native expressions, partial gradients are summed per partition and then per model, and no
ticker's rows meet in one task.  The pass that yields the gradient at the weights of an epoch
also yields their validation MAE, so a model that has stopped costs nothing more: its rows are
left out of later passes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import broadcast_bounded, materialize

#: Parameters of a set and their defaults.
DEFAULTS = {"learning_rate": 0.1, "epochs": 100, "patience": 10, "min_delta": 1e-6, "l2": 0.0}
#: Epochs between two looks at whether any model is still learning.
LOOK = 5


def _sets(grid: Sequence[dict]) -> Column:
    unknown = {k for g in grid for k in g} - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    full = [DEFAULTS | dict(g) for g in grid]
    return F.array(*[F.struct(F.lit(i).alias("set_id"), *[F.lit(type(v)(g[k])).alias(k) for k, v in DEFAULTS.items()])
                     for i, g in enumerate(full)])


def fit_iterative(df: DataFrame, grid: Sequence[dict], n_features: int) -> tuple[DataFrame, DataFrame]:
    """Models (tic, set_id, parameters, intercept, coef, val_mae, best_epoch, last_epoch, n_train)
    and the convergence table (tic, set_id, epoch, val_mae, best) of rows (tic, features, target,
    split).

    Weights start at zero; an epoch moves them against the mean gradient of the squared error
    over ``train`` (plus ``l2`` times the coefficients).  An epoch is an improvement if its MAE
    over ``val`` is more than ``min_delta`` below the best; a model stops ``patience`` epochs
    after its last improvement, or after ``epochs``, and keeps its best weights.  Rows without a
    target or with a feature that is null are left out; a ticker without train rows keeps zeros;
    one without validation rows runs all its epochs and keeps the last weights; rows of a null
    ticker are one model; an empty table gives empty ones."""
    x = F.col("features")
    full = (F.size("features") == n_features) & ~F.exists("features", lambda v: v.isNull())
    rows = materialize(df.filter(F.col("target").isNotNull() & F.col("split").isin("train", "val") & full)
                       .select(F.coalesce(F.col("tic").cast("string"), F.lit("\x00null")).alias("tic"), "features",
                               F.col("target").cast("double").alias("target"), "split"), pin=True)
    zero = F.array_repeat(F.lit(0.0), n_features + 1)
    state = (rows.groupBy("tic").agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"))
             .withColumn("_p", F.explode(_sets(grid))).select("tic", "n_train", "_p.*")
             .withColumns({"w": zero, "best_w": zero, "best_mae": F.lit(None).cast("double"),
                           "best_epoch": F.lit(0), "active": F.lit(True), "seen": F.lit(-1)}))
    state = materialize(state, pin=True)
    history, most = [], max((DEFAULTS | dict(g))["epochs"] for g in grid)
    for epoch in range(most + 1):
        state = materialize(_epoch(rows, state, x, n_features, epoch), pin=True)
        history.append(state.filter(F.col("seen") == epoch).select("tic", "set_id", F.lit(epoch).alias("epoch"), "val_mae",
                                                                   (F.col("best_epoch") == epoch).alias("best")))
        if epoch % LOOK == 0 and state.filter("active").isEmpty():
            break
    told = history[0]
    for part in history[1:]:
        told = told.unionByName(part)
    tic = F.when(F.col("tic") != "\x00null", F.col("tic"))
    models = state.select(tic.alias("tic"), "set_id", *DEFAULTS, F.element_at("best_w", -1).alias("intercept"),
                          F.slice("best_w", 1, n_features).alias("coef"), F.col("best_mae").alias("val_mae"), "best_epoch",
                          F.col("seen").alias("last_epoch"), "n_train")
    return models, told.withColumn("tic", tic)


def _epoch(rows: DataFrame, state: DataFrame, x: Column, k: int, epoch: int) -> DataFrame:
    """The state after judging the weights of ``epoch`` and, where the model goes on, the step."""
    live = broadcast_bounded(state.filter("active").select("tic", "set_id", "w"))
    dot = F.aggregate(F.zip_with(x, F.slice("w", 1, k), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    d = rows.join(live, "tic").withColumn("_e", dot + F.element_at("w", -1) - F.col("target"))
    train = F.col("split") == "train"
    sums = d.groupBy("tic", "set_id").agg(
        F.array(*[F.coalesce(F.sum(F.when(train, F.col("_e") * x[i])), F.lit(0.0)) for i in range(k)],
                F.coalesce(F.sum(F.when(train, F.col("_e"))), F.lit(0.0))).alias("_g"),
        F.avg(F.when(~train, F.abs("_e"))).alias("_mae"))
    s = state.drop("val_mae").join(sums, ["tic", "set_id"], "left")
    better = F.col("active") & (F.col("_mae").isNull() | F.col("best_mae").isNull()
                                | (F.col("_mae") < F.col("best_mae") - F.col("min_delta")))
    s = s.withColumns({"_b": better, "seen": F.when(F.col("active"), epoch).otherwise(F.col("seen")), "val_mae": F.col("_mae")})
    s = s.withColumns({"best_mae": F.when(F.col("_b"), F.col("_mae")).otherwise(F.col("best_mae")),
                       "best_epoch": F.when(F.col("_b"), epoch).otherwise(F.col("best_epoch")),
                       "best_w": F.when(F.col("_b"), F.col("w")).otherwise(F.col("best_w"))})
    on = F.col("active") & (F.lit(epoch) < F.col("epochs")) & (F.lit(epoch) - F.col("best_epoch") < F.col("patience"))
    n = F.greatest(F.col("n_train"), F.lit(1))
    step = F.transform(F.arrays_zip("w", "_g"), lambda v, i: v["w"] - F.col("learning_rate") * (
        v["_g"] / n + F.when(i < k, F.col("l2") * v["w"]).otherwise(F.lit(0.0))))
    return s.withColumns({"w": F.when(on, step).otherwise(F.col("w")), "active": on}).drop("_g", "_mae", "_b")


def best_of_grid(models: DataFrame) -> DataFrame:
    """ML-07 the parameter set with the least validation MAE per ticker (ties: the earlier set)."""
    rest = [c for c in models.columns if c != "tic"]
    order = F.struct(F.col("val_mae").isNull(), "val_mae", "set_id")
    return models.groupBy("tic").agg(F.min_by(F.struct(*rest), order).alias("b")).select("tic", "b.*")
