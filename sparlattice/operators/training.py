"""Linear energy models: error statistics, weights, Gram matrices, solvers, folds.

Rows stay in Spark; what reaches the driver is p x p, p being the number of
features, never anything of the length of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widest feature row whose Gram matrix is gathered.
MAX_FEATURES = 5_000


def error_stats(rows: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = (), scale: Column | None = None) -> DataFrame:
    """(keys..., n, mae, rmse, max_abs) of errors, divided by ``scale`` (sites per primitive cell)."""
    e = truth - predicted if scale is None else (truth - predicted) / scale
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs"))


def balance_applies(weighting: dict | None) -> bool:
    """Whether a weighting asks for balance: its scheme, "" if missing, is a part of
    the name, so that a weighting without a scheme asks for it too."""
    return weighting is not None and str(weighting.get("scheme", "")) in "balance_by_comp"


def balance_weights(rows: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """(keys..., n, weight): n^-alpha for each row of a group of n, scaled to a mean of 1 over all rows.

    One row a group: join it to the data rows.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    raw = n.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(-float(alpha))))
    total = F.broadcast(raw.agg((F.sum("n") / F.sum(F.col("n") * F.col("raw"))).alias("factor")))
    return raw.crossJoin(total).select(*keys, "n", (F.col("raw") * F.col("factor")).alias("weight"))


def span(rows: DataFrame, keys: Sequence[str], energy: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(energy).alias("low"), F.max(energy).alias("high"), (F.max(energy) - F.min(energy)).alias("width"))


def column_moments(rows: DataFrame, features: str) -> DataFrame:
    """(feature, mean, std, constant): population moments of each feature."""
    wide = rows.select(F.posexplode(features).alias("feature", "x"))
    x = F.col("x").cast("double")
    return wide.groupBy("feature").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).withColumn("constant", F.col("std") <= 1e-12)


def feature_matrix(column: pa.Array) -> np.ndarray:
    """Rows of features as a matrix; ValueError for a row without features, one of
    another length, or a missing value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("a row has no features, or one of them is missing")
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("rows have different numbers of features")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram_rows(rows: DataFrame, features: str, target: str | None = None, weight: str | None = None, fold: str | None = None) -> DataFrame:
    """(fold, i, j, g): sums of w x_i x_j for i <= j; with a target its products are column p.

    Each task multiplies its batches and emits one upper triangle a fold; the
    triangles are summed by a grouped aggregate.
    """
    columns = [F.col(features).cast("array<double>").alias("x")]
    columns.append((F.col(target) if target else F.lit(0.0)).cast("double").alias("y"))
    columns.append((F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    columns.append((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = feature_matrix(batch.column(0))
            if x.shape[1] > MAX_FEATURES:
                raise ValueError(f"{x.shape[1]} features; at most {MAX_FEATURES}")
            if target:
                x = np.column_stack([x, batch.column(1).to_numpy()])
            w, f = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for k in np.unique(f).tolist():
                part = x[f == k]
                sums[k] = sums.get(k, 0) + (part * w[f == k, None]).T @ part
        for k, g in sums.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], names=["fold", "i", "j", "g"])

    parts = rows.select(*columns).mapInArrow(run, "fold int, i int, j int, g double")
    return parts.groupBy("fold", "i", "j").agg(F.sum("g").alias("g"))


def gathered(gram: DataFrame) -> dict[int, np.ndarray]:
    """{fold: symmetric matrix} from (fold, i, j, g) rows."""
    rows = gram.toPandas()
    out = {}
    for k, part in rows.groupby("fold"):
        p = int(part["j"].max()) + 1
        g = np.zeros((p, p))
        g[part["i"], part["j"]] = part["g"]
        out[int(k)] = g + np.triu(g, 1).T
    return out


def solve(xx: np.ndarray, xy: np.ndarray, n: int, kind: str = "ols", alpha: float = 0.0, l1_ratio: float = 0.5, max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """Coefficients from X'X and X'y, without an intercept.

    ``ols``: least norm. ``ridge``: (X'X + alpha I) b = X'y. ``lasso`` and
    ``elasticnet``: 1/(2n) |y - Xb|^2 + alpha l1_ratio |b|_1 +
    alpha (1 - l1_ratio)/2 |b|^2 by cyclic coordinate descent.
    """
    if kind == "ols":
        return np.linalg.lstsq(xx, xy, rcond=None)[0]
    if kind == "ridge":
        return np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    if kind not in ("lasso", "elasticnet"):
        raise ValueError(f"unknown regularization {kind!r}")
    l1 = alpha * n * (1.0 if kind == "lasso" else l1_ratio)
    l2 = 0.0 if kind == "lasso" else alpha * n * (1 - l1_ratio)
    b = np.zeros(len(xy))
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(b)):
            if xx[j, j] == 0:
                continue
            rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2)
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < tol:
            break
    return b


def fit(rows: DataFrame, features: str, target: str, weight: str | None = None, **how) -> np.ndarray:
    """Coefficients of the rows; ValueError without rows."""
    grams = gathered(gram_rows(rows, features, target, weight))
    if not grams:
        raise ValueError("no rows to fit")
    g = grams[0]
    return solve(g[:-1, :-1], g[:-1, -1], rows.count(), **how)


def folds(rows: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with a column fold in 0..k-1 by a hash of the key: no row order, no driver permutation."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def sklearn_folds(n: int, seed: int, k: int = 5) -> np.ndarray:
    """Fold of each of ``n`` rows: a seeded shuffle cut into min(k, n) parts, the first n mod k one longer."""
    k = min(k, n)
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    out = np.empty(n, dtype=int)
    for f, part in enumerate(np.array_split(order, k)):
        out[part] = f
    return out


def cross_validated(rows: DataFrame, features: str, target: str, fold: str = "fold", weight: str | None = None, **how) -> DataFrame:
    """``rows`` with a column predicted, each from the other folds' rows.

    One pass gives every fold's Gram matrix; a fold's training matrix is the
    total without its own.
    """
    grams = gathered(gram_rows(rows, features, target, weight, fold))
    sizes = {r[fold]: r["n"] for r in rows.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    if len(grams) < 2:
        raise ValueError("cross-validation needs two folds with rows")
    total, n = sum(grams.values()), sum(sizes.values())
    x = F.col(features)
    predicted = F.lit(None).cast("double")
    for f, own in grams.items():
        rest = total - own
        b = solve(rest[:-1, :-1], rest[:-1, -1], n - sizes[f], **how)
        weights = F.array(*(F.lit(float(c)) for c in b))
        value = F.aggregate(F.zip_with(x, weights, lambda a, c: a.cast("double") * c), F.lit(0.0), lambda s, v: s + v)
        predicted = F.when(F.col(fold) == f, value).otherwise(predicted)
    return rows.withColumn("predicted", predicted)


def verdicts(base: DataFrame, refined: DataFrame, key: str, atol: float = 1e-6, rtol: float = 1e-8) -> DataFrame:
    """(key, base, refined, verdict): which of two errors is lower, within max(atol, rtol |base|)."""
    rows = base.select(key, F.col("error").alias("base")).join(refined.select(key, F.col("error").alias("refined")), key)
    tol = F.greatest(F.lit(atol), F.lit(rtol) * F.abs("base"))
    d = F.col("refined") - F.col("base")
    return rows.withColumn("verdict", F.when(F.abs(d) <= tol, "same").when(d < 0, "refined better").otherwise("base better"))


#: Tolerances of a verification. Fixed values.
ATOL, RTOL = 1e-6, 1e-8
FIGURES = ("mae", "rmse", "max_abs")


def predictions(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` once for each part: ``in_sample`` by a model's own coefficients, ``cv`` by those fitted without the row's fold.

    ``rows``: (model, grp, fold, x, y, ...); ``models``: (model, fold, coefficients), fold
    null for the model itself. All models are scored in one pass; a row whose
    coefficients aren't stored has no prediction of that part.
    """
    own = models.where("fold IS NULL").select("model", F.col("coefficients").alias("__in"))
    without = models.where("fold IS NOT NULL").select("model", "fold", F.col("coefficients").alias("__out"))
    both = rows.join(own, "model", "left").join(without, ["model", "fold"], "left")
    parts = F.array(*(F.struct(F.lit(part).alias("part"), F.col(c).alias("b")) for part, c in (("in_sample", "__in"), ("cv", "__out"))))
    each = both.withColumn("__p", F.explode(parts)).where("__p.b IS NOT NULL")
    fits = F.assert_true(F.col("__p.b").isNull() | (F.size("x") == F.size("__p.b")), F.lit("a row and its model have different numbers of features")).isNull()
    value = F.aggregate(F.zip_with("x", "__p.b", lambda a, c: a.cast("double") * c), F.lit(0.0), lambda s, v: s + v)
    return each.where(fits).select(*rows.columns, F.col("__p.part").alias("part"), value.alias("predicted"))


def model_statistics(rows: DataFrame, models: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """(model, part, grp, n, mae, rmse, max_abs) of all models in one pass: over all rows (grp null) and by group."""
    e = (F.col("y") - F.col("predicted")) / (F.lit(float(scale)) if not isinstance(scale, Column) else scale)
    scored = predictions(rows, models).select("model", "part", F.struct("grp").alias("g"), e.alias("e"))
    sums = scored.rollup("model", "part", "g").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.max(F.abs("e")).alias("max_abs"), F.grouping_id().alias("__level"))
    return sums.where("__level <= 1").select("model", "part", F.col("g.grp").alias("grp"), F.when(F.col("__level") == 1, "all").otherwise("group").alias("scope"), "n", *FIGURES)


def verification(stored: DataFrame, rows: DataFrame, models: DataFrame, scale: Column | float = 1.0, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """(model, part, scope, grp, n, stored_<figure>, <figure>, verdict) of each stored or recomputed line of statistics.

    ``stored``: (model, part, scope, grp, n, mae, rmse, max_abs). ``verdict``: ``same`` if the
    counts are equal and each figure lies within max(atol, rtol |stored|); ``differs``; ``not stored``; ``not found``.
    """
    now = model_statistics(rows, models, scale)
    on = ["model", "part", "scope"]
    then = stored.select(*(F.col(c).alias(f"__{c}") for c in (*on, "grp")), F.col("n").alias("stored_n"), *(F.col(f).cast("double").alias(f"stored_{f}") for f in FIGURES))
    match = F.lit(True)
    for c in (*on, "grp"):
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = now.withColumn("__now", F.lit(True)).join(then.withColumn("__then", F.lit(True)), match, "full_outer")
    same = F.col("n") == F.col("stored_n")
    for f in FIGURES:
        same = same & (F.abs(F.col(f) - F.col(f"stored_{f}")) <= F.greatest(F.lit(atol), F.lit(rtol) * F.abs(f"stored_{f}")))
    verdict = F.when(F.col("__then").isNull(), "not stored").when(F.col("__now").isNull(), "not found").when(same, "same").otherwise("differs")
    return both.select(*(F.coalesce(c, f"__{c}").alias(c) for c in on), F.when(F.col("__now"), F.col("grp")).otherwise(F.col("__grp")).alias("grp"), "n", *(x for f in FIGURES for x in (f"stored_{f}", f)), verdict.alias("verdict"))
