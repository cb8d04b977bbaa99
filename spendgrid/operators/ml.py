"""Credit scoring, regression metrics and causal effects.

Feature engineering is DataFrame expressions; models are Spark ML estimators; metrics
are aggregates. Cross-fitted nuisances with one covariate use closed-form OLS on
complement sums (total minus the fold), so every fold is fitted from one aggregate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.functions.windows import global_index
from spendgrid.operators import forest
from spendgrid.session import stored

def sig(x: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (scale-free, so sums of large values made in
    a different order still agree)."""
    e = F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), e)
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x / p, digits - 1) * p)


def category_levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels of a categorical column: each becomes a column of the result."""
    return [r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).orderBy(col).collect()]


def credit_features(train: DataFrame, categorical: list[str], numeric: list[str], apply_to: DataFrame | None = None,
                    key: str = "id") -> DataFrame:
    """M1: one-hot with the first level dropped (unknown levels -> all zeros) and standard
    scaling with the *population* sd, both learned on ``train`` and applied to
    ``apply_to`` (default: train)."""
    target = train if apply_to is None else apply_to
    cols: list[Column] = [F.col(key)]
    for c in categorical:
        for lv in category_levels(train, c)[1:]:
            cols.append((F.col(c) == F.lit(lv)).cast("double").alias(f"{c}={lv}"))
    each = [F.avg(c).alias(f"m_{c}") for c in numeric], [F.stddev_pop(c).alias(f"s_{c}") for c in numeric]
    stats = train.agg(F.struct(*each[0], *each[1]).alias("s")).scalar() if numeric else None  # one pass for all
    for c in numeric:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        sd = F.when(s == 0, F.lit(1.0)).otherwise(s)
        cols.append(((F.col(c).cast("double") - m) / sd).alias(f"z_{c}"))
    return target.select(*cols)


def sequential_split(df: DataFrame, order: list[str], test_frac: float = 0.2) -> DataFrame:
    """M2: the first ``n - ceil(test_frac * n)`` rows (by ``order``) are train, the rest
    test; adds ``idx`` and ``split``."""
    n = df.count()
    n_train = n - math.ceil(test_frac * n)
    g = global_index(df, order)
    return g.withColumn("split", F.when(F.col("idx") < n_train, "train").otherwise("test"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M4: per class precision, recall, F1 and support, plus accuracy, macro and weighted
    averages (zero division -> 0)."""
    p = pred.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
    classes = p.select(F.col("y").alias("c")).union(p.select(F.col("p").alias("c"))).distinct()
    cnt = p.groupBy("y", "p").agg(F.count(F.lit(1)).alias("k"))
    tp = cnt.filter(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("k").alias("tp"))
    sup = cnt.groupBy(F.col("y").alias("c")).agg(F.sum("k").alias("support"))
    npred = cnt.groupBy(F.col("p").alias("c")).agg(F.sum("k").alias("npred"))
    per = classes.join(tp, "c", "left").join(sup, "c", "left").join(npred, "c", "left").fillna(0, ["tp", "support", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    total = p.select(F.count(F.lit(1))).scalar()
    hit = (F.col("y") == F.col("p")).cast("double")
    rows = per.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1"), F.sum("support").cast("double").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), F.lit(total).cast("double").alias("support"))
    accuracy = p.agg(F.lit("accuracy").alias("class"), F.avg(hit).alias("precision"), F.avg(hit).alias("recall"),
                     F.avg(hit).alias("f1"), F.count(F.lit(1)).cast("double").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)
    return out.select("class", *[F.round(c, 10).alias(c) for c in ("precision", "recall", "f1")], "support")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6: R^2 = 1 - SS_res / SS_tot and MAE."""
    p = pred.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
    mean = p.agg(F.avg("y")).first()[0]  # one scalar; predictions may come from a model
    g = p.agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("ss_res"), F.sum((F.col("y") - mean) ** 2).alias("ss_tot"),
              F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return g.select(F.round(1 - F.col("ss_res") / F.col("ss_tot"), 8).alias("r2"), F.round("mae", 6).alias("mae"))


def decision_band(prob: Column) -> Column:
    """M7: probability in percent -> likely approve (> 70), manual review (> 40), reject."""
    return F.when(prob > 70, "likely_approve").when(prob > 40, "manual_review").otherwise("reject")


def fit_approval(train: DataFrame, features: list[str], label: str = "label", trees: int = 100, seed: int = 42):
    """M3: random forest classifier (100 trees, fixed seed) on assembled features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=features, outputCol="features")
    rf = RandomForestClassifier(numTrees=trees, seed=seed, labelCol=label, featuresCol="features")
    return Pipeline(stages=[va, rf]).fit(train)


def fit_amount(train: DataFrame, features: list[str], label: str = "amount", alpha: float = 1.0):
    """M5: ridge regression with penalty ``alpha`` on the unscaled features; Spark's
    ``regParam`` scales the penalty by 1/n, hence ``alpha / n``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    n = train.count()
    va = VectorAssembler(inputCols=features, outputCol="features")
    lr = LinearRegression(labelCol=label, featuresCol="features", regParam=alpha / n, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[va, lr]).fit(train)


def _ols1_by_fold(df: DataFrame, target: str, x: str, folds: int) -> DataFrame:
    """Per fold k: slope/intercept of ``target ~ x`` fitted on all *other* folds, from
    complement sums (total minus fold) of one grouped aggregate."""
    s = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(target).alias("sy"),
                               F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(target)).alias("sxy"))
    tot = s.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    c = s
    for col in ("n", "sx", "sy", "sxx", "sxy"):
        c = c.withColumn(f"c_{col}", tot.select(f"t_{col}").scalar() - F.col(col))
    slope = (F.col("c_sxy") - F.col("c_sx") * F.col("c_sy") / F.col("c_n")) / (F.col("c_sxx") - F.col("c_sx") * F.col("c_sx") / F.col("c_n"))
    c = c.withColumn("b", slope).withColumn("a", (F.col("c_sy") - F.col("b") * F.col("c_sx")) / F.col("c_n"))
    return c.select("fold", "a", "b")


def _moments(df: DataFrame, groups: list[str], cols: list[str]) -> dict[tuple, np.ndarray]:
    """Sums of all products of ``(1, *cols)`` per group: a partial sum for each Arrow batch in the
    tasks, added up by an aggregate. What is collected is (columns + 1)^2 numbers a group."""
    k = len(groups)

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k, b.num_columns)]])
            keys = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            found = np.unique(keys, axis=0)
            sums = [(x[(keys == g).all(axis=1)].T @ x[(keys == g).all(axis=1)]).ravel() for g in found]
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.float64()))], ["g", "m"])

    rows = df.select(*[F.col(g).cast("bigint") for g in groups], *[F.col(c).cast("double") for c in cols])
    sums = rows.mapInArrow(partial, "g array<bigint>, m array<double>").select("g", F.posexplode("m").alias("i", "v"))
    out: dict[tuple, np.ndarray] = {}
    for r in sums.groupBy("g", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(tuple(r["g"]), np.zeros((len(cols) + 1) ** 2))[r["i"]] = r["v"]
    return {g: m.reshape(len(cols) + 1, -1) for g, m in out.items()}


LASSO_PENALTIES, LASSO_RANGE = 100, 1e-3


def _lasso_path(m: np.ndarray, penalties: np.ndarray, intercept: bool, tol: float = 1e-10, sweeps: int = 1000):
    """Lasso coefficients ``(intercept, w)`` for each penalty, from moments with the target last:
    coordinate descent on ``|y - Xw|^2 / 2n + penalty |w|``, each penalty from the one before."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0] if intercept else np.zeros(len(m) - 1)
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    gram, cross, size = centred[:-1, :-1] / n, centred[:-1, -1] / n, np.diag(centred)[:-1] / n
    w = np.zeros(len(size))
    for penalty in penalties:
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(size > 0):
                pull = cross[j] - gram[j] @ w + size[j] * w[j]
                new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / size[j]
                moved = max(moved, abs(new - w[j]) * np.sqrt(size[j]))
                w[j] = new
            if moved <= tol * (1.0 + np.sqrt(max(centred[-1, -1] / n, 0.0))):
                break
        yield mean[-1] - mean[:-1] @ w, w.copy()


def lasso_cv(folds: dict[int, np.ndarray], intercept: bool = True) -> tuple[float, np.ndarray, float]:
    """``(intercept, w, penalty)``: a lasso whose penalty has the least mean squared error over the
    folds, among ``LASSO_PENALTIES`` log-spaced from the smallest that leaves no coefficient.
    ``folds``: moments of each fold with the target last."""
    total = sum(folds.values())
    mean = total[0, 1:] / total[0, 0] if intercept else np.zeros(len(total) - 1)
    cross = total[1:-1, -1] / total[0, 0] - mean[:-1] * mean[-1]
    top = max(np.abs(cross).max(), 1e-300)
    penalties = np.geomspace(top, top * LASSO_RANGE, LASSO_PENALTIES)
    loss = np.zeros(len(penalties))
    for held in folds.values():
        for i, (b, w) in enumerate(_lasso_path(total - held, penalties, intercept)):
            v = np.concatenate([[-b], -w, [1.0]])  # y - b - w x
            loss[i] += (v @ held @ v) / held[0, 0] / len(folds)
    best = int(loss.argmin())
    *_, (b, w) = _lasso_path(total, penalties[: best + 1], intercept)
    return float(b), w, float(penalties[best])


#: Rows of a task that fits forests; rows up to which Spark ML fits them.
FOREST_ROWS, FITTED_ROWS = 65_536, 1 << 19


def _spread(df: DataFrame) -> DataFrame:
    """``df`` stored in files of about ``FOREST_ROWS`` rows, so that a fit is shared by tasks whatever the files it came from."""
    return stored(df.repartition(max(1, -(-df.count() // FOREST_ROWS))), "forest-rows")


NUISANCES = ("ols1", "linear", "forest", "lasso")


def double_ml(df: DataFrame, y: str, t: str, xs: list[str], folds: int = 5, nuisance: str = "lasso") -> DataFrame:
    """M8: cross-fitted double ML. Nuisances E[Y|X] and E[T|X] are fitted on the other
    folds and predicted on each fold; tau = sum(t~ y~) / sum(t~^2),
    se = sqrt(mean(e^2) / sum(t~^2)) with e = y~ - tau t~, CI = tau +- 1.96 se.

    ``nuisance``: ``'lasso'`` chooses each penalty by 5-fold cross-validation inside the other
    folds, from one pass of moments; ``'ols1'`` is the closed form for one covariate;
    ``'linear'`` and ``'forest'`` are Spark ML models fitted per fold on the complement; forests of more than
    ``FITTED_ROWS`` rows and few covariates grow from sums per cell, of which one pass serves all folds.
    """
    if nuisance not in NUISANCES:
        raise ValueError(f"nuisance {nuisance!r}; one of {NUISANCES}")
    if nuisance == "ols1" and len(xs) != 1:
        raise ValueError("'ols1' takes one covariate")
    d = df.select("fold", F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("t"),
                  *[F.col(x).cast("double").alias(x) for x in xs])
    if nuisance == "ols1":
        x = xs[0]
        my = _ols1_by_fold(d, "y", x, folds).select("fold", F.col("a").alias("ay"), F.col("b").alias("by"))
        mt = _ols1_by_fold(d, "t", x, folds).select("fold", F.col("a").alias("at"), F.col("b").alias("bt"))
        r = d.join(F.broadcast(my), "fold").join(F.broadcast(mt), "fold")
        r = r.select((F.col("y") - (F.col("ay") + F.col("by") * F.col(x))).alias("ry"),
                     (F.col("t") - (F.col("at") + F.col("bt") * F.col(x))).alias("rt"))
    elif nuisance == "lasso":
        d = d.withColumn("_inner", F.pmod(F.xxhash64("y", "t", *xs), F.lit(5)))
        m = _moments(d, ["fold", "_inner"], [*xs, "y", "t"])
        p = len(xs) + 1
        fitted = {"y": None, "t": None}
        for target, at in (("y", p), ("t", p + 1)):
            pick = np.array([*range(p), at])
            for k in range(folds):
                inner: dict[int, np.ndarray] = {}
                for (fold, i), v in m.items():
                    if fold != k:
                        inner[i] = inner.get(i, 0) + v[np.ix_(pick, pick)]
                b, w, _ = lasso_cv(inner)
                e = F.lit(b)
                for x, c in zip(xs, w, strict=True):
                    e = e + F.lit(float(c)) * F.col(x)
                fitted[target] = F.when(F.col("fold") == k, e) if fitted[target] is None else fitted[target].when(F.col("fold") == k, e)
        r = d.select((F.col("y") - fitted["y"]).alias("ry"), (F.col("t") - fitted["t"]).alias("rt"))
    elif nuisance == "forest" and forest.fits(len(xs)) and d.count() > FITTED_ROWS:
        r = forest.residuals(stored(d, "forest-rows"), xs, folds)
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression, RandomForestRegressor

        va = VectorAssembler(inputCols=xs, outputCol="features")
        dv = va.transform(_spread(d) if nuisance == "forest" else d)
        parts = []
        for k in range(folds):
            train, test = dv.filter(F.col("fold") != k), dv.filter(F.col("fold") == k)
            mk = (lambda lab: LinearRegression(labelCol=lab, featuresCol="features")) if nuisance == "linear" else \
                (lambda lab: RandomForestRegressor(labelCol=lab, featuresCol="features", numTrees=50, seed=42))
            py = mk("y").fit(train).transform(test).withColumnRenamed("prediction", "py")
            pt = mk("t").fit(train).setPredictionCol("pt").transform(py)
            parts.append(pt.select((F.col("y") - F.col("py")).alias("ry"), (F.col("t") - F.col("pt")).alias("rt")))
        r = parts[0]
        for p in parts[1:]:
            r = r.unionByName(p)
        r = stored(r, "residuals")  # predictions are made once
    s = r.agg(F.sum(F.col("rt") * F.col("ry")).alias("stt_y"), F.sum(F.col("rt") * F.col("rt")).alias("stt"), F.count(F.lit(1)).alias("n"))
    s = stored(s, "residual-sums")  # one row, read twice
    tau = F.col("stt_y") / F.col("stt")
    tau_v = s.select(tau).first()[0]  # one scalar per fit
    e2 = r.agg(F.avg((F.col("ry") - F.lit(tau_v) * F.col("rt")) ** 2)).first()[0]
    se = F.sqrt(F.lit(e2) / F.col("stt"))
    return s.select(sig(tau).alias("tau"), sig(se).alias("se"), sig(tau - 1.96 * se).alias("ci_lo"),
                    sig(tau + 1.96 * se).alias("ci_hi"), "n")


def naive_ols(df: DataFrame, y: str, t: str, x: str) -> DataFrame:
    """M9: coefficient of T in the OLS of Y on (T, X), closed form from centred sums."""
    m = df.select(F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"))
    g = m.agg(F.covar_pop("t", "y").alias("sty"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("t").alias("stt"),
              F.var_pop("x").alias("sxx"), F.covar_pop("t", "x").alias("stx"))
    beta = (F.col("sxx") * F.col("sty") - F.col("stx") * F.col("sxy")) / (F.col("stt") * F.col("sxx") - F.col("stx") ** 2)
    return g.select(sig(beta).alias("ols_t"))


def naive_lasso(df: DataFrame, y: str, t: str, xs: list[str], fold: str = "fold") -> DataFrame:
    """M9: coefficient of T in a lasso of Y on (T, X...), the penalty by cross-validation over
    the folds in ``fold``; one pass over the data."""
    m = _moments(df, [fold], [t, *xs, y])
    _, w, penalty = lasso_cv({k[0]: v for k, v in m.items()})
    return df.sparkSession.createDataFrame([(float(w[0]), penalty)], "lasso_t double, penalty double")


def sparse_fit(df: DataFrame, y: str, xs: list[str], fold: str = "fold") -> np.ndarray:
    """Coefficients of a lasso without intercept, the penalty by cross-validation over the
    folds in ``fold``; one pass over the data."""
    m = _moments(df, [fold], [*xs, y])
    return lasso_cv({k[0]: v for k, v in m.items()}, intercept=False)[1]


def matching_pursuit(df: DataFrame, y: str, xs: list[str], k: int, tol: float = 1e-12) -> np.ndarray:
    """Coefficients of orthogonal matching pursuit without intercept, at most ``k`` of them non-zero.

    Each step takes the column that correlates most with the residual, per unit of its length (the
    first of equals), and refits all columns taken. One aggregate a step sums the products of the
    new column with all others; from those follow the residual's correlations, and a Cholesky
    factor that grows by a row. Columns that the taken ones already span are passed over. It ends
    early when the residual's square is below ``tol`` times that of ``y``. Rows with a null are
    left out; what is collected is one number per column and step.
    """
    d = stored(df.select(*[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna(), "pursuit")
    names = [f"c{i}" for i in range(len(xs))]

    def products(c):  # of one column with every column
        row = d.agg(*[F.coalesce(F.sum(F.col(x) * F.col(c)), F.lit(0.0)).alias(n) for x, n in zip(xs, names, strict=True)]).first()
        return np.array([row[n] for n in names])

    size = d.agg(*[F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0.0)).alias(n) for x, n in zip([*xs, y], [*names, "y"], strict=True)]).first()
    total, size = size["y"], np.array([size[n] for n in names])
    target = products(y)
    taken, gram, factor = [], np.zeros((0, len(xs))), np.zeros((0, 0))
    free, w = size > 0, np.zeros(0)
    while len(taken) < k and free.any() and total - target[taken] @ w > tol * total:
        left = target - w @ gram
        j = int(np.where(free, np.abs(left) / np.sqrt(np.where(size > 0, size, 1.0)), -1.0).argmax())
        free[j] = False
        row = np.linalg.solve(factor, gram[:, j]) if taken else np.zeros(0)
        rest = size[j] - row @ row
        if rest <= 1e-10 * size[j]:
            continue
        factor = np.block([[factor, np.zeros((len(taken), 1))], [row[None, :], np.array([[np.sqrt(rest)]])]])
        gram = np.vstack([gram, products(xs[j])])
        taken.append(j)
        w = np.linalg.solve(factor.T, np.linalg.solve(factor, target[taken]))
    out = np.zeros(len(xs))
    out[taken] = w
    return out


def recovery_score(true: DataFrame, est: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Relative L2 error ||est - true|| / ||true|| and non-zero counts, by a full
    join of the two coefficient tables on the feature."""
    j = true.withColumnRenamed("coef", "a").join(est.withColumnRenamed("coef", "b"), "feature", "full").fillna(0.0, ["a", "b"])
    g = j.agg(F.sqrt(F.sum((F.col("b") - F.col("a")) ** 2)).alias("err"), F.sqrt(F.sum(F.col("a") ** 2)).alias("norm"),
              F.sum((F.abs("b") > tol).cast("int")).alias("nnz_est"), F.sum((F.abs("a") > tol).cast("int")).alias("nnz_true"))
    return g.select(F.round(F.col("err") / F.col("norm"), 8).alias("rel_l2_error"), "nnz_est", "nnz_true")
