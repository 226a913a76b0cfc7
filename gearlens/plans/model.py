"""Model training, tuning and evaluation with Spark ML (M1-M9).

Tree ensembles are Spark ML's (``DecisionTreeRegressor``,
``RandomForestRegressor``, ``GBTRegressor``): training is distributed
(histogram aggregation per tree level).  Splits are hash-based on the key, so
they do not depend on partitioning and DuckDB computes the same buckets.
"""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S

FEATURES_VEC = "features"
PREDICTION = "prediction"


# ---------------------------------------------------------------------------
# M1 reproducible split
# ---------------------------------------------------------------------------
def split_bucket(key) -> F.Column:
    """Bucket 0..99 from the first 8 hex digits of md5(key as text)."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split(df: DataFrame, key: str = S.KEY, weights=(0.64, 0.16, 0.20)) -> list[DataFrame]:
    """M1: split by hash bucket of the key; weights in percent steps."""
    bounds, acc = [], 0.0
    for w in weights:
        acc += w
        bounds.append(int(round(acc * 100)))
    b = split_bucket(key)
    parts, lo = [], 0
    for hi in bounds:
        parts.append(df.where((b >= lo) & (b < hi)))
        lo = hi
    return parts


def with_split(df: DataFrame, key: str = S.KEY, weights=(0.64, 0.16, 0.20),
               names=("train", "validation", "test")) -> DataFrame:
    """M1 as one column ``part`` (and ``bucket``)."""
    b = split_bucket(key)
    expr, acc = None, 0.0
    for w, n in zip(weights, names):
        acc += w
        hi = int(round(acc * 100))
        expr = F.when(F.col("bucket") < hi, n) if expr is None else expr.when(F.col("bucket") < hi, n)
    return df.withColumn("bucket", b).withColumn("part", expr)


# ---------------------------------------------------------------------------
# M2-M5 fit and score
# ---------------------------------------------------------------------------
MODELS = {
    "decision_tree": lambda **p: DecisionTreeRegressor(**p),
    "random_forest": lambda **p: RandomForestRegressor(**{"seed": 42, **p}),
    "boosted": lambda **p: GBTRegressor(**{"seed": 42, **p}),
}


#: Kinds fitted by the second-order booster, with the defaults of the reference's two libraries.
BOOSTERS = ("leafwise", "depthwise")

# Spark's tree learners reject NaN; a missing feature takes this value, far
# below any observed one, so a split can route "missing" on its own (the
# boosted library of the reference handles missing values natively).
MISSING = -1.0e9


def make_pipeline(features, kind: str = "boosted", label: str = S.TARGET, **params) -> Pipeline:
    features = list(features)
    filled = [f"__f{i}" for i in range(len(features))]
    stmt = "SELECT *, " + ", ".join(
        f"coalesce(cast(`{f}` as double), {MISSING}D) AS `{n}`" for f, n in zip(features, filled)) + " FROM __THIS__"
    fill = SQLTransformer(statement=stmt)
    asm = VectorAssembler(inputCols=filled, outputCol=FEATURES_VEC, handleInvalid="keep")
    reg = MODELS[kind](featuresCol=FEATURES_VEC, labelCol=label, predictionCol=PREDICTION, **params)
    return Pipeline(stages=[fill, asm, reg])


def _labelled(df: DataFrame, label: str, int_target: bool) -> DataFrame:
    y = F.col(label).cast("double")
    if int_target:
        y = y.cast("int").cast("double")   # truncation toward zero, as the reference's astype(int)
    return df.where(F.col(label).isNotNull()).withColumn(label, y)


def _fit_input(df: DataFrame, features, label: str, int_target: bool, extra=()) -> DataFrame:
    """The labelled rows, feature and label columns only, persisted: the tree
    learners pass over their input several times before caching their own
    binned copy (row count, split sampling, binning), and without this every
    pass would recompute the whole feature plan.  Blocks lost with an
    executor are recomputed from the lineage."""
    cols = [F.col(f"`{c}`") for c in dict.fromkeys(list(features) + [label])]
    return _labelled(df.select(*cols, *extra), label, int_target).persist(StorageLevel.MEMORY_AND_DISK)


def train(df: DataFrame, features, kind: str = "boosted", label: str = S.TARGET,
          int_target: bool = False, **params) -> PipelineModel:
    """M2 (decision_tree), M3 (random_forest), M4 (boosted: Spark's own; leafwise and
    depthwise: :mod:`booster`, ``params`` being fields of its settings)."""
    if kind in BOOSTERS:
        from gearlens.plans import booster
        base = booster.Settings() if kind == "leafwise" else booster.DEPTHWISE
        return booster.fit_boosted(df, features, label, replace(base, **params), int_target)
    data = _fit_input(df, features, label, int_target)
    try:
        return make_pipeline(features, kind, label, **params).fit(data)
    finally:
        data.unpersist()


def train_tree(df, features, **kw):
    return train(df, features, "decision_tree", **kw)


def train_forest(df, features, **kw):
    return train(df, features, "random_forest", **kw)


def train_boosted(df, features, **kw):
    return train(df, features, "boosted", **kw)


def r2(model: PipelineModel, df: DataFrame, label: str = S.TARGET, int_target: bool = False) -> float:
    """M5: coefficient of determination on a labelled table."""
    pred = model.transform(_labelled(df, label, int_target))
    return RegressionEvaluator(labelCol=label, predictionCol=PREDICTION, metricName="r2").evaluate(pred)


def compare_models(train_df: DataFrame, val_df: DataFrame, features, kinds=("decision_tree", "random_forest", "boosted"),
                   label: str = S.TARGET, params: dict | None = None) -> DataFrame:
    """M9: train and validation R^2 of each model kind side by side."""
    rows = []
    for k in kinds:
        m = train(train_df, features, k, label, **(params or {}).get(k, {}))
        rows.append((k, r2(m, train_df, label), r2(m, val_df, label)))
    return train_df.sparkSession.createDataFrame(rows, "model string, train_r2 double, validation_r2 double")


# ---------------------------------------------------------------------------
# M6 random search
# ---------------------------------------------------------------------------
# Search space of the boosted model, mapped to Spark's parameter names
# (max_depth -> maxDepth, learning_rate -> stepSize, n_estimators -> maxIter,
# subsample -> subsamplingRate, colsample -> featureSubsetStrategy).
BOOSTED_SPACE = {
    "maxDepth": [3, 5, 6, 10, 15, 20],
    "stepSize": [0.01, 0.1, 0.2, 0.3],
    "subsamplingRate": [0.5, 0.6, 0.7, 0.8, 0.9],
    "featureSubsetStrategy": ["0.4", "0.5", "0.6", "0.7", "0.8", "0.9"],
    "maxIter": [100, 500, 1000],
}


# The second search of the notebook (7 settings, 50 draws), mapped the same
# way; leaf count and L1/L2 penalties have no GBT equal, so the minimum rows
# per node and the minimum gain stand in for them.
BOOSTED_SPACE_LEAFWISE = {
    "maxDepth": [5, 10, 15],
    "stepSize": [0.05, 0.1, 0.2],
    "maxIter": [100, 200, 300],
    "minInstancesPerNode": [1, 5, 10],
    "minInfoGain": [0.0, 0.01, 0.1],
}
SEARCH_DRAWS = {"boosted": 20, "leafwise": 50}


def draw_param_maps(estimator, space: dict, n: int, seed: int = 42) -> list[dict]:
    """n settings drawn uniformly from the space (without repeats when possible)."""
    rng = random.Random(seed)
    keys = sorted(space)
    seen, maps = set(), []
    total = 1
    for k in keys:
        total *= len(space[k])
    while len(maps) < min(n, total):
        choice = tuple(rng.choice(space[k]) for k in keys)
        if choice in seen:
            continue
        seen.add(choice)
        maps.append({estimator.getParam(k): v for k, v in zip(keys, choice)})
    return maps


def random_search(df: DataFrame, features, space: dict | None = None, n: int = 20, folds: int = 3,
                  kind: str = "boosted", label: str = S.TARGET, seed: int = 42, parallelism: int = 2):
    """M6: ``n`` random settings, ``folds``-fold CV by R^2; returns the
    fitted CrossValidatorModel (``bestModel``, ``avgMetrics``) and the maps.

    A table with the key column gets its folds from the key's hash bucket, so
    they don't depend on partitioning; without it they are random by ``seed``."""
    pipe = make_pipeline(features, kind, label)
    reg = pipe.getStages()[-1]
    maps = draw_param_maps(reg, space or BOOSTED_SPACE, n, seed)
    grid = maps if maps else ParamGridBuilder().build()
    ev = RegressionEvaluator(labelCol=label, predictionCol=PREDICTION, metricName="r2")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        seed=seed, parallelism=parallelism)
    extra = []
    if S.KEY in df.columns:
        extra = [(split_bucket(S.KEY) % folds).cast("int").alias("__fold")]
        cv = cv.setFoldCol("__fold")
    data = _fit_input(df, features, label, False, extra)
    try:
        return cv.fit(data), maps
    finally:
        data.unpersist()


def search_results(cv_model, maps) -> DataFrame:
    from pyspark.sql import SparkSession
    rows = [(str({p.name: v for p, v in m.items()}), float(metric)) for m, metric in zip(maps, cv_model.avgMetrics)]
    return SparkSession.getActiveSession().createDataFrame(rows, "params string, mean_cv_r2 double")


# ---------------------------------------------------------------------------
# M7 final fit, M8 importances
# ---------------------------------------------------------------------------
def final_fit(train_df: DataFrame, val_df: DataFrame, test_df: DataFrame, features, kind: str = "boosted",
              label: str = S.TARGET, int_target: bool = True, **params):
    """M7: stack train + validation, refit, score on train and test.

    Returns (model, DataFrame of metrics).  ``int_target`` truncates the
    target for fitting and for both scores (the batch job's convention);
    the raw-target test score is reported too.
    """
    from gearlens.operators.prep import append_rows
    full = append_rows(train_df, val_df)
    model = train(full, features, kind, label, int_target=int_target, **params)
    rows = [("train_r2", r2(model, full, label, int_target)),
            ("test_r2", r2(model, test_df, label, int_target)),
            ("test_r2_raw_target", r2(model, test_df, label, False))]
    return model, train_df.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importance(model: PipelineModel, features, k: int | None = 10, kind: str = "gain") -> DataFrame:
    """M8: importance per feature, highest first (top k).

    ``gain``: Spark's normalised impurity gain.  ``split``: the number of
    splits on the feature over all trees (LightGBM's default measure).
    """
    reg = model.stages[-1]
    features = list(features)
    width = len(features)
    if kind == "gain":
        # a booster's vector holds every feature twice
        imp = [0.0] * width
        for i, v in enumerate(reg.featureImportances.toArray().tolist()):
            imp[i % width] += v
    elif kind == "split":
        import re
        text = reg.toDebugString
        counts = [0] * len(features)
        for m in re.finditer(r"If \(feature (\d+) ", text):
            counts[int(m.group(1)) % width] += 1
        imp = [float(c) for c in counts]
    else:
        raise ValueError(kind)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(k) if k else df


# ---------------------------------------------------------------------------
# S4-S5 persistence
# ---------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_columns(spark, columns, path: str) -> None:
    """Ordered feature names as one JSON row written by Spark."""
    spark.createDataFrame([(list(columns),)], "columns array<string>").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_columns(spark, path: str) -> list[str]:
    return list(spark.read.json(path).first()["columns"])
