"""How useful a synthetic table is for learning: train on synthetic, test on real."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .privacy import auc
from .profile import number
from .running import exact_quantiles

MODELS = ("random_forest", "gradient_boosting", "linear")
#: Rows whose values may already be too many for classes.
LOOKED = 1000
#: Rows of a table that models go over again and again, in one partition.
TASK_ROWS = 100_000


def is_classification(df: DataFrame, target: str, categorical: list[str], few: int = 10) -> bool:
    """Declared categorical, a string, or at most ``few`` distinct values (null is one)."""
    if target in categorical or dict(df.dtypes)[target] == "string":
        return True
    # values among any rows are values of the column; only if they are few the others are looked at
    own = df.select(target)
    return all(d.distinct().limit(few + 1).count() <= few for d in (own.limit(LOOKED), own))


def confusion(predictions: DataFrame, actual: str = "y", predicted: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(actual).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))


def classification_scores(predictions: DataFrame, actual: str = "y", predicted: str = "prediction", score: str | None = None, positive=None) -> DataFrame:
    """accuracy, f1_macro over all labels seen, and auc for two classes (0.5 otherwise), long."""
    c = confusion(predictions, actual, predicted)
    sides = F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("ny"), F.lit(0).cast("long").alias("np")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("ny"), F.col("n").alias("np"))))
    marg = c.select(sides.alias("s")).select("s.*").groupBy("label").agg(F.sum("ny").alias("ny"), F.sum("np").alias("np"))
    hits = c.where("y = p").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    f1 = marg.join(hits, "label", "left").select(F.coalesce(2 * F.col("tp") / (F.col("ny") + F.col("np")), F.lit(0.0)).alias("f1")).agg(F.avg("f1").alias("f1_macro"))
    acc = c.agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.countDistinct("y").alias("classes"))
    out = acc.join(F.broadcast(f1))
    if score:
        a = auc(predictions.withColumn("_pos", (F.col(actual).cast("string") == F.lit(str(positive))).cast("int")), score, "_pos")
        out = out.join(F.broadcast(a)).withColumn("auc", F.when(F.col("classes") == 2, F.col("auc")).otherwise(0.5))
    else:
        out = out.withColumn("auc", F.lit(0.5))
    return out.unpivot([], ["accuracy", "f1_macro", "auc"], "metric", "value")


def regression_scores(predictions: DataFrame, actual: str = "y", predicted: str = "prediction") -> DataFrame:
    """mse, mae, r2, long."""
    y, p = number(actual), number(predicted)
    s = predictions.select(y.alias("y"), p.alias("p")).dropna().agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.var_pop("y").alias("v"))
    return s.select("mse", "mae", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(0.0).alias("r2")).unpivot([], ["mse", "mae", "r2"], "metric", "value")


def features(continuous: list[str], categorical: list[str], fit_on: DataFrame):
    """Fitted assembly of standardised numbers and one-hot categories; unseen categories are their own."""
    stages = []
    if categorical:
        index = [f"_{c}_i" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=[f"_{c}_v" for c in categorical], dropLast=False, handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[*continuous, *[f"_{c}_v" for c in categorical]], outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return Pipeline(stages=stages).fit(fit_on)


def prepared(df: DataFrame, continuous: list[str], categorical: list[str], target: str, classification: bool) -> DataFrame:
    """Numbers without nulls (0), categories as strings, the target's nulls filled by its mode or median."""
    y = F.col(target).cast("string") if classification else number(target)
    cols = [F.coalesce(number(c), F.lit(0.0)).alias(c) for c in continuous if c != target]
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical if c != target]
    if not df.agg(F.count_if(y.isNull())).first()[0]:
        return df.select(*cols, *cats, y.alias("y"))
    fill = df.agg(F.mode(y, True).alias("fill")) if classification else exact_quantiles(df.select(y.alias("x")), [], (0.5,)).select(F.col("q")[0].alias("fill"))
    return df.join(F.broadcast(fill), how="left").select(*cols, *cats, F.coalesce(y, F.col("fill")).alias("y"))


def _estimators(classification: bool, classes: int, rows: int, trees: int, seed: int) -> dict:
    reg = 1.0 / max(rows, 1)
    if not classification:
        return {"random_forest": RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=10, seed=seed), "gradient_boosting": GBTRegressor(labelCol="y", maxIter=trees, maxDepth=5, seed=seed), "linear": LinearRegression(labelCol="y", regParam=reg)}
    boost = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=5, seed=seed)
    return {
        "random_forest": RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=10, seed=seed),
        "gradient_boosting": boost if classes == 2 else OneVsRest(classifier=boost, labelCol="label"),
        "linear": LogisticRegression(labelCol="label", maxIter=1000, regParam=reg),
    }


def _in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, so that no partition has more than about TASK_ROWS of its ``rows``; small ones stay as they are."""
    return df.repartition(-(-rows // TASK_ROWS)) if rows > TASK_ROWS else df


def _scored(est, train: DataFrame, test: DataFrame, labels: list[str] | None) -> list[tuple[str, float]]:
    """Scores of one fit, a few numbers."""
    done = est.fit(train).transform(test)
    if labels is None:
        scores = regression_scores(done.select("y", "prediction"))
    else:
        names = F.array(*[F.lit(v) for v in labels])
        told = F.get(names, F.col("prediction").cast("int"))
        two = len(labels) == 2
        prob = vector_to_array("probability")[1] if two and "probability" in done.columns else F.lit(0.0)
        done = done.select("y", told.alias("prediction"), prob.alias("score"))
        scores = classification_scores(done, score="score" if two else None, positive=labels[1] if two else None)
    return [(r["metric"], r["value"]) for r in scores.select("metric", "value").collect()]


def evaluate_utility(
    train: DataFrame,
    test: DataFrame,
    synth: DataFrame | None,
    target: str,
    continuous: list[str],
    categorical: list[str],
    exclude: list[str] | None = None,
    models: tuple[str, ...] = MODELS,
    trees: int = 100,
    seed: int = 42,
    estimators=None,
    at_once: int = 3,
) -> DataFrame:
    """(model, regime, metric, value, status): trained on real (TRTR) and on synthetic rows (TSTR), both tested on real ones.

    Models are fitted side by side, ``at_once`` at a time.  A fit that fails is a row without metric and value, whose status
    is its error; the others' are "ok".  Without synthetic rows there is only TRTR.  ``estimators`` replaces the models: a
    function of (classification, classes, rows, trees, seed) to estimators by name.
    """
    gone = set(exclude or [])
    continuous = [c for c in continuous if c not in gone and c != target]
    categorical = [c for c in categorical if c not in gone and c != target]
    cls = is_classification(train, target, [*categorical, *([target] if dict(train.dtypes)[target] == "string" else [])])
    tables = {"TRTR": train, "test": test} | ({} if synth is None else {"TSTR": synth})
    ready = {k: prepared(d, continuous, categorical, target, cls) for k, d in tables.items()}
    labels = None
    if cls:
        known = ready["TRTR"].unionByName(ready["TSTR"]) if synth is not None else ready["TRTR"]
        index = StringIndexer(inputCol="y", outputCol="label", handleInvalid="keep").fit(known)
        labels = list(index.labels)
        ready = {k: index.transform(d) for k, d in ready.items()}
    assembler = features(continuous, categorical, ready["TRTR"])
    rows = {k: d.count() for k, d in tables.items()}
    ready = {k: assembler.transform(d) for k, d in ready.items()}
    # least squares go over their rows once; trees keep a copy of theirs in the partitions that these have
    if cls or estimators or set(models) != {"linear"}:
        ready = {k: _in_tasks(d, rows[k]).cache() for k, d in ready.items()}
    try:
        tasks = []
        for regime in (k for k in ("TRTR", "TSTR") if k in ready):
            made = (estimators or _estimators)(cls, len(labels) if cls else 0, rows[regime], trees, seed)
            tasks += [(name, regime, est) for name, est in made.items() if estimators or name in models]

        def run(name: str, regime: str, est) -> list[tuple]:
            try:
                return [(name, regime, metric, value, "ok") for metric, value in _scored(est, ready[regime], ready["test"], labels)]
            except Exception as e:  # noqa: BLE001  # whatever fails is told, and the other models go on
                return [(name, regime, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])]

        with ThreadPoolExecutor(max(1, at_once)) as pool:
            # each fit gets its own copy of this thread's Spark properties
            lines = [line for part in [pool.submit(inheritable_thread_target(train.sparkSession)(run), *t) for t in tasks] for line in part.result()]
    finally:
        for d in ready.values():
            d.unpersist()
    return train.sparkSession.createDataFrame(lines, "model string, regime string, metric string, value double, status string")


def utility_drop(scores: DataFrame, metrics: tuple[str, ...] = ("f1_macro", "r2")) -> DataFrame:
    """TRTR minus TSTR per model, and their mean as model '*'."""
    own = scores.where(F.col("metric").isin(*metrics))
    drop = own.groupBy("model", "metric").agg((F.max(F.when(F.col("regime") == "TRTR", F.col("value"))) - F.max(F.when(F.col("regime") == "TSTR", F.col("value")))).alias("drop"))
    return drop.unionByName(drop.groupBy("metric").agg(F.avg("drop").alias("drop")).select(F.lit("*").alias("model"), "metric", "drop"))


def attribute_inference(synth: DataFrame, holdout: DataFrame, sensitive: str, continuous: list[str], categorical: list[str], trees: int = 50, seed: int = 42) -> DataFrame:
    """A forest learnt on synthetic rows guesses the sensitive column of real ones; its scores, long."""
    done = evaluate_utility(synth, holdout, None, sensitive, continuous, categorical, models=("random_forest",), trees=trees, seed=seed)
    return done.where("status = 'ok'").select("metric", "value")


def cross_validated(df: DataFrame, target: str, continuous: list[str], categorical: list[str], folds: int = 3, trees: int = 50, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Accuracy per fold of a forest on a feature subset; ``df`` has a fold column."""
    out = None
    for k in range(folds):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        s = evaluate_utility(train, test, None, target, continuous, categorical, models=("random_forest",), trees=trees, seed=seed)
        s = s.where("metric = 'accuracy'").select(F.lit(k).alias("fold"), "value")
        out = s if out is None else out.unionByName(s)
    return out
