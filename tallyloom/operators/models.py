"""Models: registry, preparation, training, tuning, metrics, storage, segmentation and recommendations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import clustering as MK
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import columns as C

#: task -> key -> (class, default parameters); None where no installed library has the model.
REGISTRY: dict[str, dict[str, tuple[type | None, dict[str, Any]]]] = {
    "classification": {
        "logistic": (MC.LogisticRegression, {"maxIter": 50}), "tree": (MC.DecisionTreeClassifier, {"maxDepth": 5, "seed": 42}), "forest": (MC.RandomForestClassifier, {"numTrees": 20, "seed": 42}),
        "svm": (MC.LinearSVC, {"maxIter": 50}), "naive_bayes": (MC.NaiveBayes, {"modelType": "gaussian"}), "gbt": (MC.GBTClassifier, {"maxIter": 20, "seed": 42}), "mlp": (MC.MultilayerPerceptronClassifier, {"seed": 42}),
        "fm": (MC.FMClassifier, {"seed": 42}), **dict.fromkeys(("xgboost", "lightgbm", "catboost", "knn", "adaboost", "cnn", "rnn", "lstm", "bert"), (None, {})),
    },
    "regression": {
        "linear": (MR.LinearRegression, {}), "ridge": (MR.LinearRegression, {"regParam": 0.1, "elasticNetParam": 0.0}), "lasso": (MR.LinearRegression, {"regParam": 0.1, "elasticNetParam": 1.0}), "elastic_net": (MR.LinearRegression, {"regParam": 0.1, "elasticNetParam": 0.5}),
        "tree": (MR.DecisionTreeRegressor, {"maxDepth": 5, "seed": 42}), "forest": (MR.RandomForestRegressor, {"numTrees": 20, "seed": 42}), "gbt": (MR.GBTRegressor, {"maxIter": 20, "seed": 42}), "fm": (MR.FMRegressor, {"seed": 42}),
        **dict.fromkeys(("xgboost", "lightgbm", "svr", "knn", "mlp"), (None, {})),
    },
    "clustering": {"kmeans": (MK.KMeans, {"k": 3, "seed": 42}), "bisecting": (MK.BisectingKMeans, {"k": 3, "seed": 42}), "gmm": (MK.GaussianMixture, {"k": 3, "seed": 42}), **dict.fromkeys(("dbscan", "agglomerative", "birch", "optics", "spectral", "mean_shift"), (None, {}))},
    "timeseries": {"arima": (None, {"order": (1, 1, 1)}), **dict.fromkeys(("sarima", "prophet", "lstm", "gru", "transformer"), (None, {}))},
}


#: Models that are operators of their own here, and where.
OWN: dict[str, dict[str, str]] = {
    "classification": {"knn": "neighbours.predict", "adaboost": "boosting.adaboost"}, "regression": {"knn": "neighbours.predict", "svr": "margins.fit"},
    "clustering": {"dbscan": "density.dbscan", "agglomerative": "summaries.ward_clusters", "birch": "summaries.birch", "spectral": "neighbours.spectral"}, "timeseries": {"arima": "timeseries.arima_forecast", "sarima": "seasonal.sarima_forecast"},
}


def available(task: str) -> list[str]:
    """Models that can be trained here, by a class of the library or an operator."""
    return [k for k, (cls, _) in REGISTRY[task].items() if cls or k in OWN[task]]


def recommended(task: str, rows: int, classes: int = 2) -> list[str]:
    """Up to five models for the size of the data."""
    order = {"classification": ["gbt", "logistic", "forest", "tree", "naive_bayes"] if classes == 2 else ["forest", "logistic", "tree", "naive_bayes", "mlp"], "regression": ["gbt", "forest", "linear", "elastic_net", "tree"], "clustering": ["kmeans", "bisecting", "gmm"], "timeseries": ["arima"]}[task]
    simple = {"logistic", "linear", "tree", "naive_bayes", "elastic_net", "kmeans", "bisecting", "gmm", "arima"}
    return ([m for m in order if m in simple] + [m for m in order if m not in simple] if rows < 1000 else order)[:5]


def impute(df: DataFrame, cols: list[str], strategy: str = "mean", value: Any = None) -> DataFrame:
    """Missing values: drop, mean, median, mode, or a constant."""
    if strategy == "drop":
        return df.na.drop(subset=cols)
    if strategy == "constant":
        return df.na.fill(value, subset=cols)
    real = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return Imputer(strategy=strategy, inputCols=cols, outputCols=cols).fit(real).transform(real)


def scaled(df: DataFrame, cols: list[str], how: str = "standard") -> DataFrame:
    """Columns scaled in place: standard (population deviation), minmax, robust. Plain columns, from one aggregate."""
    if how == "none":
        return df
    v = {c: F.col(c).cast("double") for c in cols}
    stats = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "robust": lambda c: (F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)),
    }[how]
    r = df.agg(*[e.cast("double").alias(f"{c}_{i}") for c in cols for i, e in enumerate(stats(c))]).first()
    return df.withColumns({c: (v[c] - F.lit(r[f"{c}_0"])) / F.lit(r[f"{c}_1"] or 1.0) for c in cols})


def encode_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column's number in the order of its values, as <column>_index; unknown values get the next number."""
    made = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return made.transform(df)


def feature_kinds(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features: numbers of few values are categories."""
    r = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    numbers = [c for c in cols if c in C.numeric(df) and not (r[c] < 10 and r[c] / max(1, r["_n"]) < 0.05)]
    return numbers, [c for c in cols if c not in numbers]


def preparation(numbers: list[str], categories: list[str], scale: str = "standard") -> list:
    """Stages from columns to a vector `features`."""
    stages: list = []
    if numbers:
        scaler = {"standard": StandardScaler(withMean=True), "minmax": MinMaxScaler(), "robust": RobustScaler(withCentering=True)}.get(scale)
        stages += [Imputer(inputCols=numbers, outputCols=[f"{c}__i" for c in numbers]), VectorAssembler(inputCols=[f"{c}__i" for c in numbers], outputCol="__n")]
        if scaler is not None:
            stages.append(scaler.setInputCol("__n").setOutputCol("__s"))
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"{c}__x" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__x" for c in categories], outputCols=[f"{c}__h" for c in categories], dropLast=False)]
    parts = (["__s" if scale != "none" else "__n"] if numbers else []) + [f"{c}__h" for c in categories]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts by hash of the key: the same rows whatever the layout."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) < int(share * 1000)
    return df.where(part), df.where(~part)


def train(df: DataFrame, task: str, model: str, features: list[str], target: str | None = None, params: dict | None = None, scale: str = "standard", grid: dict[str, list] | None = None, folds: int = 0) -> PipelineModel:
    """Fits preparation and model in one pipeline; with a grid or folds, by cross-validation."""
    cls, defaults = REGISTRY[task][model]
    if cls is None:
        raise ValueError(f"{model} is not available here")
    numbers, categories = feature_kinds(df, features)
    fields = dict(defaults | (params or {}))
    stages = preparation(numbers, categories, scale)
    if task == "clustering":
        est = cls(featuresCol="features", predictionCol="prediction", **fields)
    elif task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"))
        est = cls(featuresCol="features", labelCol="label", **fields)
    else:
        df = df.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
        est = cls(featuresCol="features", labelCol="label", **fields)
    pipe = Pipeline(stages=[*stages, est])
    if not grid and folds < 2:
        return pipe.fit(df)
    build = ParamGridBuilder()
    for name, values in (grid or {}).items():
        build = build.addGrid(est.getParam(name), values)
    rate = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2") if task == "regression" else ClusteringEvaluator()
    return CrossValidator(estimator=pipe, estimatorParamMaps=build.build(), evaluator=rate, numFolds=max(2, folds or 5), seed=42).fit(df).bestModel


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions, with the greatest probability as confidence where there is one."""
    out = model.transform(df)
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))) if "probability" in out.columns else out


def importances(model: PipelineModel, k: int = 10) -> list[tuple[int, float]]:
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else []
    return sorted(((i, float(v)) for i, v in enumerate(values)), key=lambda x: -x[1])[:k]


def named_importances(model: PipelineModel, df: DataFrame, k: int = 10) -> list[tuple[str, float]]:
    """The features of most weight by name, a category as column=value, in the order of importances()."""
    made = model.transform(df.limit(1)).schema["features"].metadata.get("ml_attr", {})
    names = {a["idx"]: a["name"] for kind in made.get("attrs", {}).values() for a in kind}
    columns = [c for stage in model.stages if hasattr(stage, "getInputCols") and stage.getOutputCol() == "__n" for c in stage.getInputCols()] if any(isinstance(s, VectorAssembler) for s in model.stages) else []

    def said(i: int) -> str:
        name = names.get(i, f"feature {i}")
        if name.startswith(("__s_", "__n_")):
            at = name[4:]
            return columns[int(at)].removesuffix("__i") if at.isdigit() and int(at) < len(columns) else at.removesuffix("__i")
        return name.replace("__h_", "=", 1).removesuffix("__i")

    return [(said(i), v) for i, v in importances(model, k)]


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and weighted precision, recall, F1: one row, from counts by pair of classes."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(F.count("*").alias("n"))
    flat = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("isy"), F.lit(0).alias("isp"), (F.col("y") == F.col("p")).cast("int").alias("hit"), "n"), F.struct(F.col("p").alias("c"), F.lit(0).alias("isy"), F.lit(1).alias("isp"), F.lit(0).alias("hit"), "n"))).alias("x")).select("x.*")
    by = flat.groupBy("c").agg(F.sum(F.col("isy") * F.col("n")).alias("ny"), F.sum(F.col("isp") * F.col("n")).alias("np"), F.sum(F.col("hit") * F.col("n")).alias("tp"))
    p, r = F.coalesce(C.share(F.col("tp"), F.col("np")), F.lit(0.0)), F.coalesce(C.share(F.col("tp"), F.col("ny")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    n = F.sum("ny")
    return by.agg((F.sum("tp") / n).alias("accuracy"), (F.sum(p * F.col("ny")) / n).alias("precision"), (F.sum(r * F.col("ny")) / n).alias("recall"), (F.sum(f1 * F.col("ny")) / n).alias("f1"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


def auc(df: DataFrame, label: str, score: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score).evaluate(df.withColumn(label, F.col(label).cast("double")))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae, r2, explained variance, mape over labels that are not 0; one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
        (1 - F.var_pop(e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("explained_variance"), (F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
    )


def forecast_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (F.avg(F.abs((y - p) / (y + 1e-8))) * 100).alias("mape"), (F.avg(2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + 1e-8)) * 100).alias("smape"))


def cluster_metrics(df: DataFrame, cols: list[str], cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centres and spreads: (n, k, ch, db)."""
    n = df.count()
    centres = df.groupBy(F.col(cluster).alias("_g")).agg(F.count("*").alias("k"), *[F.avg(c).alias(f"m_{c}") for c in cols])
    total = df.agg(*[F.avg(c).alias(f"t_{c}") for c in cols])
    far = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols)
    spread = df.join(F.broadcast(centres), df[cluster] == F.col("_g")).groupBy("_g", "k", *[f"m_{c}" for c in cols]).agg(F.sum(far).alias("ss"), F.avg(F.sqrt(far)).alias("s"))
    rows = spread.join(F.broadcast(total)).collect()  # a row a cluster
    k = len(rows)
    between = sum(r["k"] * sum((r[f"m_{c}"] - r[f"t_{c}"]) ** 2 for c in cols) for r in rows)
    within = sum(r["ss"] for r in rows)
    dist = lambda a, b: sum((a[f"m_{c}"] - b[f"m_{c}"]) ** 2 for c in cols) ** 0.5
    db = sum(max((a["s"] + b["s"]) / max(1e-300, dist(a, b)) for b in rows if b["_g"] != a["_g"]) for a in rows) / k if k > 1 else None
    ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within else None
    return df.sparkSession.createDataFrame([(n, k, ch, db)], "n long, k int, ch double, db double")


class ModelStore:
    """Fitted pipelines under a folder, each with a line of metadata beside it."""

    def __init__(self, spark, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def save(self, name: str, model: PipelineModel, **about: Any) -> None:
        model.write().overwrite().save(f"{self.uri}/{name}/model")
        self.spark.createDataFrame([(name, json.dumps(about))], "name string, about string").coalesce(1).write.mode("overwrite").json(f"{self.uri}/{name}/about")

    def load(self, name: str) -> tuple[PipelineModel, dict]:
        return PipelineModel.load(f"{self.uri}/{name}/model"), json.loads(self.spark.read.schema("name string, about string").json(f"{self.uri}/{name}/about").first()["about"])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def list(self) -> list[str]:
        fs, p = self._fs(self.uri)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def best(self, metric: str) -> str | None:
        rated = [(self.load(n)[1].get(metric), n) for n in self.list()]
        return max((x for x in rated if x[0] is not None), default=(None, None))[1]

    def delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.uri}/{name}")
        fs.delete(p, True)


def segments(df: DataFrame, cols: list[str], most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows with a cluster, by KMeans on filled and standardised columns with the number of best silhouette; and for
    each cluster and column the mean's deviation from the whole, where over a tenth."""
    stages = [*preparation(cols, [])]
    made = Pipeline(stages=stages).fit(df).transform(df)
    rate = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    n = made.count()
    best = max((MK.KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(made) for k in range(2, max(2, min(most, n // 10)) + 1)), key=lambda m: rate.evaluate(m.transform(made)))
    out = best.transform(made).select(*df.columns, "cluster")
    means = out.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])
    whole = out.agg(*[F.avg(c).alias(f"w_{c}") for c in cols])
    flat = means.join(F.broadcast(whole)).select("cluster", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean"), (F.try_divide(F.col(c), F.col(f"w_{c}")) - 1).alias("deviation")) for c in cols])).alias("x")).select("cluster", "n", "x.*")
    return out, flat.where(F.abs("deviation") > 0.1)


def alert(value: float, warn: float) -> str | None:
    """error under 80 % of the threshold, warning under it."""
    return "error" if value < 0.8 * warn else "warning" if value < warn else None


def recommendations(correlations: DataFrame, etas: DataFrame, vs: DataFrame, n_rows: int, n_numeric: int, n_categorical: int) -> DataFrame:
    """(kind, target, feature, strength): what could be modelled, from correlations (a, b, r), etas (group, value, eta2)
    and categorical pairs (a, b, v); and clustering and association where there is enough to go on."""
    spark = correlations.sparkSession
    out = correlations.where(F.abs("r") >= 0.3).select(F.lit("regression").alias("kind"), F.col("b").alias("target"), F.col("a").alias("feature"), F.abs("r").alias("strength"))
    out = out.unionByName(etas.where("eta2 >= 0.1").select(F.lit("classification").alias("kind"), F.col("group").alias("target"), F.col("value").alias("feature"), F.col("eta2").alias("strength")))
    out = out.unionByName(vs.where("v >= 0.3").select(F.lit("classification").alias("kind"), F.col("b").alias("target"), F.col("a").alias("feature"), F.col("v").alias("strength")))
    more = [("clustering", None, None, None)] * (n_numeric >= 3 and n_rows >= 100) + [("association", None, None, None)] * (n_categorical >= 3)
    return out.unionByName(spark.createDataFrame(more, "kind string, target string, feature string, strength double"))
