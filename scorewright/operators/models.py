"""Model registry over MLlib estimators: parameters from a file, fit, grid search, predict, save.

Boosting is this library's own (operators/boosting); all its usual parameters count. Of the other models, parameters without a counterpart
in MLlib are ignored with a note in `ignored`.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators import boosting

#: Names of common parameters in MLlib.
RENAMED = {"n_estimators": ("numTrees", "maxIter"), "max_depth": ("maxDepth",), "random_state": ("seed",), "seed": ("seed",), "max_iter": ("maxIter",), "learning_rate": ("stepSize",), "subsample": ("subsamplingRate",), "alpha": ("regParam",), "tol": ("tol",), "min_samples_leaf": ("minInstancesPerNode",), "early_stopping_tol": ("validationTol",)}
CLASSIFIERS: dict[str, Callable] = {
    "LogisticRegression": lambda: C.LogisticRegression(maxIter=100),
    "RandomForestClassifier": lambda: C.RandomForestClassifier(numTrees=100, maxDepth=5, seed=233),
    "NaiveBayes": lambda: C.NaiveBayes(modelType="gaussian"),
}
REGRESSORS: dict[str, Callable] = {
    "Lasso": lambda: R.LinearRegression(elasticNetParam=1.0, regParam=1.0),
    "Ridge": lambda: R.LinearRegression(elasticNetParam=0.0, regParam=1.0),
    "RandomForestRegressor": lambda: R.RandomForestRegressor(numTrees=100, maxDepth=5, seed=233),
}
#: Boosted models and what they start from.
BOOSTED = {"XGBClassifier": {"objective": "binary:logistic", "eval_metric": "auc"}, "XGBRegressor": {"objective": "reg:squarederror", "eval_metric": "rmse"}}


class ModelSet:
    """kind: 'classifier' or 'regressor'. config: {model: {"model_para": {..}, "fit_para": {..}}}."""

    def __init__(self, kind: str, config: dict | None = None) -> None:
        if kind not in ("classifier", "regressor"):
            raise ValueError(kind)
        self.kind, self.config, self.ignored = kind, config or {}, []
        self.makers = CLASSIFIERS if kind == "classifier" else REGRESSORS
        self.fitted: dict[str, PipelineModel | boosting.Booster] = {}

    def boosting_parameters(self, name: str, **more) -> boosting.Parameters:
        given = BOOSTED[name] | self.config.get(name, {}).get("model_para", {}) | self.config.get(name, {}).get("fit_para", {}) | more
        self.ignored += [(name, key) for key in given if key not in boosting.Parameters.known()]
        return boosting.Parameters(**{k: v for k, v in given.items() if k in boosting.Parameters.known()})

    def estimator(self, name: str, **more):
        made = self.makers[name]().setFeaturesCol("features").setLabelCol("label")
        for key, value in (self.config.get(name, {}).get("model_para", {}) | more).items():
            target = next((p for p in (*RENAMED.get(key, ()), key) if made.hasParam(p)), None)
            if key == "C" and made.hasParam("regParam"):
                made.set(made.regParam, 1.0 / value)
            elif target is None or value is None:
                self.ignored.append((name, key))
            else:
                try:
                    made.set(made.getParam(target), value)
                except (TypeError, ValueError):
                    self.ignored.append((name, key))
        return made

    def fit(self, name: str, df: DataFrame, features: list[str], label: str, validation: str | None = None, **more) -> PipelineModel | boosting.Booster:
        """validation: a boolean column that marks rows for early stopping (boosting only)."""
        if name in BOOSTED:
            self.fitted[name] = boosting.fit(df, features, label, self.boosting_parameters(name, **more), validation)
            return self.fitted[name]
        made = self.estimator(name, **more)
        rows = df.withColumn("label", F.col(label).cast("double"))
        self.fitted[name] = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), made]).fit(rows)
        return self.fitted[name]

    def grid_search(self, name: str, df: DataFrame, features: list[str], label: str, parameters: dict[str, list], folds: int = 3, parallelism: int = 2) -> PipelineModel:
        """The best of all combinations by k-fold validation, refitted on all rows, becomes the model of that name."""
        if name in BOOSTED:
            return self._boosted_search(name, df, features, label, parameters, folds)
        made = self.estimator(name)
        grid = ParamGridBuilder()
        for key, values in parameters.items():
            grid = grid.addGrid(made.getParam(next(p for p in (*RENAMED.get(key, ()), key) if made.hasParam(p))), values)
        judge = BinaryClassificationEvaluator() if self.kind == "classifier" else RegressionEvaluator()
        steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), made])
        rows = df.withColumn("label", F.col(label).cast("double"))
        search = CrossValidator(estimator=steps, estimatorParamMaps=grid.build(), evaluator=judge, numFolds=folds, seed=233, parallelism=parallelism)
        self.fitted[name] = search.fit(rows).bestModel
        return self.fitted[name]

    def _boosted_search(self, name: str, df: DataFrame, features: list[str], label: str, parameters: dict[str, list], folds: int) -> boosting.Booster:
        """Rows are dealt to folds by a hash of their values, so equal rows are in one fold. The mean of the model's own metric decides."""
        rows = df.withColumn("__fold", F.pmod(F.xxhash64(label, *features), F.lit(folds)))
        best = None
        for values in product(*parameters.values()):
            more = dict(zip(parameters, values, strict=True))
            p = self.boosting_parameters(name, **more)
            found = []
            for k in range(folds):
                model = boosting.fit(rows.withColumn("__held", F.col("__fold") == k), features, label, p, "__held")
                found.append((max if p.eval_metric == "auc" else min)(model.history) if p.early_stopping_rounds else model.history[-1])
            mean = sum(found) / folds * (1 if p.eval_metric == "auc" else -1)
            if best is None or mean > best[0]:
                best = mean, more
        return self.fit(name, df, features, label, **best[1])

    def predict(self, name: str, df: DataFrame, out: str = "score") -> DataFrame:
        """Classifiers: the probability of class 1. Regressors: the value."""
        if isinstance(self.fitted[name], boosting.Booster):
            return self.fitted[name].predict(df, out)
        scored = self.fitted[name].transform(df)
        value = vector_to_array("probability")[1] if self.kind == "classifier" else F.col("prediction")
        return scored.withColumn(out, value).select(*df.columns, out)

    def save(self, name: str, path: str) -> None:
        model = self.fitted[name]
        if isinstance(model, boosting.Booster):
            model.save(path)
        else:
            model.write().overwrite().save(path)

    def load(self, name: str, path: str) -> None:
        self.fitted[name] = boosting.Booster.load(path) if name in BOOSTED else PipelineModel.load(path)
