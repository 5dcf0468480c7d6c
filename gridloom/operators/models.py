"""Tree ensembles on sample tables: fitting, protocols, ablation, positive-unlabelled designs, importance, scenarios.

Two kinds of boosted trees: boosting.py's, grown leaf by leaf with ridge, constraints and categories, and MLlib's,
depth-wise by logistic loss, beside its forests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import boosting, metrics, sampling
from .lineage import cut


@dataclass(frozen=True)
class Recipe:
    """What to fit: features, label, rounds and the trees' size."""

    features: tuple[str, ...]
    label: str = "y"
    rounds: int = 10
    depth: int = 4
    rate: float = 0.1
    bagging: float = 0.8
    family: str = "boosted"
    weight: str | None = None
    seed: int = 42

    def stages(self) -> Pipeline:
        common = {"labelCol": self.label, "featuresCol": "__x", "maxDepth": self.depth, "subsamplingRate": self.bagging, "seed": self.seed}
        if self.weight:
            common["weightCol"] = self.weight
        trees = GBTClassifier(maxIter=self.rounds, stepSize=self.rate, **common) if self.family == "boosted" else RandomForestClassifier(numTrees=self.rounds, **common)
        return Pipeline(stages=[VectorAssembler(inputCols=list(self.features), outputCol="__x", handleInvalid="keep"), trees])


def fit(df: DataFrame, recipe: Recipe) -> PipelineModel:
    return recipe.stages().fit(df.withColumn(recipe.label, F.col(recipe.label).cast("double")))


def scores(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the probability of class 1."""
    out = model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*[c for c in df.columns if c != name], name)


def best_rounds(df: DataFrame, recipe: Recipe, held_out: Column, most: int = 40, patience: float = 0.01) -> int:
    """Rounds at which the loss on held-out rows stops falling."""
    gbt = recipe.stages().getStages()[-1]
    gbt.setMaxIter(most).setValidationIndicatorCol("__held").set(gbt.validationTol, patience)
    stages = Pipeline(stages=[recipe.stages().getStages()[0], gbt])
    return stages.fit(df.withColumns({"__held": held_out, recipe.label: F.col(recipe.label).cast("double")})).stages[-1].getNumTrees


FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def plain(recipe: Recipe) -> FitPredict:
    """fit on the labelled rows of the training table, score the test table."""
    return lambda train, test: scores(fit(train, recipe), test)


def leafwise(what: boosting.Boosting, written: bool = False) -> FitPredict:
    """The same with trees grown leaf by leaf; written: as for boosting.fit."""
    return lambda train, test: boosting.fit(train, what, written).scores(test)


def weighted_unlabelled(recipe: Recipe, negative_weight: float = 0.5) -> FitPredict:
    """Unlabelled rows count as negatives of less weight."""
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        w = train.withColumn("__w", F.when(F.col(recipe.label) == 1, 1.0).otherwise(negative_weight))
        return scores(fit(w, Recipe(**{**recipe.__dict__, "weight": "__w"})), test)

    return run


def labelled_share(recipe: Recipe, block: str) -> FitPredict:
    """Scores divided by how likely a positive is labelled, which held-out blocks with positives tell."""
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        held = sampling.held_out_blocks(train, block, recipe.label, seed=recipe.seed)  # a fifth of the blocks
        model = fit(train.join(held, block, "left_anti"), recipe)
        share = scores(model, train.join(held, block, "left_semi").where(F.col(recipe.label) == 1)).agg(F.avg("score").alias("c")).first()["c"] or 1.0
        return scores(model, test).withColumn("score", F.least(F.col("score") / share, F.lit(1.0)))

    return run


def bagged_unlabelled(recipe: Recipe, keys: list[str], n: int = 5) -> FitPredict:
    """The mean score of n models, each of all positives and a draw of as many unlabelled rows."""
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        used = train.select(*dict.fromkeys([*keys, recipe.label, *recipe.features, *([recipe.weight] if recipe.weight else [])]))
        pos = used.where(F.col(recipe.label) == 1)
        drawn = cut(sampling.bags(used.where(F.col(recipe.label) == 0), keys, n, pos.count(), recipe.seed))
        parts = [f"__s{k}" for k in range(n)]
        for k, name in enumerate(parts):
            test = scores(fit(pos.unionByName(drawn.where(F.col("bag") == k).drop("bag")), recipe), test, name)
        return test.withColumn("score", reduce(lambda a, b: a + b, map(F.col, parts)) / n).drop(*parts)

    return run


def run_protocols(df: DataFrame, fit_predict: FitPredict, label: str, event: str, fold: str, train_events: list, test_events: list, folds: int = 5, which: tuple[str, ...] = ("spatial", "temporal", "strict")) -> DataFrame:
    """(protocol, part, figures): spatial folds over all events, later events, and later events in unseen folds."""
    parts = []

    def judged(scored: DataFrame, protocol: str, by: list[str]) -> DataFrame:
        m = metrics.classification(scored, "score", F.col(label) == 1, by=by)
        return m.select(F.lit(protocol).alias("protocol"), F.concat_ws("", *[F.col(b).cast("string") for b in by]).alias("part"), "accuracy", "precision", "recall", "f1", "specificity", "auc")

    if "spatial" in which:
        out = reduce(DataFrame.unionByName, [fit_predict(df.where(F.col(fold) != k), df.where(F.col(fold) == k)) for k in range(folds)])
        parts.append(judged(out, "spatial", [fold]))
    early, late = df.where(F.col(event).isin(train_events)), df.where(F.col(event).isin(test_events))
    if "temporal" in which:
        parts.append(judged(fit_predict(early, late), "temporal", [event]))
    if "strict" in which:
        out = reduce(DataFrame.unionByName, [fit_predict(early.where(F.col(fold) != k), late.where(F.col(fold) == k)) for k in range(folds)])
        parts.append(judged(out, "strict", [event]))
    return reduce(DataFrame.unionByName, parts)


def summary(protocols: DataFrame) -> DataFrame:
    """Mean and population deviation of each figure by protocol."""
    cols = ["accuracy", "precision", "recall", "f1", "specificity", "auc"]
    return protocols.groupBy("protocol").agg(*[f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


def gain_importance(model: PipelineModel, features: tuple[str, ...], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, gain double")


def permutation_importance(model: PipelineModel, df: DataFrame, recipe: Recipe, keys: list[str]) -> DataFrame:
    """(feature, drop): how much the area under the ROC curve falls when a feature's values are dealt anew.

    All features are dealt by one permutation, and one table holds their values old and new.
    """
    from .ranking import auc

    needed = dict.fromkeys([*keys, recipe.label, *recipe.features])
    dealt = cut(sampling.dealt_anew(df.select(*needed), list(recipe.features), keys).drop(*keys))
    base = auc(scores(model, dealt), "score", F.col(recipe.label) == 1).first()["auc"]
    rows = []
    for f in recipe.features:
        area = auc(scores(model, dealt.withColumn(f, F.col(f"__new_{f}"))), "score", F.col(recipe.label) == 1).first()["auc"]
        rows.append((f, float(base - area)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")


def ablation(df: DataFrame, test: DataFrame, recipe: Recipe, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, auc) for feature sets."""
    from .ranking import auc

    parts = [auc(plain(Recipe(**{**recipe.__dict__, "features": fs}))(df, test), "score", F.col(recipe.label) == 1).select(F.lit(name).alias("name"), "auc") for name, fs in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def tuned(df: DataFrame, test: DataFrame, recipe: Recipe, grid: list[dict]) -> DataFrame:
    """(setting, auc, size, best) over a grid; best: highest area, then the smaller trees."""
    from .ranking import auc

    rows = []
    for g in grid:
        area = auc(plain(Recipe(**{**recipe.__dict__, **g}))(df, test), "score", F.col(recipe.label) == 1).first()["auc"]
        rows.append((str(sorted(g.items())), float(area), int(g.get("depth", recipe.depth))))
    best = max(rows, key=lambda r: (round(r[1], 6), -r[2]))
    return df.sparkSession.createDataFrame([(*r, r is best) for r in rows], "setting string, auc double, size int, best boolean")


def develop_and_count(model: PipelineModel | boosting.Model, df: DataFrame, change: dict[str, Column], tolerance: float = 1e-9) -> DataFrame:
    """(n, safer, riskier): cells whose score falls or rises when features are changed."""
    score = model.scores if isinstance(model, boosting.Model) else lambda d, name: scores(model, d, name)
    before = score(df, "__a")
    after = score(before.withColumns(change), "__b")
    d = F.col("__b") - F.col("__a")
    return after.agg(F.count("*").alias("n"), F.avg((d < -tolerance).cast("int")).alias("safer"), F.avg((d > tolerance).cast("int")).alias("riskier"))


def response_curve(model: PipelineModel, df: DataFrame, feature: str, values: list[float]) -> DataFrame:
    """(value, mean_score) with a feature held at each value; drops: how often the curve falls."""
    many = df.withColumn("__v", F.explode(F.array(*[F.lit(float(v)) for v in values]))).withColumn(feature, F.col("__v"))
    return scores(model, many).groupBy(F.col("__v").alias("value")).agg(F.avg("score").alias("mean_score"))


def rescored_classes(model: PipelineModel, df: DataFrame, change: dict[str, Column], breaks: list[float]) -> DataFrame:
    """df scored with changed features and classed by fixed breaks."""
    return scores(model, df.withColumns(change)).withColumn("class", S.digitise(F.col("score"), breaks))


def calibrated(train: DataFrame, test: DataFrame, label: str, score: str = "score") -> DataFrame:
    """test with platt and isotonic scores learned on the training scores, which are counted: equal ones weigh as one."""
    train = cut(train.groupBy(score, label).agg(F.count("*").cast("double").alias("__n")))
    platt = Pipeline(stages=[VectorAssembler(inputCols=["__l"], outputCol="__v"), LogisticRegression(labelCol=label, featuresCol="__v", weightCol="__n", regParam=0.0)])
    iso = Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="__v"), IsotonicRegression(labelCol=label, featuresCol="__v", weightCol="__n", predictionCol="isotonic")])
    with_logit = lambda d: d.withColumns({"__l": S.logit(F.col(score)), label: F.col(label).cast("double")})
    a = scores(platt.fit(with_logit(train)), with_logit(test), "platt").drop("__l")
    return iso.fit(with_logit(train)).transform(a).withColumn("isotonic", S.clip(F.col("isotonic"), 0.0, 1.0)).drop("__v")


def change_test(df: DataFrame, before: str, after: str, klass: str, window: int = 5, false_alarms: float = 1e-3) -> DataFrame:
    """df with change -1, 0 or 1: the ratio of local means against the F distribution of each class's own looks."""
    from .focal import box_mean

    k = window // 2
    looks = df.groupBy(klass).agg((F.pow(F.avg(before), F.lit(2.0)) / F.var_pop(before)).alias("looks")).collect()  # a row a class
    local = box_mean(df.withColumns({"__b": F.col(before), "__a": F.col(after)}), ["__b", "__a"], k)
    ratio = F.col("__a") / F.greatest(F.col("__b"), F.lit(1e-6))
    out = F.lit(0)
    for row in looks:
        dof = 2.0 * window * window * (row["looks"] or 1.0)
        up, down = S.f_quantile(1 - false_alarms, dof, dof), S.f_quantile(false_alarms, dof, dof)
        out = F.when(F.col(klass) == row[klass], F.when(ratio > up, 1).when(ratio < down, -1).otherwise(0)).otherwise(out)
    return local.withColumn("change", out).drop("__a", "__b")
