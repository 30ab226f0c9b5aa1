"""Churn model: sparse dummy features, stratified split, standardising, logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import count_rows, round_dp
from holdfast.operators import risk
from holdfast.operators.ordered import row_index
from holdfast.sources.workspace import publish

NUMERIC = (
    "age",
    "tenure_days",
    "watch_time_hours",
    "days_since_login",
    "support_tickets",
    "num_devices",
)
CATEGORICAL = ("subscription_type", "favorite_genre", "country")


def indicators(users: DataFrame) -> list[Column]:
    """For each categorical column the name of the user's level; NULL for its first level, which has no indicator.

    A level is the first one by name, so no list of levels is needed: three minima are.
    """
    first = users.agg(F.struct(*[F.min(c).alias(c) for c in CATEGORICAL])).scalar()
    return [F.when(F.col(c) > first[c], F.concat(F.lit(f"{c}_"), F.col(c))) for c in CATEGORICAL]


def feature_frame(users: DataFrame) -> DataFrame:
    """user_id, churn, the numeric features, and the names of the indicators that are 1, in feature order."""
    numeric = [F.col(c).cast("double").alias(c) for c in NUMERIC]
    return users.select("user_id", "churn", *numeric, F.array_compact(F.array(*indicators(users))).alias("indicators"))


def feature_names(features: DataFrame) -> list[str]:
    """The numeric features, then the indicators by column and level; as long as the model's weights."""
    found = features.select(F.explode("indicators").alias("name")).distinct().toLocalIterator()
    by_column: dict[str, list[str]] = {c: [] for c in CATEGORICAL}
    for row in found:
        by_column[next(c for c in CATEGORICAL if row.name.startswith(f"{c}_"))].append(row.name)
    return [*NUMERIC, *(name for names in by_column.values() for name in sorted(names))]


def feature_totals(users: DataFrame) -> DataFrame:
    """(feature, total) over the whole feature frame."""
    features = feature_frame(users)
    sums = features.agg(*[F.sum(c).alias(c) for c in NUMERIC]).unpivot([], list(NUMERIC), "feature", "total")
    levels = features.select(F.explode("indicators").alias("feature")).groupBy("feature").agg(count_rows().cast("double").alias("total"))
    return sums.union(levels).select("feature", round_dp(F.col("total"), 2).alias("total"))


def feature_rows(users: DataFrame) -> DataFrame:
    """Per user the numeric features, and the names of the indicators that are 1, in feature order."""
    return feature_frame(users).select("user_id", *NUMERIC, F.concat_ws("|", "indicators").alias("indicators"))


def shuffle_key(user_id: Column) -> Column:
    """A fixed permutation of the ids modulo a prime, to order users without a seed."""
    prime = 2_147_483_647
    return F.pmod(F.pmod(user_id.cast("long"), F.lit(prime)) * 48_271, F.lit(prime))


def with_split(df: DataFrame, users: DataFrame, test_share: float = 0.25) -> DataFrame:
    """Add ``is_train``: in each churn class exactly the rounded test share is held out.

    One global order of (churn, shuffled id) finds the first training user of each
    class; those two keys then decide every row, so ``df`` (with user_id and churn)
    is neither joined nor shuffled.
    """
    keyed = users.select("user_id", "churn", shuffle_key(F.col("user_id")).alias("shuffled"))
    placed = row_index(keyed, ["churn", "shuffled", "user_id"])
    ones = F.count_if(F.col("churn") == 1)
    sizes = users.agg(F.struct(ones.alias("ones"), (count_rows() - ones).alias("zeros"))).scalar()
    churned = F.col("churn") == 1
    place = F.when(churned, F.col("row_index") - F.col("_s.zeros")).otherwise(F.col("row_index"))
    size = F.when(churned, F.col("_s.ones")).otherwise(F.col("_s.zeros"))
    first_train = F.floor(size * F.lit(test_share) + 0.5)
    starts = (
        placed.withColumn("_s", sizes)
        .where(place == first_train)
        .select(F.map_from_entries(F.collect_list(F.struct("churn", F.struct("shuffled", "user_id")))))
        .scalar()
    )
    own_key = F.struct(shuffle_key(F.col("user_id")).alias("shuffled"), "user_id")
    return (
        df.withColumn("_starts", starts)
        .withColumn("is_train", F.coalesce(own_key >= F.col("_starts")[F.col("churn")], F.lit(False)))
        .drop("_starts")
    )


def split(users: DataFrame) -> DataFrame:
    return with_split(users.select("user_id", "churn"), users)


def moments(train: DataFrame, names: Sequence[str]) -> Column:
    """Mean and population deviation per feature as one scalar; constants divide by 1."""

    def scale(name: str) -> Column:
        deviation = F.stddev_pop(f"`{name}`")
        return F.when(deviation > 0, deviation).otherwise(1.0)

    return train.agg(
        F.struct(
            F.array(*[F.avg(f"`{c}`") for c in names]).alias("mean"),
            F.array(*[scale(c) for c in names]).alias("scale"),
        )
    ).scalar()


def standardised(df: DataFrame, train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace each named feature by its distance from the training mean in deviations."""
    keep = [c for c in df.columns if c not in names]
    placed = df.withColumn("_m", moments(train, names))
    return placed.select(
        *keep,
        *[
            ((F.col(f"`{c}`") - F.col("_m.mean")[i]) / F.col("_m.scale")[i]).alias(c)
            for i, c in enumerate(names)
        ],
    )


def zscores(users: DataFrame) -> DataFrame:
    """Numeric features of all users, standardised by the training part."""
    values = users.select("user_id", "churn", *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    train = with_split(values, users).where("is_train")
    scaled = standardised(values, train, NUMERIC)
    return scaled.select("user_id", *[round_dp(F.col(c), 6).alias(f"z_{c}") for c in NUMERIC])


@dataclass(frozen=True)
class ChurnModel:
    """A fitted model over ``features``: user_id, churn, is_train, the numeric features, the
    indicators, and a sparse vector in training sample deviations that is not centred.

    ``means`` are in the same deviations; ``shrink`` leads from these to population deviations.
    """

    names: list[str]
    fitted: LogisticRegressionModel
    features: DataFrame
    means: np.ndarray
    scale: np.ndarray
    shrink: float

    @property
    def weights(self) -> list[float]:
        """Weight of each vector element."""
        return [float(w) for w in self.fitted.coefficients]

    @property
    def intercept(self) -> float:
        """The intercept of centred features: what their means add stands in it."""
        return float(self.fitted.intercept + self.fitted.coefficients.toArray() @ self.means)

    def coefficients(self) -> DataFrame:
        """Weight of each feature when it is measured in population deviations."""
        rows = [(name, weight * self.shrink) for name, weight in zip(self.names, self.weights)]
        return self.features.sparkSession.createDataFrame(rows, "feature string, coefficient double")

    def parts(self) -> list[tuple[str, float, float]]:
        """feature, slope (by unit of the feature) and base (what the feature adds at zero) of the centred score."""
        weights = self.fitted.coefficients.toArray()
        return list(zip(self.names, (weights * self.scale).tolist(), (-weights * self.means).tolist()))

    @cached_property
    def scores(self) -> DataFrame:
        """user_id, churn, is_train and the probability of churn, computed once."""
        probability = vector_to_array("probability")[1]
        scored = self.fitted.transform(self.features).select(
            "user_id", "churn", "is_train", probability.alias("probability")
        )
        return publish(scored, "scores")


def vectors(frame: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``raw``, a sparse vector of the numeric features and of the indicators by dictionary number."""
    levels = names[len(NUMERIC) :]
    columns = list(NUMERIC)
    if levels:
        numbered = CountVectorizerModel.from_vocabulary(levels, inputCol="indicators", outputCol="levels")
        frame, columns = numbered.transform(frame), [*columns, "levels"]
    return VectorAssembler(inputCols=columns, outputCol="raw").transform(frame).drop("levels")


def _fit(frame: DataFrame, names: list[str], max_iter: int = 1000) -> ChurnModel:
    """Divide by the deviations of the training rows and fit.

    Nothing is centred, so that vectors stay sparse: the intercept is free, takes up what the
    means add, and the weights are those of centred features. A penalty of |w|^2 / 2 against
    the summed loss is 1 / rows against the mean loss. The scaler divides by sample
    deviations; weights are penalised as if it were population deviations, which only
    rescales the penalty.
    """
    kept = ("user_id", "churn", "is_train", *NUMERIC, "indicators", "raw")
    assembled = publish(vectors(frame, names).select(*kept), "features")
    train = assembled.where("is_train")
    rows = train.count()
    shrink = ((rows - 1) / rows) ** 0.5
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True).fit(train)
    learner = LogisticRegression(
        labelCol="churn",
        maxIter=max_iter,
        tol=1e-9,
        regParam=shrink**2 / rows,
        elasticNetParam=0.0,
        standardization=False,
    )
    deviation = scaler.std.toArray()
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    return ChurnModel(
        names,
        learner.fit(scaler.transform(train)),
        scaler.transform(assembled).drop("raw"),
        scaler.mean.toArray() * scale,
        scale,
        shrink,
    )


def fit(users: DataFrame, max_iter: int = 1000) -> ChurnModel:
    """Fit on 75 % of the users, stratified by churn."""
    features = publish(feature_frame(users), "indicators")
    return _fit(with_split(features, users), feature_names(features), max_iter)


def evaluation(model: ChurnModel) -> DataFrame:
    """AUC, accuracy, precision and recall on the held-out users."""
    test = model.scores.where(~F.col("is_train"))
    quality = risk.confusion(test, "probability", 0.5)
    auc = risk.auc(test, "probability").select(round_dp(F.col("auc"), 3)).scalar()
    return quality.withColumn("auc", auc)


def coefficient_report(model: ChurnModel) -> DataFrame:
    weights = model.coefficients().select(
        "feature", round_dp(F.col("coefficient"), 6).alias("coefficient")
    )
    intercept = F.lit(model.intercept)
    constant = weights.limit(1).select(
        F.lit("(intercept)").alias("feature"), round_dp(intercept, 6).alias("coefficient")
    )
    return weights.unionByName(constant)


def drivers(model: ChurnModel, limit: int = 10) -> DataFrame:
    """Strongest features by absolute weight."""
    return (
        model.coefficients()
        .orderBy(F.abs("coefficient").desc(), "feature")
        .limit(limit)
        .select("feature", round_dp(F.col("coefficient"), 3).alias("coefficient"))
    )


def model_deciles(model: ChurnModel) -> DataFrame:
    return risk.with_quantile_decile(model.scores, "probability", "churn")


def scored_deciles(model: ChurnModel) -> DataFrame:
    """Deciles of the model score over all users."""
    return risk.decile_summary(model_deciles(model), "probability")


def reasons(model: ChurnModel, limit: int = 3) -> DataFrame:
    """Per user the features that move the score most, with their signed contribution.

    A user's candidates are the numeric features, the user's own indicators, and those of all
    others that move a score most when they are 0. Of the last the user has as many as there
    are categorical columns at most, so ``limit`` more than that are enough for everyone.
    """

    def reason(feature: Column, part: Column) -> Column:
        return F.struct(F.abs(part).alias("size"), feature.alias("feature"), round_dp(part, 6).alias("contribution"))

    # As long as the weights, which the driver holds as part of the fitted model.
    rows = model.parts()
    slopes = {feature: (slope, base) for feature, slope, base in rows[: len(NUMERIC)]}
    numeric = [reason(F.lit(c), F.col(c) * slopes[c][0] + slopes[c][1]) for c in NUMERIC]
    unset = sorted(rows[len(NUMERIC) :], key=lambda r: (abs(r[2]), r[0]), reverse=True)[: limit + len(CATEGORICAL)]
    absent = [reason(F.lit(feature), F.lit(base)) for feature, _, base in unset]
    parts = model.features.sparkSession.createDataFrame(rows, "feature string, slope double, base double")
    own = (
        model.features.select("user_id", F.explode("indicators").alias("feature"))
        .join(parts, "feature")
        .groupBy("user_id")
        .agg(F.collect_list(reason(F.col("feature"), F.col("slope") + F.col("base"))).alias("own"))
    )
    met = model.features.select("user_id", "indicators", *NUMERIC).join(own, "user_id", "left")
    others = [F.when(~F.array_contains("indicators", r[0]), part) for r, part in zip(unset, absent)]
    unheld = F.array_compact(F.array(*others)) if others else F.array()
    listed = F.concat(F.array(*numeric), unheld)
    candidates = F.when(F.col("own").isNull(), listed).otherwise(F.concat(listed, "own"))
    strongest = F.slice(F.sort_array(candidates, asc=False), 1, limit)
    return met.select("user_id", F.posexplode(strongest).alias("place", "reason")).select(
        "user_id", (F.col("place") + 1).alias("place"), "reason.feature", "reason.contribution"
    )


# Fixed value: the message shown instead of a model.
TOO_LITTLE = "Not enough data in the current filter selection to train the risk model."
DECILE_SCHEMA = "decile int, n long, churn_rate double, avg_score double, message string"


def guarded_deciles(users: DataFrame, more_than: int = 200) -> DataFrame:
    """Deciles of a model fitted on all given users, or one message row when they are
    too few or hold only one class."""
    facts = users.agg(count_rows().alias("n"), F.countDistinct("churn").alias("classes")).first()
    if facts.n <= more_than or facts.classes != 2:
        return users.sparkSession.createDataFrame([(None, None, None, None, TOO_LITTLE)], DECILE_SCHEMA)
    features = publish(feature_frame(users), "indicators")
    model = _fit(features.withColumn("is_train", F.lit(True)), feature_names(features))
    return scored_deciles(model).withColumn("message", F.lit(None).cast("string"))
