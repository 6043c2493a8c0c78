"""Model operators: weighted logistic pair verifier, tree ensembles, leave-one-family-out, hybrid evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_score
from ..scratch import settle
from . import trees
from .trees import balanced, grow_and_score, score_boosted, told_apart
from .vectors import dot, normalise

#: Matrices of the pair verifier up to this number of rows are fitted on the driver.
FIT_ROWS = 200_000


# Fixed values of the pair verifier's descent: first learning rate, steps after which it has halved, ridge penalty.
RATE, HALVED, RIDGE = 0.08, 2000, 0.002


def fit_pair_verifier(rows: DataFrame, features: str = "v", label: str = "y", steps: int = 6000, l2: float = RIDGE) -> dict:
    """UDF-02: logistic regression in which both classes weigh the same unless positives prevail, from zero coefficients by
    gradient descent at a decaying rate.

    Means and deviations are aggregated over all rows. The descent needs every row in every step, so it runs on the
    driver: the matrix is 12 numbers a row, and beyond FIT_ROWS rows a hash-drawn sample of that size is fitted.
    """
    at = [F.element_at(features, k + 1) for k in range(rows.select(F.max(F.size(features))).first()[0])]
    whole = rows.agg(F.count("*").alias("n"), F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.stddev_pop, at)).alias("std")).first()
    if whole["n"] > FIT_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64(features), F.lit(1 << 30)) < F.lit(int(FIT_ROWS / whole["n"] * (1 << 30))))
    mean, std = np.array(whole["mean"]), np.maximum(np.array(whole["std"]), 1e-6)
    table = rows.select(features, label).toPandas()
    positive = table[label].to_numpy() > 0
    # the intercept is one more column, of ones, that no penalty shrinks
    design = np.column_stack([(np.stack(table[features].to_numpy()) - mean) / std, np.ones(len(table))])
    share = np.where(positive, max(1.0, (~positive).sum() / max(1, positive.sum())), 1.0)
    share, penalty = share / share.sum(), np.r_[np.full(len(mean), l2), 0.0]
    target, theta = design.T @ (share * positive), np.zeros(len(mean) + 1)
    for rate in RATE / (1 + np.arange(steps) / HALVED):
        expected = design.T @ (share / (1 + np.exp(-np.clip(design @ theta, -30, 30))))
        theta = theta - rate * (expected - target + penalty * theta)
    return {"mean": mean.tolist(), "std": std.tolist(), "weights": theta[:-1].tolist(), "bias": float(theta[-1])}


def score_pairs(rows: DataFrame, model: dict, features: str = "v") -> DataFrame:
    return rows.withColumn("probability", linear_score(F.col(features), model["mean"], model["std"], model["weights"], model["bias"]))


# The classifiers' parameters. Inverse ridge strength of the logistic model; number, depth, smallest leaf and
# share of features of the forests' trees; rounds, rate, leaves, smallest leaf and ridge of boosting.
PAIR_LEVEL = {"c": 0.5, "trees": 500, "forest_depth": None, "extra_depth": None, "leaf": 3, "share": 0.75, "rounds": 250, "rate": 0.04, "leaves": 12, "boosted_leaf": 10, "l2": 1.0}
QUERY_LEVEL = {"c": 0.08, "trees": 800, "forest_depth": 5, "extra_depth": 6, "leaf": 3, "share": 0.45, "rounds": 250, "rate": 0.035, "leaves": 8, "boosted_leaf": 8, "l2": 2.0}


def fit_all(train: DataFrame, test: DataFrame, how: dict, features: str = "v", seed: int = 42) -> DataFrame:
    """UDF-03/04: probability of every test row under each of four classifiers (model, and test's columns), fitted on the
    train rows with both classes weighing the same.

    logistic: Spark ML's on standardised features, its penalty that of C / n. forest: trees of bags of the rows, with the
    classes of each bag weighing the same. extra: extremely randomised trees, and boosted: histogram boosting; all three of
    ``trees``.
    """
    train = settle(balanced(told_apart(train.select(F.col(features).alias("v"), F.col("y").cast("double").alias("y")))), "train")
    n = max(1, train.count())
    logistic = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (how["c"] * n), maxIter=500, tol=1e-9)
    scored = logistic.fit(train.withColumn("x", array_to_vector("v"))).transform(test.withColumn("x", array_to_vector(features)))
    out = [("logistic", scored.withColumn("probability", vector_to_array("probability")[1]).select(*test.columns, "probability"))]
    for name, bagged in (("forest", True), ("extra", False)):
        out.append((name, grow_and_score(train, test, how["trees"], how["leaf"], how["share"], how[f"{name}_depth"], seed, bagged, features).select(*test.columns, "probability")))
    out.append(("boosted", score_boosted(test, fit_boosted(train, how), features).select(*test.columns, "probability")))
    return reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(name)) for name, df in out])


def fit_boosted(train: DataFrame, how: dict) -> dict:
    """Histogram boosting of all rows (v, y, w)."""
    return trees.fit_boosted(train, how["rounds"], how["rate"], how["leaves"], how["boosted_leaf"], how["l2"])


def leave_one_family_out(rows: DataFrame, family: str, features: str = "v", steps: int = 6000) -> DataFrame:
    """UDF-06: each family scored by a pair verifier fitted on the others. Families are few (one fit each)."""
    out = None
    for (name,) in rows.select(family).distinct().orderBy(family).collect():
        model = fit_pair_verifier(rows.filter(F.col(family) != name), features, steps=steps)
        part = score_pairs(rows.filter(F.col(family) == name), model, features)
        out = part if out is None else out.unionByName(part)
    return out


def training_pairs(queries: DataFrame, controls: DataFrame) -> DataFrame:
    """UDF-09: one row per candidate: positive queries' candidates are labelled by their source, controls' are negative.

    queries: query_id, expected, top3 array<struct<track, score>>; controls: query_id, top3.
    """
    p = queries.select("query_id", "expected", F.explode("top3").alias("c")).select("query_id", "c.*", F.coalesce((F.col("c.track") == F.col("expected")).cast("long"), F.lit(0).cast("long")).alias("label"))
    return p.unionByName(controls.select("query_id", F.explode("top3").alias("c")).select("query_id", "c.*", F.lit(0).cast("long").alias("label")))


def contrastive_loss(rows: DataFrame, batch: str, key: str, label: str, vector: str = "v", temperature: float = 0.07) -> DataFrame:
    """UDF-07: supervised contrastive loss of each batch: over the anchors that share their label with another row, the mean
    of log(sum of exp of all similarities) less the mean similarity to rows of the same label. Batches are small (each row
    meets its batch), similarities are of unit vectors, so their exponentials stay finite."""
    unit = rows.select(batch, key, label, normalise(F.col(vector)).alias("v"))
    other = unit.select(batch, F.col(key).alias("_k"), F.col(label).alias("_l"), F.col("v").alias("_v"))
    x = dot(F.col("v"), F.col("_v")) / temperature
    met = unit.join(other, batch).filter(F.col(key) != F.col("_k")).select(batch, key, (F.col(label) == F.col("_l")).alias("same"), x.alias("x"))
    anchor = met.groupBy(batch, key).agg((F.log(F.sum(F.exp("x"))) - F.avg(F.when(F.col("same"), F.col("x")))).alias("loss"))
    return anchor.groupBy(batch).agg(F.count("loss").alias("anchors"), F.avg("loss").alias("loss"))


def hybrid_report(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """UDF-08: counts and rates of decisions in every part a row belongs to."""
    flagged, hold = F.col("decision").isin("WARN", "HOLD", "BLOCK"), F.col("decision").isin("HOLD", "BLOCK")
    rate = lambda c, side: F.round(F.avg(F.when(side, c.cast("double"))), 6)
    pos = F.col("positive")
    return (rows.withColumn("part", F.explode(parts)).groupBy("part")
            .agg(F.count("*").alias("n"), rate(flagged, pos).alias("recall"), rate(flagged, ~pos).alias("fpr"), rate(hold, pos).alias("hold_recall"), rate(hold, ~pos).alias("hold_fpr"),
                 F.count_if(pos & ~flagged).alias("missed")))
