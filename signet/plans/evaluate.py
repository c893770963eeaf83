"""Logistic-regression evaluators on embeddings, with Spark's own learners and the aggregate metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.operators.propagate import l2_normalized, pair_gather

from . import metrics


def vectors(x: DataFrame, key: list[str]) -> DataFrame:
    """(key..., features) from long form, positions in order."""
    packed = x.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("v"))
    return packed.select(*key, array_to_vector(F.transform("v", lambda s: s["val"])).alias("features"))


def pair_vectors(pairs: DataFrame, z: DataFrame, width: int) -> DataFrame:
    return vectors(pair_gather(pairs, z, width), ["src", "dst"]).join(pairs, ["src", "dst"])


def link_sign(train: DataFrame, test: DataFrame, z: DataFrame, width: int) -> DataFrame:
    """One row: accuracy, f1_binary, f1_macro, f1_micro, auc of sign prediction; train and test (src, dst, y in 0/1)."""
    model = LogisticRegression(maxIter=1000, regParam=0.0, labelCol="y").fit(pair_vectors(train, z, width))
    from pyspark.ml.functions import vector_to_array

    said = model.transform(pair_vectors(test, z, width)).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))
    return metrics.classification(said).crossJoin(metrics.auc(said))


def link_classes(train: DataFrame, test: DataFrame, z: DataFrame, width: int) -> DataFrame:
    """One row of the classification metrics of sign and direction classes."""
    model = LogisticRegression(maxIter=1000, regParam=0.0, labelCol="y", family="multinomial").fit(pair_vectors(train, z, width))
    said = model.transform(pair_vectors(test, z, width)).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
    return metrics.classification(said)


def _best(rows: DataFrame, powers: list[int], folds: int) -> OneVsRest:
    """The one-versus-rest learner of the best strength by cross-validated accuracy; folds by hash of the rows."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "features"]), F.lit(folds)))
    best, score = None, -1.0
    for p in powers:
        learner = OneVsRest(classifier=LogisticRegression(maxIter=100, regParam=2.0**-p / max(1, rows.count())), labelCol="y")
        right = [learner.fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] for k in range(folds)]
        mean = sum(r or 0.0 for r in right) / folds
        if mean > score:
            best, score = learner, mean
    return best


def node_classes(z: DataFrame, labels: DataFrame, train: DataFrame, test: DataFrame | None = None, powers=tuple(range(-10, 10)), folds: int = 5) -> DataFrame:
    """One row of metrics of node classes from normalised embeddings; without test, all nodes outside train."""
    rows = vectors(l2_normalized(z), ["id"]).join(labels.select("id", F.col("y").cast("double").alias("y")), "id")
    fit = rows.join(train.select("id"), "id", "left_semi")
    held = rows.join((test if test is not None else labels.select("id").join(train.select("id"), "id", "left_anti")).select("id"), "id", "left_semi")
    model = _best(fit, list(powers), folds).fit(fit)
    return metrics.classification(model.transform(held).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")))


def link_labels(z: DataFrame, train: DataFrame, test: DataFrame, width: int, powers=tuple(range(-10, 10)), folds: int = 5) -> DataFrame:
    """One row of metrics of link classes from the normalised embeddings of both ends; train and test (src, dst, y)."""
    n = l2_normalized(z)
    fit = pair_vectors(train, n, width).withColumn("y", F.col("y").cast("double"))
    model = _best(fit, list(powers), folds).fit(fit)
    return metrics.classification(model.transform(pair_vectors(test, n, width)).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")))
