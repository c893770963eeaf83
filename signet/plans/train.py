"""Full-batch training of propagation models.

Forward and backward products with the adjacency are the same joins as in the layers (the backward of S x W is
S^T g and x^T g); only weight gradients, as large as the weights, come to the driver, where Adam keeps its state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.operators import propagate as P
from signet.operators.edges import reverse
from signet.operators.iterate import kept


def outer(x: DataFrame, g: DataFrame, rows: int, cols: int) -> np.ndarray:
    """x^T g as a matrix on the driver."""
    both = x.select("id", F.col("pos").alias("i"), F.col("val").alias("a")).join(g.select("id", F.col("pos").alias("j"), F.col("val").alias("b")), "id")
    out = np.zeros((rows, cols))
    for r in both.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect():  # rows * cols numbers
        out[r["i"], r["j"]] = r["s"]
    return out


class Adam:
    def __init__(self, rate: float = 0.01, decay: float = 0.0):
        self.rate, self.decay, self.step, self.state = rate, decay, 0, {}

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            g = g + self.decay * weights[k]
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.state[k] = m, v
            weights[k] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


class NodeClassifier:
    """Two rounds of propagation: log softmax(S relu(S x W1) W2), for any normalised adjacency S (src, dst, w)."""

    def __init__(self, features: int, hidden: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        self.shape, self.weights = (features, hidden, classes), {"w1": glorot(features, hidden), "w2": glorot(hidden, classes)}

    def forward(self, s: DataFrame, sx: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hidden after propagation, log-probabilities); sx is S x."""
        h = P.activate(P.dense(sx, self.weights["w1"].tolist()), "relu")
        sh = P.spmm(s, h)
        return sh, P.softmax(P.dense(sh, self.weights["w2"].tolist()), log=True)

    def fit(self, s: DataFrame, x: DataFrame, labels: DataFrame, epochs: int = 50, rate: float = 0.05, decay: float = 5e-4) -> list[float]:
        """Mean losses by epoch; labels (id, y) of the training nodes."""
        s, adam, history = kept(s), Adam(rate, decay), []
        sx, back = kept(P.spmm(s, x)), reverse(s)
        own = kept(labels.select("id", "y"))
        n = own.count()
        for _ in range(epochs):
            sh, log_p = self.forward(s, sx)
            sh, log_p = kept(sh), kept(log_p)
            hit = own.join(log_p, "id")
            history.append(hit.agg(F.sum(F.when(F.col("pos") == F.col("y"), -F.col("val")))).first()[0] / n)
            g = hit.select("id", "pos", ((F.exp("val") - (F.col("pos") == F.col("y")).cast("double")) / n).alias("val"))
            g_w2 = outer(sh, g, self.shape[1], self.shape[2])
            g_h = P.spmm(back, P.dense(g, self.weights["w2"].T.tolist()))
            raw = P.dense(sx, self.weights["w1"].tolist()).withColumnRenamed("val", "raw")
            g_h = g_h.join(raw, ["id", "pos"]).select("id", "pos", F.when(F.col("raw") > 0, F.col("val")).otherwise(0.0).alias("val"))
            adam.update(self.weights, {"w1": outer(sx, g_h, self.shape[0], self.shape[1]), "w2": g_w2})
        return history

    def predict(self, s: DataFrame, x: DataFrame) -> DataFrame:
        return P.argmax(self.forward(s, P.spmm(s, x))[1])
