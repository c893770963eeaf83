"""Leading eigenvectors by orthogonal iteration over relational matrix-vector products.

Vectors stay distributed in long form; each step brings only a k x k matrix of inner products to the driver, whose
Cholesky factor makes the vectors orthonormal again. Eigenvectors are unique up to sign and rotation only."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edges as E
from . import laplacian as L
from . import propagate as P
from .generators import gaussian_features
from .iterate import kept


def inner_products(x: DataFrame, y: DataFrame, k: int) -> np.ndarray:
    """X^T Y, k x k."""
    both = x.select("id", F.col("pos").alias("i"), F.col("val").alias("a")).join(y.select("id", F.col("pos").alias("j"), F.col("val").alias("b")), "id")
    out = np.zeros((k, k))
    for r in both.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect():  # k * k rows
        out[r["i"], r["j"]] = r["s"]
    return out


def leading(matvec: Callable[[DataFrame], DataFrame], nodes: DataFrame, k: int, iterations: int = 30, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(eigenvalues, vectors (id, pos, val)) of largest magnitude of an operator on long vectors, in descending real part."""
    x = kept(gaussian_features(nodes, k, seed))
    for _ in range(iterations):
        y = kept(matvec(x))
        gram = inner_products(y, y, k)
        gram += np.eye(k) * 1e-12 * max(1.0, np.trace(gram))
        back = np.linalg.inv(np.linalg.cholesky(gram)).T
        x = kept(P.dense(y, back.tolist()))
    small = inner_products(x, kept(matvec(x)), k)
    if np.allclose(small, small.T, atol=1e-8 + 1e-6 * np.abs(small).max()):
        values, turn = np.linalg.eigh((small + small.T) / 2)
    else:
        values, turn = (v.real for v in np.linalg.eig(small))
    order = np.argsort(-values)
    return values[order], P.dense(x, turn[:, order].tolist())


def residual(matvec: Callable[[DataFrame], DataFrame], values: np.ndarray, x: DataFrame) -> list[float]:
    """|A v - lambda v| for each column."""
    lam = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("pos") + 1)
    gap = P.add(matvec(x), x.withColumn("val", -F.col("val") * lam))
    return [r["r"] for r in gap.groupBy("pos").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("r")).orderBy("pos").collect()]


def _times(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    a = kept(edges)
    return lambda x: P.spmm(a, x, to="src")


def signed_laplacian_features(edges: DataFrame, nodes: DataFrame, k: int = 2, iterations: int = 30) -> DataFrame:
    """Vectors of the k largest eigenvalues of I - D^-1/2 A D^-1/2, over their eigenvalues; the spectrum lies in [0, 2]."""
    values, x = leading(_times(L.signed_laplacian(edges, nodes)), nodes, k, iterations)
    scale = F.element_at(F.array(*[F.lit(float(1 / v)) if v else F.lit(0.0) for v in values]), F.col("pos") + 1)
    return x.withColumn("val", F.col("val") * scale)


def regularized_features(edges: DataFrame, nodes: DataFrame, k: int = 2, normalization: str | None = None, tau_p: float | None = None, tau_n: float | None = None, iterations: int = 30) -> DataFrame:
    """Vectors times values of the k largest eigenvalues of the regularised adjacency operator.

    A shift by a bound of the spectrum makes the largest also those of largest magnitude."""
    g, v = kept(edges), kept(nodes.select("id"))
    top = g.groupBy("src").agg(F.sum(F.abs("w")).alias("d")).agg(F.max("d")).first()[0] or 0.0
    shift = float(top if normalization is None else 1.0) + 0.5

    def matvec(x: DataFrame) -> DataFrame:
        parts = [L.regularized_matvec(g, v, x.filter(F.col("pos") == p).select("id", "val"), normalization, tau_p, tau_n).select("id", F.lit(p).alias("pos"), "val") for p in range(k)]
        return P.add(*parts, x.select("id", "pos", (F.col("val") * shift).alias("val")))

    values, x = leading(matvec, v, k, iterations)
    return x.withColumn("val", F.col("val") * F.element_at(F.array(*[F.lit(float(t - shift)) for t in values]), F.col("pos") + 1))


def hermitian_features(edges: DataFrame, nodes: DataFrame, k: int = 2, iterations: int = 30) -> DataFrame:
    """2k standardised columns: leading left singular vectors of the row-normalised Hermitian adjacency.

    The matrix is i B with B real, so its left singular vectors are those of B; of an antisymmetric pattern they come
    in pairs, which stand for the real and imaginary parts."""
    b = kept(L.hermitian_row_normalized(edges).select("src", "dst", F.col("im").alias("w")))
    _, x = leading(lambda v: P.spmm(b, P.spmm(b, v, to="dst"), to="src"), nodes, 2 * k, iterations)
    return P.standardized(P.add(x, nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("pos"), F.lit(0.0).alias("val"))))


def spectral_features(edges: DataFrame, nodes: DataFrame, k: int, iterations: int = 30) -> DataFrame:
    """Right singular vectors of the symmetrised sign matrix, the largest singular values first."""
    values, x = leading(_times(L.spectral_signs(edges)), nodes, k, iterations)
    order = np.argsort(-np.abs(values))
    place = F.element_at(F.array(*[F.lit(int(np.flatnonzero(order == p)[0])) for p in range(k)]), F.col("pos") + 1)
    return x.withColumn("pos", place)


def lambda_max(laplacian: DataFrame, nodes: DataFrame, iterations: int = 50) -> float:
    """Eigenvalue of largest magnitude of a Hermitian matrix (src, dst, re, im), by power iteration on real and imaginary parts."""
    lap = kept(laplacian)

    def times(x: DataFrame) -> DataFrame:
        e = lap.join(x.withColumnRenamed("id", "dst"), "dst")
        return e.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("a"), F.sum(F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("b"))

    g = gaussian_features(nodes, 2)
    x = kept(g.groupBy("id").agg(F.sum(F.when(F.col("pos") == 0, F.col("val"))).alias("a"), F.sum(F.when(F.col("pos") == 1, F.col("val"))).alias("b")))
    value = 0.0
    for _ in range(iterations):
        y = kept(times(x))
        size, dot, own = y.join(x.select("id", F.col("a").alias("xa"), F.col("b").alias("xb")), "id", "full_outer").na.fill(0.0).agg(
            F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")), F.sum(F.col("a") * F.col("xa") + F.col("b") * F.col("xb")), F.sum(F.col("xa") * F.col("xa") + F.col("xb") * F.col("xb"))).first()
        if not size:
            return 0.0
        value, norm = dot / own, math.sqrt(size)
        x = y.select("id", (F.col("a") / norm).alias("a"), (F.col("b") / norm).alias("b"))
    return value


def magnetic_lambda_max(edges: DataFrame, nodes: DataFrame, q: float = 0.25, degree: str = "plain", iterations: int = 50) -> float:
    return lambda_max(L.magnetic(E.without_loops(edges), nodes, q, None, degree), nodes, iterations)
