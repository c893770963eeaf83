"""Models as compositions of layers; forward passes with given weights.

Weights come as a dict of matrices (lists of rows) and biases (lists); `fixed_weights` gives deterministic ones, and
train.py fits them. Node results are log-probabilities (id, pos, val) unless said otherwise, link results
(src, dst, pos, val).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.operators import edges as E
from signet.operators import laplacian as L
from signet.operators import propagate as P
from signet.operators import structure as S
from signet.operators.iterate import kept
from signet.operators.proximity import InOut

from . import layers as Y

Matrix = list[list[float]]


def fixed(rows: int, cols: int) -> Matrix:
    """Deterministic weights: ((31 i + 17 j) mod 13 - 6) / 10."""
    return [[((i * 31 + j * 17) % 13 - 6) / 10 for j in range(cols)] for i in range(rows)]


def complex_of(real: DataFrame, imag: DataFrame) -> DataFrame:
    return real.join(imag.withColumnRenamed("val", "im"), ["id", "pos"]).select("id", "pos", F.col("val").alias("re"), "im")


def side_by_side(x: DataFrame, width: int) -> DataFrame:
    """(id, pos, val): real parts, then imaginary ones."""
    return P.concat((x.select("id", "pos", F.col("re").alias("val")), width), (x.select("id", "pos", F.col("im").alias("val")), width))


def magnetic_trunk(laplacian: DataFrame, x: DataFrame, weights: list[list[Matrix]], biases: list[list[float] | None], activation: bool) -> DataFrame:
    """Chebyshev layers over one rescaled Laplacian, with the complex rectifier after each if asked for."""
    for w, b in zip(weights, biases, strict=True):
        x = Y.chebyshev(laplacian, x, w, b)
        if activation:
            x = P.complex_relu(x)
    return x


def _laplacian(edges: DataFrame, nodes: DataFrame, q: float, signed: bool, absolute_degree: bool = True) -> DataFrame:
    degree = ("absolute" if absolute_degree else "net") if signed else "plain"
    return L.chebyshev_scaled(L.magnetic(edges, nodes, q, "sym", degree), nodes)


def magnet_node(edges: DataFrame, nodes: DataFrame, x: DataFrame, hidden: int, weights: list[list[Matrix]], out: Matrix, bias: list[float], q: float = 0.25, activation: bool = False, signed: bool = False) -> DataFrame:
    """Magnetic node classification (signed: on the signed Laplacian): trunk, real and imaginary side by side, linear, log softmax."""
    z = magnetic_trunk(_laplacian(edges, nodes, q, signed), x, weights, [None] * len(weights), activation)
    return P.softmax(P.dense(side_by_side(z, hidden), out, bias), log=True)


def pair_head(pairs: DataFrame, z: DataFrame, width: int, out: Matrix, bias: list[float]) -> DataFrame:
    """Linear scores of both endpoints' vectors, log softmax by pair."""
    both = P.pair_gather(pairs, z, width).select(F.struct("src", "dst").alias("id"), "pos", "val")
    return P.softmax(P.dense(both, out, bias), log=True).select("id.src", "id.dst", "pos", "val")


def magnet_link(edges: DataFrame, nodes: DataFrame, x: DataFrame, pairs: DataFrame, hidden: int, weights: list[list[Matrix]], out: Matrix, bias: list[float], q: float = 0.25, activation: bool = True, signed: bool = False) -> DataFrame:
    """Magnetic link prediction: the pair's four blocks are re_u, re_v, im_u, im_v."""
    z = magnetic_trunk(_laplacian(edges, nodes, q, signed), x, weights, [None] * len(weights), activation)
    part = lambda c: P.pair_gather(pairs, z.select("id", "pos", F.col(c).alias("val")), hidden)
    both = part("re").union(part("im").withColumn("pos", F.col("pos") + 2 * hidden)).select(F.struct("src", "dst").alias("id"), "pos", "val")
    return P.softmax(P.dense(both, out, bias), log=True).select("id.src", "id.dst", "pos", "val")


def dgcn_trunk(a: DataFrame, a_in: DataFrame | InOut, a_out: DataFrame | InOut, nodes: DataFrame, x: DataFrame, w1: Matrix, w2: Matrix) -> tuple[DataFrame, int]:
    """Two rounds of a dense step and propagation over the undirected, in- and out-proximity adjacencies, these as pairs or by their factors."""
    width = 0
    scales = [kept(e.symmetric(nodes)) if isinstance(e, InOut) else None for e in (a, a_in, a_out)]
    for w in (w1, w2):
        x = P.dense(x, w)
        width = len(w[0])
        parts = [(Y.dgcn_conv(e, nodes, x) if s is None else Y.in_out_conv(e, s, x, width), width) for e, s in zip((a, a_in, a_out), scales, strict=True)]
        x = kept(P.activate(P.concat(*parts), "relu"))  # each round reads it three times, and a link head twice
    return x, 3 * width


def dgcn_node(a, a_in, a_out, nodes, x, w1: Matrix, w2: Matrix, out: Matrix, bias: list[float]) -> DataFrame:
    z, _ = dgcn_trunk(a, a_in, a_out, nodes, x, w1, w2)
    return P.softmax(P.dense(z, out, bias), log=True)


def dgcn_link(a, a_in, a_out, nodes, x, pairs, w1: Matrix, w2: Matrix, out: Matrix, bias: list[float]) -> DataFrame:
    z, width = dgcn_trunk(a, a_in, a_out, nodes, x, w1, w2)
    return pair_head(pairs, z, width, out, bias)


def digcn_node(adjacency: DataFrame, x: DataFrame, w1: Matrix, b1: list[float], w2: Matrix, b2: list[float]) -> DataFrame:
    z = P.activate(Y.digcn_conv(adjacency, x, w1, b1), "relu")
    return P.softmax(Y.digcn_conv(adjacency, z, w2, b2), log=True)


def digcn_link(adjacency, x, pairs, w1, b1, w2, b2, out, bias) -> DataFrame:
    z = Y.digcn_conv(adjacency, P.activate(Y.digcn_conv(adjacency, x, w1, b1), "relu"), w2, b2)
    return pair_head(pairs, z, len(w2[0]), out, bias)


def inception_trunk(first: DataFrame, second: DataFrame, x: DataFrame, blocks: list[tuple]) -> DataFrame:
    """Inception blocks, each the sum of its three branches."""
    for weights, bias in blocks:
        x = P.add(*Y.inception(x, first, second, weights, bias))
    return x


def inception_node(first, second, x, blocks) -> DataFrame:
    return P.softmax(inception_trunk(first, second, x, blocks), log=True)


def inception_link(first, second, x, pairs, blocks, out, bias) -> DataFrame:
    z = inception_trunk(first, second, x, blocks)
    return pair_head(pairs, z, len(blocks[-1][1]), out, bias)


def cluster_head(z: DataFrame, out: Matrix, bias: list[float]) -> dict[str, DataFrame]:
    """The results of clustering models: normalised embedding, log-probabilities, assignment, probabilities."""
    s = P.dense(z, out, bias)
    return {"z": P.l2_normalized(z), "log_p": P.softmax(s, log=True), "pred": P.argmax(s), "p": P.softmax(s)}


def perceptron(x: DataFrame, w1: Matrix, w2: Matrix) -> DataFrame:
    return P.dense(P.activate(P.dense(x, w1), "relu"), w2)


def digrac(edges: DataFrame, nodes: DataFrame, x: DataFrame, hidden: int, mlp_s: tuple[Matrix, Matrix], mlp_t: tuple[Matrix, Matrix], out: Matrix, bias: list[float], hops: int = 2, fill: float = 0.5) -> dict[str, DataFrame]:
    """Directed clustering: source and target perceptrons, hop aggregation, softmax."""
    z = Y.dimpa(edges, nodes, perceptron(x, *mlp_s), perceptron(x, *mlp_t), hidden, hops, None, None, fill)
    return cluster_head(z, out, bias)


def sssnet(edges: DataFrame, nodes: DataFrame, x: DataFrame, hidden: int, mlps: list[tuple[Matrix, Matrix]], out: Matrix, bias: list[float], hops: int = 2, fill: float = 0.5, directed: bool = False) -> dict[str, DataFrame]:
    """Signed clustering: perceptrons (two, or four if directed), signed hop aggregation, softmax."""
    z = Y.simpa(E.positive(edges), E.negative(edges), nodes, [perceptron(x, *m) for m in mlps], hidden, hops, fill, directed)
    return cluster_head(z, out, bias)


def sssnet_link(edges, nodes, x, pairs, hidden, mlps, out, bias, hops: int = 2, fill: float = 0.5, directed: bool = False) -> DataFrame:
    z = Y.simpa(E.positive(edges), E.negative(edges), nodes, [perceptron(x, *m) for m in mlps], hidden, hops, fill, directed)
    return pair_head(pairs, z, hidden * (4 if directed else 2), out, bias)


def msgnn_node(edges, nodes, x, hidden, weights, out, bias, q: float = 0.25, activation: bool = False) -> dict[str, DataFrame]:
    """Magnetic signed node classification with the results of clustering models."""
    z = magnetic_trunk(_laplacian(edges, nodes, q, True), x, weights, [None] * len(weights), activation)
    return cluster_head(side_by_side(z, hidden), out, bias)


def sgcn(edges: DataFrame, x: DataFrame, width: int, layers: list[tuple[Matrix, Matrix]], normalize: bool = False) -> DataFrame:
    """Signed convolution layers from initial vectors, tanh after each."""
    for k, (b, u) in enumerate(layers):
        x = kept(P.activate(Y.sgcn_conv(edges, x, width, b, u, first=k == 0, normalize=normalize), "tanh"))
        width = len(b[0]) + len(u[0])
    return x


def snea(edges: DataFrame, nodes: DataFrame, x: DataFrame, width: int, layers: list[tuple], out: Matrix, bias: list[float]) -> DataFrame:
    """Signed attention layers, tanh after each, then a linear step with tanh."""
    for k, (w_b, w_u, a_b, a_u) in enumerate(layers):
        # a layer reads its input in many places: what it gives is computed once
        x = kept(P.activate(Y.snea_conv(edges, nodes, x, width, w_b, w_u, a_b, a_u, first=k == 0), "tanh"))
        width = len(w_b[0]) + len(w_u[0])
    return P.activate(P.dense(x, out, bias), "tanh")


def sigat(edges: DataFrame, nodes: DataFrame, x: DataFrame, width: int, gats: list[tuple], w1: Matrix, b1: list[float], w2: Matrix, b2: list[float]) -> DataFrame:
    """Attention over each of the 38 motif lists, side by side with x, through two dense steps."""
    z = P.concat((x, width), (S.motif_attention(edges, nodes, x, gats), len(gats) * len(gats[0][0][0])))
    return P.dense(P.activate(P.dense(z, w1, b1), "tanh"), w2, b2)


def sdgnn(edges: DataFrame, nodes: DataFrame, x: DataFrame, width: int, layers: list[tuple]) -> DataFrame:
    """Attention layers over the four signed adjacency lists."""
    names = F.array(*[F.lit(n) for n in ("pos_out", "pos_in", "neg_out", "neg_in")])
    motifs = S.adjacency_lists(edges).select((F.array_position(names, F.col("list")) - 1).cast("int").alias("motif"), "src", "dst")
    for gats, w1, b1, w2, b2 in layers:
        x = kept(Y.sdr_layer(motifs, nodes, x, width, gats, w1, b1, w2, b2))
        width = len(b2)
    return x


def digcl_encoder(edges: DataFrame, nodes: DataFrame, x: DataFrame, layers: list[tuple[Matrix, list[float]]], activation: str = "prelu") -> DataFrame:
    for w, b in layers:
        x = P.activate(Y.gcn_conv(edges, nodes, x, w, b), activation)
    return x


def digcl_projection(z: DataFrame, w1: Matrix, b1: list[float], w2: Matrix, b2: list[float]) -> DataFrame:
    return P.dense(P.activate(P.dense(z, w1, b1), "elu"), w2, b2)
