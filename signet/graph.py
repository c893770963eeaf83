"""The graph container: an edge table, a node table and the operators over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.operators import edges as E
from signet.operators import laplacian as L
from signet.operators import splits, structure


class Graph:
    """edges(src, dst, w), coalesced, without weights of 0; nodes(id, ...); n is one more than the largest id."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, n: int):
        self.edges, self.nodes, self.n = edges, nodes, n

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, n: int | None = None) -> Graph:
        """Weights default to 1. Without nodes, all ids from 0 to n - 1 (or to the largest in the edges) are nodes."""
        edges = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
        edges = E.coalesce(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"))).filter("w <> 0")
        if n is None:
            top = (nodes.agg(F.max("id")) if nodes is not None else edges.agg(F.max(F.greatest("src", "dst")))).first()[0]
            n = 0 if top is None else int(top) + 1
        return cls(edges, nodes if nodes is not None else edges.sparkSession.range(n), n)

    @classmethod
    def from_parts(cls, positive: DataFrame, negative: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """From a positive and a negative part, both with weights above 0."""
        return cls.from_edges(positive.unionByName(negative.withColumn("w", -F.col("w"))), nodes)

    positive = property(lambda self: E.positive(self.edges))
    negative = property(lambda self: E.negative(self.edges))

    def _predicate(self, name: str) -> bool:
        return E.predicates(self.edges).first()[name]

    is_signed = property(lambda self: self._predicate("is_signed"))
    is_directed = property(lambda self: self._predicate("is_directed"))

    def is_weighted(self, signed: bool = False) -> bool:
        return self._predicate("is_weighted_signed" if signed else "is_weighted")

    def to_unweighted(self, signed: bool = False) -> Graph:
        return Graph(E.unweighted(self.edges, signed), self.nodes, self.n)

    def inherit(self, other: DataFrame) -> Graph:
        """Node columns of another table that this one lacks."""
        extra = [c for c in other.columns if c != "id" and c not in self.nodes.columns]
        return Graph(self.edges, self.nodes.join(other.select("id", *extra), "id", "left"), self.n)

    def transform(self, fn) -> Graph:
        return fn(self)

    def summary(self) -> DataFrame:
        return E.summary(self.edges, self.nodes)

    def degrees(self, signed: bool = False) -> DataFrame:
        return (E.signed_degrees if signed else E.degrees)(self.edges, self.nodes)

    def magnetic_laplacian(self, q: float = 0.25, normalization: str | None = "sym", signed: bool = False, absolute_degree: bool = True) -> DataFrame:
        return L.magnetic(self.edges, self.nodes, q, normalization, ("absolute" if absolute_degree else "net") if signed else "plain")

    def extract(self, lowest_degree: int = 2, rounds: int = 10) -> Graph:
        e, v = structure.extract_network(self.edges, self.nodes, lowest_degree, rounds)
        return Graph(e, v, self.n)

    def node_split(self, labels: DataFrame, **sizes) -> DataFrame:
        return splits.node_split(labels, **sizes)

    def link_split(self, task: str | None = None, signed: bool = False, maintain_connect: bool | None = None, **how) -> tuple[DataFrame, DataFrame]:
        """Signed graphs default to the sign task without a kept forest, directed ones to direction with it."""
        task = task or ("sign" if signed else "direction")
        if not signed and task == "sign":
            raise ValueError("the sign task needs a signed graph")
        keep = (not signed) if maintain_connect is None else maintain_connect
        return splits.link_split(self.edges, self.nodes, self.n, task, maintain_connect=keep, **how)
