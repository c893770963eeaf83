"""Column functions: deterministic random numbers and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """Hexadecimal MD5 of the parts joined with ':'; orders rows at random, the same way everywhere."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of hash_key."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def exponential(*parts) -> Column:
    return -F.log(F.lit(1.0) - uniform(*parts))


def inverse_root(d: Column) -> Column:
    """d^(-1/2), 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(F.pow(d, F.lit(-0.5)))


def inverse(d: Column) -> Column:
    """1/d, 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(F.lit(1.0) / F.when(d == 0, 1.0).otherwise(d))


def sqrt_inverse_diagonal(d: Column) -> Column:
    """1 / max(sqrt(d), 1/999999999)."""
    return F.lit(1.0) / F.greatest(F.sqrt(d), F.lit(1 / 999999999))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def leaky(x: Column, slope: float) -> Column:
    """Parametric and randomized leaky rectifiers at a fixed slope."""
    return F.when(x >= 0, x).otherwise(x * slope)


ACTIVATIONS = {"relu": relu, "tanh": F.tanh, "elu": elu, "sigmoid": sigmoid, "prelu": lambda x: leaky(x, 0.25), "rrelu": lambda x: leaky(x, (1 / 8 + 1 / 3) / 2), "none": lambda x: x}


def rounded(x: Column, digits: int = 6) -> Column:
    """For results that are compared: rounded, and never -0.0."""
    return F.round(x, digits) + F.lit(0.0)
