"""Vector Column builders (all JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``),
    so an expression used inside a lambda is not recomputed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column | str, as_float: bool = True) -> Column:
    """Divide by the L2 norm; a zero vector is returned unchanged."""
    def body(vec: Column) -> Column:
        return let(l2_norm(vec), lambda n: F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n))
                   .otherwise(F.transform(vec, lambda x: x.cast("double"))))
    out = let(_c(v), body)
    return out.cast("array<float>") if as_float else out


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
