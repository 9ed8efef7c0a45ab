"""Join helpers shared by the lookup-style operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tenderlake.session import write_once


def reduce_to_keys(big: DataFrame, keys: DataFrame, key: str, written: bool = False) -> DataFrame:
    """Rows of ``big`` whose ``key`` occurs in ``keys``.

    The keys are written once (unless they come from a written table), so Spark knows their size in bytes: a
    set under its broadcast threshold filters ``big`` where it lies, a larger one is joined by shuffle."""
    small = keys.select(key).distinct()
    return big.join(small if written else write_once(small, "keys"), key, "left_semi")
