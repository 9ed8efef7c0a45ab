"""tenderlake: procurement search, matching and market reports on Spark.

Sub-packages
------------
sources    table readers, procurement views derived from the driver tables, sinks
functions  Column builders (filters, text, vectors, release fields)
operators  DataFrame -> DataFrame jobs (top-k, matching, listing, profiles, ...)
streaming  Structured Streaming jobs (notice merge, alerts, daily counts)
plans      the registry of named queries and their DuckDB oracle SQL
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers (Arrow batches, pandas UDFs) are pickled
# by value, so executors need numpy/pandas/pyarrow but not this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from tenderlake.session import get_session, checkpoint_dir  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
