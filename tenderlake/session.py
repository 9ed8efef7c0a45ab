"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; the library only reads
its settings.  ``get_session`` is for tests, benches and local runs.
"""

from __future__ import annotations

import contextlib
import contextvars
import itertools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tenderlake", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes."""
    master = master or os.environ.get("TENDERLAKE_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir``, else the folder the context was given by ``setCheckpointDir``.
    A local session (tests) without either gets a scratch folder of its own; on a cluster a
    machine-local folder would not be seen by the executors, so the setting is required there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tenderlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


_SCOPE: contextvars.ContextVar = contextvars.ContextVar("tenderlake_scratch", default=None)


@contextlib.contextmanager
def scratch_scope(folder: str):
    """Within it, what ``write_once`` writes goes to numbered names under ``folder``, in the order of the calls.

    A job that does the same steps again and again (a micro-batch) uses the same names each time and overwrites
    them, so its scratch tables do not pile up."""
    token = _SCOPE.set((folder.rstrip("/"), itertools.count()))
    try:
        yield
    finally:
        _SCOPE.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, or the next one of a scratch scope."""
    scope = _SCOPE.get()
    if scope is not None:
        return f"{scope[0]}/{next(scope[1])}-{name}"
    return f"{checkpoint_dir(spark).rstrip('/')}/tenderlake-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is executed within it has its shuffle files removed at its end, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What is read twice is computed once, a lost executor re-reads files, and the planner knows the
    size of the result, so it chooses between broadcast and shuffle by bytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists" if _SCOPE.get() is None else "overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
