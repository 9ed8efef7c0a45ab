"""The procurement views of one folder of driver tables.

Releases, release metadata, chunks, profiles and lots are planned from the given tables on every access
(``tenderlake.sources.procurement``).  ``prepare`` writes them once as Parquet, sorted within files by their key, into a
folder that the caller names; ``use_prepared`` makes ``Views`` of those tables read that folder.  Benches and tests do so
in their set-up; nothing in the library does it by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.sources import procurement as P
from tenderlake.sources.tables import TABLE_NAMES, Tables


def _chunk_hash_vectors(t: Tables) -> DataFrame:
    from tenderlake.operators.embed import MODEL_DIM, hash_embed
    return hash_embed(P.chunks(t).select("doc_id", "text"), "doc_id", "text", MODEL_DIM)


# view -> (its plan, sort columns within files)
PLANS = {
    "lots": (P.lots, ["orderkey", "lot_num"]),
    "releases": (P.releases, ["ocid"]),
    "release_meta": (P.release_meta, ["date", "ocid"]),
    "chunks": (P.chunks, ["ocid", "doc_id"]),
    "chunk_hash_vectors": (_chunk_hash_vectors, ["doc_id"]),
    "profiles": (P.profiles, ["id"]),
}
_PREPARED: dict[str, str] = {}


def prepare(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write every view of ``sf_dir`` into ``folder``."""
    tables = Tables(spark, sf_dir)
    for name, (plan, order) in PLANS.items():
        plan(tables).sortWithinPartitions(*order).write.parquet(f"{folder.rstrip('/')}/{name}")


def use_prepared(sf_dir: str, folder: str | None) -> None:
    """Read the views of ``sf_dir`` from ``folder`` from now on; None: plan them again."""
    if folder is None:
        _PREPARED.pop(sf_dir.rstrip("/"), None)
    else:
        _PREPARED[sf_dir.rstrip("/")] = folder.rstrip("/")


class Views:
    """Attribute access to the procurement views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = Tables(spark, sf_dir)

    def _view(self, name: str) -> DataFrame:
        folder = _PREPARED.get(self.sf_dir.rstrip("/"))
        return PLANS[name][0](self.tables) if folder is None else self.spark.read.parquet(f"{folder}/{name}")

    @property
    def releases(self) -> DataFrame:
        return self._view("releases")

    @property
    def meta(self) -> DataFrame:
        return self._view("release_meta")

    @property
    def chunks(self) -> DataFrame:
        return self._view("chunks")

    @property
    def chunk_hash_vectors(self) -> DataFrame:
        return self._view("chunk_hash_vectors")

    @property
    def profiles(self) -> DataFrame:
        return self._view("profiles")

    @property
    def lots(self) -> DataFrame:
        return self._view("lots")

    @property
    def requests(self) -> DataFrame:
        ids = self.profiles.select(F.col("id").alias("profile_id"))
        unknown = self.spark.range(1).select(F.lit(P.UNKNOWN_PROFILE_ID).alias("profile_id"))
        return ids.unionByName(unknown)

    @property
    def notices(self) -> DataFrame:
        return P.notices(self.tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return getattr(self.tables, name)
        raise AttributeError(name)
