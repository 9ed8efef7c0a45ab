"""Posting tables for prefix and substring filters.

A predicate on an array column, or a substring of a name, cannot be pushed into a scan.  These tables turn it into one that can:

* *Codes*: a row (kind, code, ocid) for every distinct code of a release, range-partitioned and sorted by code.  A
  prefix is then ``startswith`` on a sorted scalar column: Parquet's statistics skip all other row groups, and the hits are a
  semi join.
* *Buyer names*: a row (gram, name) for every trigram of every distinct lower-cased name, sorted by gram, and a row (name, ocid) sorted
  by name.  The names that hold all trigrams of a pattern are few; they are verified with ``contains`` and
  lead to the releases.  Patterns under three characters scan the distinct names, never the releases.

Sizes: one row a distinct code and release, one a trigram and distinct name.  No list is collected: a hot code or buyer
is many rows, spread over files by the range partitioning (its ocid is part of the sort key).
Nulls are left out: a null code or name matches nothing.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.joins import reduce_to_keys
from tenderlake.session import write_once

GRAM = 3
# filter field -> (kind of its postings, the metadata column they come from)
CODE_FIELDS = {"cpv_prefix": ("cpv", "release_cpv_codes"), "location_nuts": ("location", "location_nuts"), "nuts_code": ("party", "party_nuts")}


@dataclasses.dataclass
class Postings:
    codes: DataFrame             # kind, code, ocid
    grams: DataFrame             # gram, name
    names: DataFrame             # name, ocid


def _coded(kind: str, col: str) -> Column:
    """The distinct codes of an array column, as (kind, code)."""
    found = F.transform(F.array_distinct(col), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code")))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,code:string>>"))


def write_postings(meta: DataFrame, path: str) -> None:
    """Write the posting tables of release metadata under ``path``.

    The metadata is planned once: the columns needed are written first, and one pass over them gives the codes of every kind."""
    meta = write_once(meta.select("ocid", "buyer_name", *[col for _, col in CODE_FIELDS.values()]), "posting-input")
    every = F.concat(*[_coded(kind, col) for kind, col in CODE_FIELDS.values()])
    codes = meta.select("ocid", F.explode(every).alias("_c")).select("_c.kind", "_c.code", "ocid").filter(F.col("code").isNotNull()).distinct()
    (codes.repartitionByRange("kind", "code", "ocid").sortWithinPartitions("kind", "code", "ocid").write.parquet(f"{path}/codes"))
    names = meta.filter(F.col("buyer_name").isNotNull()).select(F.lower("buyer_name").alias("name"), "ocid").distinct()
    names.repartitionByRange("name", "ocid").sortWithinPartitions("name", "ocid").write.parquet(f"{path}/names")
    stored = meta.sparkSession.read.parquet(f"{path}/names")
    at = F.explode(F.sequence(F.lit(1), F.char_length("name") - (GRAM - 1)))
    grams = (stored.select("name").distinct().filter(F.char_length("name") >= GRAM).select("name", at.alias("_at"))
             .select(F.substring(F.col("name"), F.col("_at"), F.lit(GRAM)).alias("gram"), "name").distinct())
    grams.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.parquet(f"{path}/grams")


def read_postings(spark, path: str) -> Postings:
    return Postings(*[spark.read.parquet(f"{path}/{t}") for t in ("codes", "grams", "names")])


def ocids_with_prefix(postings: Postings, kind: str, prefix: str) -> DataFrame:
    """Distinct ``ocid`` with a code of this kind that starts with ``prefix``."""
    hit = postings.codes.filter((F.col("kind") == kind) & F.col("code").startswith(prefix))
    return hit.select("ocid").distinct()


def names_containing(postings: Postings, pattern: str) -> DataFrame:
    """Distinct lower-cased names that contain ``pattern`` (any case)."""
    low = pattern.lower()
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return postings.names.select("name").distinct().filter(F.col("name").contains(low))
    held = postings.grams.filter(F.col("gram").isin(grams)).groupBy("name").agg(F.count("*").alias("_n"))
    return held.filter((F.col("_n") == len(grams)) & F.col("name").contains(low)).select("name")


def ocids_of_buyers(postings: Postings, pattern: str) -> DataFrame:
    """Distinct ``ocid`` whose buyer's name contains ``pattern``."""
    return reduce_to_keys(postings.names, names_containing(postings, pattern), "name").select("ocid").distinct()


def filter_with_postings(meta: DataFrame, postings: Postings, filters: FilterSpec) -> DataFrame:
    """``filtered_releases`` by posting tables: the metadata is read for the hits only.

    Every code prefix and the buyer's name become key sets; the smallest columns are joined first, then what remains of the
    filters runs on the releases left."""
    keys = [ocids_with_prefix(postings, kind, getattr(filters, field)) for field, (kind, _) in CODE_FIELDS.items() if getattr(filters, field) is not None]
    if filters.buyer_name is not None:
        keys.append(ocids_of_buyers(postings, filters.buyer_name))
    rest = dataclasses.replace(filters, buyer_name=None, **dict.fromkeys(CODE_FIELDS))
    if not keys:
        return meta.filter(rest.column(cpv_col="release_cpv_codes"))
    both = keys[0]
    for more in keys[1:]:
        both = both.join(more, "ocid", "left_semi")
    return meta.join(write_once(both, "posting-keys"), "ocid", "left_semi").filter(rest.column(cpv_col="release_cpv_codes"))
