"""Exact cosine top-k of many query vectors against a large corpus.

One plan for every size:

* The query vectors (distinct by id) are written once.  One scan of the corpus serves at most ``BLOCK_BYTES`` of them and
  at most ``STATE_ROWS // k``; they are broadcast cut into blocks of at most ``block_bytes``.
* ``corpus.mapInArrow`` multiplies slices of each Arrow batch by one block after the other (``SIM_BLOCK_ELEMENTS``
  similarities at a time) and keeps a running top-k per query in Arrow columns.  Only the corpus id, short keys and the
  vector enter that scan.  Small blocks cost further products, not further scans.
* A task emits at most ``k`` rows a query.  They are merged in two levels, first within one of
  ``MERGE_SALTS`` groups of tasks, then per query, so the merge of one query is spread as well.
* Short columns in ``through`` travel with the scan; columns in ``carry`` (texts, metadata) are joined to
  the final hits by id.

Neither a (query, corpus) pair nor the corpus is ever a row of a shuffle, and memory per task is bounded by
``BLOCK_BYTES``, ``STATE_ROWS`` and ``SIM_BLOCK_ELEMENTS``, whatever the number of queries or the size of the corpus.
With ``distinct_by`` the operator returns the top-k *distinct* keys (best row per key), which is exact because every
partial list is itself a top-k of distinct keys.

Scores are cosine similarities rounded to ``score_digits`` decimals; ties are
broken by the corpus id (ascending), everywhere the same way.  Repeated query ids count once.
"""

from __future__ import annotations

import dataclasses
import math
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenderlake.session import write_once

BLOCK_BYTES = 64 * 1024 * 1024      # of the query matrices (float64) of one scan
STATE_ROWS = 1 << 19                # k x queries of one scan: the rows a task may keep
BATCH_ROWS = 4096                   # corpus rows compared at a time
MERGE_SALTS = 32                    # groups of corpus tasks in the first level of the merge


class VectorWidthError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class PairFilter:
    """An exact per-(query, corpus row) admission rule, evaluated per Arrow batch.

    ``fn(query_info, batch)`` gets the listed query columns of one block (Python lists, one
    entry per query) and a corpus batch that holds ``corpus_cols``; it returns a
    boolean matrix (rows x queries).  Rejected pairs never compete for the top-k."""
    query_cols: tuple[str, ...]
    corpus_cols: tuple[str, ...]
    fn: Callable[[dict, pa.RecordBatch], np.ndarray]


_REJECTED = np.iinfo(np.int64).min // 4
_NO_FLOOR = np.iinfo(np.int64).min


def _matrix(list_array: pa.Array, dim: int | None) -> tuple[np.ndarray, int]:
    """Arrow list<float> column -> (rows x dim) float64 matrix, width checked."""
    if isinstance(list_array, pa.ChunkedArray):
        list_array = list_array.combine_chunks()
    n = len(list_array)
    if n == 0:
        return np.zeros((0, dim or 0)), dim or 0
    lengths = pc.list_value_length(list_array).to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if dim is None else dim
    if not np.all(lengths == width):
        raise VectorWidthError(f"vectors of different widths; expected {width}, saw {sorted(set(lengths.tolist()))[:5]}")
    flat = pc.list_flatten(list_array).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, width), width


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


SIM_BLOCK_ELEMENTS = 1 << 20   # cap on rows x queries of one similarity block (8 MiB of float64)


def _ranks(column: pa.Array, tiebreaker: str) -> np.ndarray:
    """Ranks from 0 in byte order, computed in Arrow (no Python objects)."""
    return pc.rank(column, sort_keys="ascending", tiebreaker=tiebreaker).to_numpy(zero_copy_only=False).astype(np.int64) - 1


class _Slice:
    """Corpus rows compared at a time: unit vectors, rank by id, and rows by key (``key_col``)."""

    def __init__(self, batch: pa.RecordBatch, dim: int | None, id_col: str, vec_col: str, key_col: str | None):
        self.cmat = _unit_rows(_matrix(batch.column(vec_col), dim)[0])
        n = len(self.cmat)
        self.id_rank = _ranks(batch.column(id_col), "first")
        self.by_rank = np.empty(n, dtype=np.int64)
        self.by_rank[self.id_rank] = np.arange(n)
        self.order = None
        if key_col is not None:
            codes = _ranks(batch.column(key_col), "dense")
            self.order = np.lexsort((self.id_rank, codes))
            sk = codes[self.order]
            self.starts = np.flatnonzero(np.r_[True, sk[1:] != sk[:-1]])


def _local_topk(qmat: np.ndarray, rows: _Slice, k: int, scale: float, floor: np.ndarray,
                mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one slice that may be among the top-k, per query.

    Returns (query_index, row_index, score_int) arrays.  Ordering is by
    (score desc, id asc); with keys only the best row per key competes.
    ``floor``: each query's k-th score known so far; rows below it are left out.  Once every query has one, the few
    rows that reach it are taken as they are, else the best k of the slice.
    The query side is processed in blocks so that one similarity block never
    exceeds ``SIM_BLOCK_ELEMENTS`` entries, whatever the number of queries.
    """
    n = len(rows.cmat)
    big = n + 1
    step = max(1, SIM_BLOCK_ELEMENTS // max(n, 1))
    rounded = lambda x: (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)  # noqa: E731  half away from zero, like SQL round
    out_q, out_r, out_s = [], [], []
    for q0 in range(0, qmat.shape[0], step):
        least = floor[q0:q0 + step]
        x = qmat[q0:q0 + step] @ rows.cmat.T                    # qb x n
        x *= scale
        if (least != _NO_FLOOR).all():
            q_idx, r_idx = np.nonzero(x >= (least - 0.5 - 1e-6)[:, None])     # a little more than what rounds to the floor
            if len(q_idx) <= 2 * k * len(least):
                s_int = rounded(x[q_idx, r_idx])
                able = s_int >= least[q_idx]
                if mask is not None:
                    able &= mask[r_idx, q0 + q_idx]
                out_q.append(q_idx[able] + q0)
                out_r.append(r_idx[able])
                out_s.append(s_int[able])
                continue
        comp = rounded(x)
        comp *= big
        comp -= rows.id_rank[None, :]                           # unique per row, larger = better
        if mask is not None:
            comp[~mask[:, q0:q0 + step].T] = _REJECTED
        if rows.order is not None:
            comp = np.maximum.reduceat(comp[:, rows.order], rows.starts, axis=1)   # qb x n_keys
        if comp.shape[1] > k:
            comp = np.partition(comp, comp.shape[1] - k, axis=1)[:, -k:]
        flat = comp.ravel()
        q_idx = np.repeat(np.arange(len(comp)), comp.shape[1])
        s_int = -((-flat) // big)                               # ceil division
        able = (flat != _REJECTED) & (s_int >= least[q_idx])
        flat, q_idx, s_int = flat[able], q_idx[able], s_int[able]
        out_q.append(q_idx + q0)
        out_r.append(rows.by_rank[s_int * big - flat])
        out_s.append(s_int)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


class _Running:
    """The best ``k`` rows (of distinct keys) per query of a task, in Arrow columns.

    Rows wait until they are as many as may be kept, so the merge cost stays linear and memory is that of
    twice ``k x queries`` rows and one slice's."""

    def __init__(self, n_queries: int, k: int, id_col: str, key_col: str | None, floor: np.ndarray | None = None):
        self.k, self.id_col, self.key_col = k, id_col, key_col
        self.floor = np.full(n_queries, _NO_FLOOR) if floor is None else floor.copy()      # the k-th score known so far; rows below cannot enter
        self.limit = max(k * n_queries, 256)
        self.tables: list[pa.Table] = []
        self.waiting = 0

    def add(self, q: np.ndarray, s: np.ndarray, rows: pa.RecordBatch) -> None:
        if not len(q):
            return
        self.tables.append(pa.Table.from_batches([rows]).append_column("__q", pa.array(q, pa.int64())).append_column("__s", pa.array(s, pa.int64())))
        self.waiting += len(q)
        if self.waiting >= self.limit:
            self._merge()

    def _merge(self) -> None:
        t = pa.concat_tables(self.tables).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("__q", "ascending"), ("__s", "descending"), (self.id_col, "ascending")]))
        q = t.column("__q").to_numpy()
        keep = np.arange(len(q))
        if self.key_col is not None:
            codes = _ranks(t.column(self.key_col).combine_chunks(), "dense")
            keep = np.sort(np.unique(q * (codes.max() + 1) + codes, return_index=True)[1])
        at = q[keep]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        last = keep[place == self.k - 1]
        s = t.column("__s").to_numpy()
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.tables, self.waiting = [t.take(pa.array(keep[place < self.k])).combine_chunks()], 0

    def batches(self, qids: pa.Array, query_id: str, score_col: str, scale: float, salt: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.tables:
            return
        self._merge()
        for part in self.tables[0].to_batches(max_chunksize=10_000):
            columns = {c: part.column(c) for c in part.schema.names}
            columns[query_id] = qids.take(part.column("__q"))
            columns[score_col] = pa.array(part.column("__s").to_numpy() / scale)
            columns["__salt"] = pa.array(np.full(part.num_rows, salt, np.int32))
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _partition_topk(batches: Iterable[pa.RecordBatch], blocks: Sequence[tuple[np.ndarray, dict]], qids: pa.Array, k: int,
                    scale: float, id_col: str, vec_col: str, key_col: str | None,
                    out_cols: Sequence[str], qid_col: str, score_col: str, arrow_schema: pa.Schema, salt: int,
                    pair_filter: PairFilter | None = None) -> Iterator[pa.RecordBatch]:
    """Running top-k per query over all batches of one task, block by block of queries."""
    running = _Running(len(qids), k, id_col, key_col)
    starts = np.cumsum([0, *[len(m) for m, _ in blocks]])
    for whole in batches:
        for at in range(0, whole.num_rows if len(qids) else 0, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            valid = pc.is_valid(batch.column(vec_col))
            if not pc.all(valid).as_py():
                batch = batch.filter(valid)
                if batch.num_rows == 0:
                    continue
            rows = _Slice(batch, blocks[0][0].shape[1], id_col, vec_col, key_col)
            found = []
            for (qmat, qinfo), start in zip(blocks, starts):
                mask = pair_filter.fn(qinfo, batch) if pair_filter is not None else None
                q_idx, r_idx, s_int = _local_topk(qmat, rows, k, scale, running.floor[start:start + len(qmat)], mask)
                if len(q_idx):
                    found.append((q_idx + start, r_idx, s_int))
            if found:
                q_idx, r_idx, s_int = (np.concatenate(x) for x in zip(*found))
                running.add(q_idx, s_int, batch.select(list(out_cols)).take(pa.array(r_idx)))
    yield from running.batches(qids, qid_col, score_col, scale, salt, arrow_schema)


def _best(cand: DataFrame, k: int, groups: list[str], id_col: str, key_col: str | None, score_col: str,
          rank_col: str) -> DataFrame:
    """The first ``k`` rows (of distinct keys) within ``groups``."""
    order = [F.col(score_col).desc(), F.col(id_col).asc()]
    if key_col is not None:
        w_key = Window.partitionBy(*groups, key_col).orderBy(*order)
        cand = cand.withColumn("__kr", F.row_number().over(w_key)).filter("__kr = 1").drop("__kr")
    w = Window.partitionBy(*groups).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w).cast("long")).filter(F.col(rank_col) <= k)


def top_k_similar(queries: DataFrame, corpus: DataFrame, k: int = 10, *,
                  query_id: str = "query_id", query_vec: str = "embedding",
                  corpus_id: str = "doc_id", corpus_vec: str = "embedding",
                  distinct_by: str | None = None, through: Sequence[str] = (), carry: Sequence[str] = (),
                  score_digits: int = 6, block_bytes: int = BLOCK_BYTES,
                  score_col: str = "score", rank_col: str = "rank",
                  pair_filter: PairFilter | None = None) -> DataFrame:
    """Per query, the ``k`` most cosine-similar corpus rows (or distinct ``distinct_by`` keys).

    Output: ``query_id, rank, corpus_id, [distinct_by], through..., carry..., score``.
    Query rows with a NULL vector and corpus rows with a NULL vector are ignored.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    q_extra = list(pair_filter.query_cols) if pair_filter is not None else []
    q = (queries.select(F.col(query_id), F.col(query_vec), *q_extra).filter(F.col(query_vec).isNotNull())
         .dropDuplicates([query_id]))
    q = write_once(q, "queries")
    n_q, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(query_vec)), F.lit(0))).first()
    scan_rows = max(1, min(max(block_bytes, BLOCK_BYTES) // (8 * max(dim, 1)), STATE_ROWS // k))
    block_rows = max(1, min(block_bytes // (8 * max(dim, 1)), SIM_BLOCK_ELEMENTS // BATCH_ROWS))
    n_scans = max(1, math.ceil(n_q / scan_rows))
    narrow = list(dict.fromkeys([corpus_id, *([distinct_by] if distinct_by else []), *through]))
    rest = [c for c in carry if c not in narrow]
    fields = {f.name: f for f in corpus.schema.fields}
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType),
                           *[T.StructField(c, fields[c].dataType) for c in narrow],
                           T.StructField(score_col, T.DoubleType()), T.StructField("__salt", T.IntegerType())])
    c_extra = [c for c in (pair_filter.corpus_cols if pair_filter is not None else ()) if c not in narrow]
    scan = corpus.select(*narrow, *c_extra, corpus_vec)

    def scan_hits(some: DataFrame):
        cand, bc = _candidates(some, block_rows, scan, k, float(10 ** score_digits), query_id, query_vec, corpus_id, corpus_vec,
                               distinct_by, narrow, score_col, schema, q_extra, pair_filter)
        part = _best(cand, k, [query_id, "__salt"], corpus_id, distinct_by, score_col, rank_col).drop(rank_col, "__salt")
        return _best(part, k, [query_id], corpus_id, distinct_by, score_col, rank_col), bc

    if n_q == 0:
        hits = spark.createDataFrame([], schema).drop("__salt").withColumn(rank_col, F.lit(None).cast("long"))
    elif n_scans == 1:
        hits, _ = scan_hits(q)
    else:
        hits = None                                     # one scan at a time; its hits are written, its matrices dropped
        for b in range(n_scans):
            part, bc = scan_hits(q.filter(F.pmod(F.xxhash64(query_id), F.lit(n_scans)) == b))
            part = write_once(part, "block-hits")
            bc.unpersist()
            hits = part if hits is None else hits.unionByName(part)
    if rest:
        hits = write_once(hits, "hits")                 # read for its size by the planner, then joined
        hits = hits.join(corpus.select(corpus_id, *rest), corpus_id)
    return hits.select(query_id, rank_col, *narrow, *rest, score_col)


def _candidates(some: DataFrame, block_rows: int, scan: DataFrame, k: int, scale: float, query_id: str, query_vec: str, corpus_id: str,
                corpus_vec: str, key_col: str | None, out_cols: list[str], score_col: str, schema: T.StructType,
                q_extra: list[str], pair_filter: PairFilter | None):
    """Partial top-k lists of the queries of one scan, and their broadcast blocks."""
    tbl = some.toArrow().combine_chunks()
    blocks = []
    for at in range(0, tbl.num_rows, block_rows):
        part = tbl.slice(at, block_rows)
        blocks.append((_unit_rows(_matrix(part.column(query_vec), blocks[0][0].shape[1] if blocks else None)[0]),
                       {c: part.column(c).to_pylist() for c in q_extra}))
    qids = pa.concat_arrays(tbl.column(query_id).chunks) if tbl.num_rows else pa.array([], to_arrow_schema(schema).field(query_id).type)
    bc = some.sparkSession.sparkContext.broadcast((blocks, qids))
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext
        found, ids = bc.value
        yield from _partition_topk(batches, found, ids, k, scale, corpus_id, corpus_vec, key_col, out_cols, query_id, score_col,
                                   arrow_schema, TaskContext.get().partitionId() % MERGE_SALTS, pair_filter)

    return scan.mapInArrow(run, schema), bc
