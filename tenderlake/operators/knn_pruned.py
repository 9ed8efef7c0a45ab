"""Exact cosine top-k that skips groups of vectors by a bound.

``build_cells`` gives every corpus vector to its nearest *pivot* (a bounded number of corpus vectors, those with the
smallest id hashes) and writes the corpus partitioned by that cell, with each cell's *radius*, the largest
angle between its pivot and a member.  For a query q the triangle inequality on angles bounds every member c:

    cos(q, c) <= cos(max(0, angle(q, pivot) - radius))

``pruned_top_k`` works in two waves.  The first scans, for each query, its nearest cells until they hold k rows, and takes the
k-th best score as the query's threshold.  The second scans only the cells whose bound reaches
the threshold; folders that no query needs are pruned from the scan, a batch is multiplied only by the queries
that need its cell, and a task emits only rows that reach the threshold.  The result equals ``top_k_similar``'s, row by row;
bounds are compared with a margin above the rounding of scores, and there is no hashing and no candidate cap.

Sizes: pivots and radii are bounded by ``n_cells``; queries are cut into broadcast blocks of ``block_bytes``; partial
lists merge in two levels.  A crowded cell is written in several files, so it is scanned by several tasks.

Cases: null vectors are left out on both sides; corpus vectors of length zero lie in a cell of their own with an
unbounded radius (their score is 0 with every query); a query with fewer than k rows scans every cell.
"""

from __future__ import annotations

import dataclasses
import math
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenderlake.operators.knn import BATCH_ROWS, BLOCK_BYTES, MERGE_SALTS, STATE_ROWS, _best, _local_topk, _matrix, _Running, _Slice, _unit_rows
from tenderlake.session import write_once

CELL = "knn_cell"
N_CELLS = 256


@dataclasses.dataclass
class Cells:
    """A corpus in cells: the written table, and for each cell its pivot, radius (radians) and number of rows."""

    table: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    corpus_id: str
    corpus_vec: str


@dataclasses.dataclass
class Visits:
    """What a search looked at: (query, cell) pairs and (query, row) comparisons, of all."""

    cells: int = 0
    pairs: int = 0
    pairs_visited: int = 0
    comparisons: int = 0
    comparisons_made: int = 0

    def add(self, visit: np.ndarray, rows: np.ndarray) -> None:
        self.cells = len(rows)
        self.pairs += visit.size
        self.pairs_visited += int(visit.sum())
        self.comparisons += visit.shape[0] * int(rows.sum())
        self.comparisons_made += int((visit * rows[None, :]).sum())


def build_cells(corpus: DataFrame, path: str, n_cells: int = N_CELLS, corpus_id: str = "doc_id", corpus_vec: str = "embedding",
                through: Sequence[str] = ()) -> Cells:
    """Write ``corpus`` by cell under ``path``; columns ``through`` travel with the id and the vector."""
    spark = corpus.sparkSession
    kept = corpus.select(corpus_id, corpus_vec, *[c for c in through if c not in (corpus_id, corpus_vec)]).filter(F.col(corpus_vec).isNotNull())
    some = kept.select(corpus_vec).orderBy(F.xxhash64(corpus_id), corpus_id).limit(n_cells).toArrow()      # n_cells rows
    pivots = _unit_rows(_matrix(some.column(corpus_vec), None)[0]) if some.num_rows else np.zeros((0, 0))
    pivots = np.unique(pivots[np.abs(pivots).sum(axis=1) > 0], axis=0) if pivots.size else pivots
    shared = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([*kept.schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField("__angle", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _unit_rows(_matrix(batch.column(corpus_vec), piv.shape[1] if piv.size else None)[0])
            zero = ~np.abs(m).sum(axis=1).astype(bool)
            dots = m @ piv.T if piv.size else np.zeros((len(m), 1))
            cell = np.where(zero, len(piv), dots.argmax(axis=1))
            angle = np.where(zero, np.pi, np.arccos(np.clip(dots.max(axis=1), -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], schema=arrow)

    assigned = kept.mapInArrow(assign, schema).repartitionByRange(CELL, F.xxhash64(corpus_id))
    assigned.write.partitionBy(CELL).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    stats = table.groupBy(CELL).agg(F.max("__angle").alias("r"), F.count("*").alias("n")).collect()        # a row a cell
    radius, rows = np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1, np.int64)
    for s in stats:
        radius[s[CELL]], rows[s[CELL]] = s["r"], s["n"]
    return Cells(table.drop("__angle"), pivots, radius, rows, corpus_id, corpus_vec)


def bounds(cells: Cells, queries: np.ndarray) -> np.ndarray:
    """The highest cosine that a row of each cell can have with each unit query."""
    out = np.full((len(queries), len(cells.rows)), 1.0)
    if len(cells.pivots):
        angle = np.arccos(np.clip(queries @ cells.pivots.T, -1, 1))
        out[:, :-1] = np.cos(np.clip(angle - cells.radius[None, :-1], 0, np.pi))
    return np.where(cells.rows[None, :] > 0, out, -2.0)         # an empty cell reaches no threshold


def _first_visits(cells: Cells, bound: np.ndarray, k: int) -> np.ndarray:
    """For each query the cells with the highest bounds until they hold ``k`` rows."""
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
    visit = np.zeros(bound.shape, bool)
    np.put_along_axis(visit, order, before < k, axis=1)
    return visit & (cells.rows[None, :] > 0)


def _scan(cells: Cells, qmat: np.ndarray, qids: pa.Array, visit: np.ndarray, floor: np.ndarray | None, k: int, scale: float, distinct_by: str | None,
          out_cols: list[str], query_id: str, score_col: str, schema: T.StructType) -> DataFrame:
    """Partial top-k lists from the cells that some query visits."""
    spark = cells.table.sparkSession
    need = np.flatnonzero(visit.any(axis=0)).tolist()
    shared = spark.sparkContext.broadcast((qmat, qids, visit, floor))
    arrow = to_arrow_schema(schema)
    corpus_id, corpus_vec = cells.corpus_id, cells.corpus_vec

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        qm, qi, vis, low = shared.value
        salt = TaskContext.get().partitionId() % MERGE_SALTS
        running = _Running(len(qi), k, corpus_id, distinct_by, low)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                for cell in np.unique(batch.column(CELL).to_numpy()).tolist():
                    part = batch.filter(pc.equal(batch.column(CELL), cell))
                    who = np.flatnonzero(vis[:, cell])
                    if not len(who):
                        continue
                    rows = _Slice(part, qm.shape[1], corpus_id, corpus_vec, distinct_by)
                    q, r, s = _local_topk(qm[who], rows, k, scale, running.floor[who])       # no row below the k-th score known so far
                    running.add(who[q], s, part.select(out_cols).take(pa.array(r)))
        yield from running.batches(qi, query_id, score_col, scale, salt, arrow)

    columns = list(dict.fromkeys([*out_cols, corpus_vec, CELL]))
    return cells.table.filter(F.col(CELL).isin(need) if need else F.lit(False)).select(*columns).mapInArrow(run, schema)


def pruned_top_k(queries: DataFrame, cells: Cells, k: int = 10, *, query_id: str = "query_id", query_vec: str = "embedding", distinct_by: str | None = None,
                 through: Sequence[str] = (), score_digits: int = 6, block_bytes: int = BLOCK_BYTES, score_col: str = "score",
                 rank_col: str = "rank") -> tuple[DataFrame, Visits]:
    """``top_k_similar`` over cells: ``query_id, rank, corpus_id, [distinct_by], through..., score``, and what was visited."""
    if k <= 0:
        raise ValueError("k must be positive")
    scale, margin = float(10 ** score_digits), 10.0 ** -score_digits
    q = write_once(queries.select(query_id, query_vec).filter(F.col(query_vec).isNotNull()).dropDuplicates([query_id]), "queries")
    n_q, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(query_vec)), F.lit(0))).first()
    n_blocks = max(1, math.ceil(n_q / max(1, min(block_bytes // (8 * max(dim, 1, len(cells.rows))), STATE_ROWS // k))))
    out_cols = list(dict.fromkeys([cells.corpus_id, *([distinct_by] if distinct_by else []), *through]))
    fields = {f.name: f for f in cells.table.schema.fields}
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), *[T.StructField(c, fields[c].dataType) for c in out_cols],
                           T.StructField(score_col, T.DoubleType()), T.StructField("__salt", T.IntegerType())])
    visits, hits = Visits(cells=len(cells.rows)), None

    def merged(parts: DataFrame) -> DataFrame:
        first = _best(parts, k, [query_id, "__salt"], cells.corpus_id, distinct_by, score_col, rank_col).drop(rank_col, "__salt")
        return _best(first, k, [query_id], cells.corpus_id, distinct_by, score_col, rank_col)

    for b in range(n_blocks if n_q else 0):
        block = q if n_blocks == 1 else q.filter(F.pmod(F.xxhash64(query_id), F.lit(n_blocks)) == b)
        rows = block.toArrow()                                  # one block, at most ``block_bytes``
        if not rows.num_rows:
            continue
        qmat = _unit_rows(_matrix(rows.column(query_vec), None)[0])
        qids = pa.concat_arrays(rows.column(query_id).chunks)
        bound = bounds(cells, qmat)
        first = _first_visits(cells, bound, k)
        scan = lambda visit, floor: _scan(cells, qmat, qids, visit, floor, k, scale, distinct_by, out_cols, query_id, score_col, schema)
        wave = write_once(merged(scan(first, None)).withColumn("__salt", F.lit(0)), "wave")
        kth = wave.filter(F.col(rank_col) == k).select(query_id, score_col).toArrow()                   # at most a row a query
        at = {i: n for n, i in enumerate(qids.to_pylist())}
        floor = np.full(len(qids), -2.0)
        floor[[at[i] for i in kth.column(query_id).to_pylist()]] = kth.column(score_col).to_numpy()
        second = (bound + margin >= floor[:, None]) & ~first & (cells.rows[None, :] > 0)
        least = np.floor(floor * scale + 0.5).astype(np.int64)
        more = scan(second, least) if second.any() else None
        visits.add(first | second, cells.rows)
        both = wave.drop(rank_col) if more is None else wave.drop(rank_col).unionByName(more)
        part = merged(both)
        if n_blocks > 1:
            part = write_once(part, "block-hits")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = queries.sparkSession.createDataFrame([], schema).drop("__salt").withColumn(rank_col, F.lit(None).cast("long"))
    return hits.select(query_id, rank_col, *out_cols, score_col), visits
