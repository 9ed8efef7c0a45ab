"""Text quality by Naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: of bytes (1 to 3, case kept) and of word shapes (1 to 4
words; a shape is what kinds of bytes a word holds, its length class, its closing sign and whether
it repeats the word before).  Each indicator is scaled by its class log-count ratio r = log((p / |p|) / (q / |q|)), p and q the smoothed document counts of
the two classes; a document's scaled vector is divided by its damped length.  A linear hinge-loss model is
fitted on them by dual coordinate descent (box-constrained dual, one closed-form step a row, seeded
order, class weights inverse to class size).  A
logistic curve fitted to the margins turns them into scores with 0.5 at margin 0.

Fitting uses at most ``max_rows`` labelled rows (documented bound; the rows with the smallest MD5 of
their id); those ids are broadcast (bounded by ``max_rows``), the texts are filtered and turned into features where
they lie, and the features of the chosen rows are written; one task then reads only those, so its memory
does not grow with the corpus.  Every document is scored, whole,
in one pass without a shuffle; each task holds the two weight vectors (2**18 numbers each).

Cases: a null or empty text has no n-grams and gets the score of the intercept.  A row with a null id or
null label does not train; an id labelled twice counts once with its larger label.  Without
training rows every score is 0.5; with one class only it is 1.0 or 0.0.  Equal texts get equal
scores.  Columns besides id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import enter, once, stage_table
from tenderlake.llm.textarrays import Words, chunks, split_words, text_bytes

BITS = 18
BYTE_ORDERS = (1, 2, 3)
SHAPE_ORDERS = (1, 2, 3, 4)
DAMP = 50.0                      # added to the squared length, so few n-grams weigh little
MAX_ROWS = 5_000
EPOCHS = 10
COST = 1.0
SMOOTH = 1.0


def held_out(id_col: Column) -> Column:
    """Rows never used for training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _byte_kinds() -> np.ndarray:
    """1 upper, 2 lower, 4 digit, 8 punctuation, 16 beyond ASCII; 0 white space."""
    t = np.full(256, 8, np.uint8)
    t[[0x20, *range(9, 14)]] = 0
    t[65:91], t[97:123], t[48:58], t[128:] = 1, 2, 4, 16
    return t


def _shapes(words: Words) -> np.ndarray:
    """A number for the look of each word: kinds of its bytes, first and last byte, length, repeats the word before."""
    if not len(words.start):
        return np.zeros(0, np.uint32)
    kind = once("byte-kinds", _byte_kinds)[words.buf]
    held = np.bitwise_or.reduceat(kind, words.start).astype(np.uint32)
    last = words.buf[words.end - 1]
    sign = np.where(kind[words.end - 1] == 8, last, 0).astype(np.uint32)
    size = np.minimum(np.log2(words.end - words.start).astype(np.uint32), 5)
    same = np.zeros(len(held), np.uint32)
    same[1:] = words.hash[1:] == words.hash[:-1]
    return held | size << np.uint32(5) | sign << np.uint32(8) | same << np.uint32(15) | kind[words.start].astype(np.uint32) << np.uint32(16)


def _buckets(n: int, kind: int, grams: np.ndarray) -> np.ndarray:
    salt = np.uint32((n * 0x85EBCA6B + kind * 0xC2B2AE35) & 0xFFFFFFFF)
    h = (grams ^ salt) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def features(column: pa.Array) -> list[np.ndarray]:
    """Distinct n-gram buckets of every text."""
    words = split_words(column)
    off = text_bytes(column)[1]
    wide = words.buf.astype(np.uint32)
    grams = []                                                # (n, starts of the texts, bucket at each position)
    for n in BYTE_ORDERS:
        size = max(0, len(wide) - n + 1)
        g = wide[:size].copy()
        for k in range(1, n):
            g |= wide[k:k + size] << np.uint32(8 * k)
        grams.append((n, off.tolist(), _buckets(n, 1, g)))
    shape = _shapes(words)
    for n in SHAPE_ORDERS:
        size = max(0, len(shape) - n + 1)
        g = shape[:size].copy()
        for k in range(1, n):
            g = g * np.uint32(0x01000193) ^ shape[k:k + size]
        grams.append((n, words.first.tolist(), _buckets(n, 2, g)))
    out = []
    for d in range(len(off) - 1):
        some = np.concatenate([g[at[d]:max(at[d], at[d + 1] - n + 1)] for n, at, g in grams])
        some.sort()
        out.append(some[np.append(True, some[1:] != some[:-1])] if len(some) else some)
    return out


def dual_descent(rows: list[np.ndarray], vec: list[np.ndarray], y: np.ndarray, upper: np.ndarray, size: int, epochs: int,
                 seed: int, tolerance: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, constant weight and dual variables of min |w|^2 / 2 + b^2 / 2 + sum of upper * hinge(y (w x + b)).

    One coordinate of the dual at a time is set to its best value within [0, upper], until no step moves by ``tolerance``.
    """
    diag = np.array([(v * v).sum() + 1.0 for v in vec])       # + 1: the constant feature
    alpha = np.zeros(len(y))
    w, b = np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            r, v = rows[i], vec[i]
            grad = y[i] * (float(w[r] @ v) + b) - 1.0
            new = min(max(alpha[i] - grad / diag[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, b, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 1) -> dict:
    """NB-SVM weights from feature lists and 0/1 labels."""
    size = 1 << BITS
    y = np.where(labels > 0, 1.0, -1.0)
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    if not n_pos or not n_neg:
        prior = 0.5 if not len(y) else float(n_pos > 0)
        return {"weight": np.zeros(size, np.float32), "square": np.zeros(size, np.float32), "bias": 0.0, "slope": 0.0,
                "shift": float(np.log((prior + 1e-9) / (1 - prior + 1e-9))) if len(y) else 0.0}
    pos = SMOOTH + np.bincount(np.concatenate([r for r, v in zip(rows, y) if v > 0]), minlength=size)
    neg = SMOOTH + np.bincount(np.concatenate([r for r, v in zip(rows, y) if v < 0]), minlength=size)
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    ratio[(pos == SMOOTH) & (neg == SMOOTH)] = 0.0            # never seen
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    flat = ratio[np.concatenate(rows)].astype(np.float32) if len(rows) else np.zeros(0, np.float32)
    vec = [flat[a:c] for a, c in zip(first, first[1:])]       # views of one array
    for v in vec:
        v /= np.sqrt((v * v).sum() + DAMP)
    upper = np.where(y > 0, cost * len(y) / (2 * n_pos), cost * len(y) / (2 * n_neg))
    w, b, _ = dual_descent(rows, vec, y, upper, size, epochs, seed, 1e-3 * cost)
    margin = np.array([w[r] @ v + b for r, v in zip(rows, vec)])
    slope = 1.0
    for _ in range(25):                                       # one-parameter logistic fit, class-balanced
        p = 1 / (1 + np.exp(-np.clip(slope * margin * y, -30, 30)))
        grad = (upper * (1 - p) * margin * y).sum() - 1e-2 * slope
        hess = (upper * p * (1 - p) * margin * margin).sum() + 1e-2
        slope = float(np.clip(slope + grad / hess, 0.1, 50))
    return {"weight": (w * ratio).astype(np.float32), "square": (ratio * ratio).astype(np.float32), "bias": float(b),
            "slope": slope, "shift": 0.0}


def margins(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(rows))
    weight, square = model["weight"], model["square"]
    for k, r in enumerate(rows):
        out[k] = weight[r].sum(dtype=np.float64) / np.sqrt(square[r].sum(dtype=np.float64) + DAMP) + model["bias"]
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> dict:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    key = F.md5(F.col(id_col).cast("string"))
    marked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")).withColumn("_key", key)
              .orderBy("_key").limit(max_rows).select(F.col(id_col).alias("_id"), "_y", "_key"))
    sample = (docs.select(id_col, text_col).join(F.broadcast(marked), F.col(id_col) == F.col("_id"))
              .select("_key", "_y", text_col))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            for part in chunks(batch, text_col):
                rows = features(part.column(text_col))
                yield pa.record_batch([part.column("_key"), part.column("_y"), pa.array([r.astype(np.uint32).tobytes() for r in rows], pa.binary())],
                                      names=["_key", "_y", "_f"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        table = pa.Table.from_batches(list(batches), pa.schema([("_key", pa.string()), ("_y", pa.int32()), ("_f", pa.binary())]))
        keys, labels_ = table.column("_key").to_pylist(), table.column("_y").to_pylist()
        buf, off = text_bytes(table.column("_f"))             # one buffer for all rows
        order = sorted(range(len(keys)), key=lambda k: (keys[k], labels_[k], buf[off[k]:off[k + 1]].tobytes()))
        model = fit([buf[off[k]:off[k + 1]].view(np.uint32) for k in order], np.array([labels_[k] for k in order], np.int64))
        yield pa.record_batch([pa.array([model["weight"].tobytes()], pa.binary()), pa.array([model["square"].tobytes()], pa.binary()),
                               *[pa.array([model[k]], pa.float64()) for k in ("bias", "slope", "shift")]],
                              names=["weight", "square", "bias", "slope", "shift"])

    chosen = stage_table(sample.mapInArrow(featurise, "_key string, _y int, _f binary"), "quality-sample")
    fitted = chosen.repartition(1).mapInArrow(solve, "weight binary, square binary, bias double, slope double, shift double")
    row = fitted.first()                                      # one row of fixed size
    return {"weight": np.frombuffer(row["weight"], np.float32), "square": np.frombuffer(row["square"], np.float32),
            "bias": row["bias"], "slope": row["slope"], "shift": row["shift"]}


def _scores(model: dict, column: pa.Array) -> np.ndarray:
    got = margins(model, features(column))
    return 1 / (1 + np.exp(-np.clip(model["slope"] * got + model["shift"], -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            for part in chunks(batch, text_col):
                p = _scores(shared.value, part.column(text_col))
                yield pa.record_batch([part.column(id_col), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                                      names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects (all columns unchanged)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            for part in chunks(batch, text_col):
                yield part.filter(pa.array(_scores(shared.value, part.column(text_col)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
