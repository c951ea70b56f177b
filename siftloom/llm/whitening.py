"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

A vector's entries c become integers floor(64 c) (the contract's offset of 1,000,000 is a
shift that no covariance sees).  Spark sums products exactly, so n**2 times the covariance
is an integer matrix.  Its characteristic polynomial is found modulo many primes, one
Hessenberg reduction per task, and put together by Chinese remaindering.  Each component
is a task of its own: exact root counts isolate its eigenvalue to far more digits than a
double holds, and null-space inverse iteration in long fixed point gives its vector.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped, as
are those of another length than the commonest (of equally common ones the longest);
repeated rows count each time; null ids stay; components without variance are left out, so
a table of equal vectors, or of none, gives no rows; equal eigenvalues take an orthonormal
basis of their space; a ``deviation`` beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm import exactpoly
from siftloom.llm.registry import query, table
from siftloom.session import cut_lineage

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Sizes below which sums of products of ``STEP`` rows are exact in doubles.
SMALL, STEP = 1 << 20, 4096
LIMB = 32


@dataclass
class Whitening:
    """What whitening takes from the fit list."""

    n: int
    sums: list[int]  # of floor(64 c) per dimension
    values: list[float]  # eigenvalues of n**2 times the covariance
    explained: list[float]
    vectors: list[list[float]]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): finite vectors of the commonest length, as doubles."""
    vec = F.col(vector).cast("array<double>")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.select(F.col(key).alias("id"), vec.alias("vec")).where(F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (common.d if common else 0))


def _integers(column: pa.Array) -> np.ndarray:
    """floor(64 c) of the entries, a row per vector: doubles while small, else Python integers."""
    flat = column.flatten().to_numpy()
    width = len(flat) // max(1, len(column))
    if not len(flat) or np.abs(flat).max() < SMALL / SCALE:
        y = np.floor(flat * SCALE)
    else:
        # a double of 2**53 or more is an integer
        y = np.array([int(c) * SCALE if abs(c) >= 2**53 else int(np.floor(c * SCALE)) for c in flat.tolist()], dtype=object)
    return y.reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def scatter(rows: DataFrame) -> np.ndarray:
    """Exact sums of products of the entries, with a last entry 1: the corner is n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            y = _integers(batch.column("vec"))
            y = np.hstack([y, np.ones((len(y), 1), y.dtype)])
            part = y.T @ y
            part = (part.astype(np.int64) if part.dtype != object else part).astype(object)
            total = part if total is None else total + part
        if total is None:
            return
        out = []
        for i in range(len(total)):
            for j in range(i + 1):
                value, at = int(total[i, j]), 0
                sign, value = (-1, -value) if value < 0 else (1, value)
                while value:
                    out.append((i, j, at, sign * (value & ((1 << LIMB) - 1))))
                    value, at = value >> LIMB, at + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "value"])

    # at most limbs x (d + 1)**2 / 2 numbers, whatever the number of rows
    cells = rows.select("vec").mapInArrow(run, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    found = cells.collect()
    size = max((r.i for r in found), default=-1) + 1
    out = np.zeros((size, size), dtype=object)
    for r in found:
        out[r.i, r.j] += r.value << (LIMB * r.limb)
    return out + np.tril(out, -1).T


def characteristic(rows: DataFrame, matrix: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, constant first; a task per prime."""
    spark = rows.sparkSession
    bound, product, chosen = 2 * exactpoly.coefficient_bound(sum(matrix[i][i] for i in range(len(matrix))), len(matrix)) + 1, 1, []
    for p in exactpoly.primes():
        if product > bound:
            break
        chosen.append(p)
        product *= p
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_pydict({"p": pa.array(mine, pa.int64()), "c": pa.array(
                [exactpoly.characteristic_mod(sent.value, p) for p in mine], pa.list_(pa.int64()))})

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism * 4)
    residues = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    return exactpoly.remaindered([(r.p, r.c) for r in residues])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the usable rows (id, vec) by falling variance; None without variance."""
    sums = scatter(rows)
    if not len(sums):
        return None
    n, total = int(sums[-1, -1]), [int(v) for v in sums[-1, :-1]]
    matrix = [[n * int(sums[i, j]) - total[i] * total[j] for j in range(len(total))] for i in range(len(total))]
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    poly = characteristic(rows, matrix)
    while poly[0] == 0:
        poly.pop(0)
    count = min(components, len(poly) - 1)
    if count == 0:
        return None
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((matrix, poly, trace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, poly, trace = sent.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                lo, hi, scale, place, group = exactpoly.root(poly, k, trace)
                # doubles come from ratios of integers, so their size does not matter
                vector = exactpoly.null_vectors(matrix, lo, hi, scale, group)[place - 1]
                root_of = isqrt((lo + hi) << (127 + scale))  # 2**(64 + scale) times the square root
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([k]), "root": pa.array([root_of / (1 << (64 + scale))]), "explained": pa.array([(lo + hi) / (trace << (scale + 1))]),
                    "vector": pa.array([vector], pa.list_(pa.float64()))})

    found = spark.range(1, count + 1, 1, count).mapInArrow(run, "k long, root double, explained double, vector array<double>").collect()
    found.sort(key=lambda r: r.k)
    return Whitening(n, total, [r.root for r in found], [r.explained for r in found], [r.vector for r in found])


def _whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of the usable rows."""
    n, sums, values, vectors = model.n, model.sums, model.values, model.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = np.array(vectors).T / np.array(values)
        widest = max(map(abs, sums))
        for batch in _slices(batches):
            y = _integers(batch.column("vec"))
            if y.dtype != object and n * SMALL + widest < 2**53 and (n * SMALL + widest) ** 2 * y.shape[1] < 2**63:
                away = y.astype(np.int64) * n - np.array(sums, np.int64)
                deviation = (away * away).sum(axis=1)
            else:
                away = (y.astype(np.int64) if y.dtype != object else y).astype(object) * n - np.array(sums, dtype=object)
                deviation = [v if v < 2**63 else None for v in (int(x) for x in (away * away).sum(axis=1))]
            w = away.astype(np.float64) @ project
            ends = (np.arange(len(w) + 1) * w.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "deviation": pa.array(deviation, pa.int64()),
                                              "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(w.reshape(-1)))})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity, measured on all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in _slices(batches):
            w = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, -1)
            w = np.hstack([w, np.ones((len(w), 1))])
            total = total + w.T @ w
        if isinstance(total, np.ndarray):
            i, j = (x.astype(np.int32) for x in np.indices(total.shape))
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = whitened.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max(r.i for r in cells) + 1
    total = np.zeros((size, size))
    for r in cells:
        total[r.i, r.j] = r.v
    n = total[-1, -1]
    mean = total[-1, :-1] / n
    return float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(size - 1)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """Per usable row: key, deviation and whitened (one value per component); and the fitted model."""
    used = usable(rows, key, vector)
    model = fit(used, components)
    if model is None:
        kind = used.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, deviation long, whitened array<double>"), None
    return cut_lineage(_whitened(used, model)).withColumnRenamed("id", key), model


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    shares, error = (model.explained, identity_error(rows)) if model else ([], 0.0)
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
