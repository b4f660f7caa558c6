"""Whitening of embeddings by digit-slice products: exact integer covariances out of floating-point matrix products.

Vectors become integers x. Over the distinct ones (the fit list, n of them with
sums S) the centred integers y = n x - S are cut into limbs of ``LIMB`` bits, so
that every float64 product of two limb matrices over ``BLOCK`` rows stays below
2^53 and is exact. A task recombines its limb products to big integers; these
travel as digits of 40 bits, whose sums by Spark are exact for millions of
tasks, and the merged matrix divided by n^3 is the covariance, rounded once.
Only it (dimensions squared, whatever the number of rows) meets on the driver,
where it is decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship_package

#: Entries are scaled, floored and shifted; those beyond MOST, which no long holds safely, count as MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 62
#: Bits of a limb and rows of a product: BLOCK * 2^(2 * LIMB) is 2^53.
LIMB, BLOCK = 20, 8192
#: Bits of a digit of a big integer under way, and components returned.
DIGIT, COMPONENTS = 40, 16


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vector has finite entries only, in the commonest length of these.

    Lengths are told apart by their counts, the longer of equally common ones
    holds; rows of another length cannot share a covariance and go as rows
    with null entries do.
    """
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), entries.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite)
    commonest = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("_v") == (commonest["d"] if commonest else 0))

    def whole(c):
        scaled = c * F.lit(float(SCALE))
        inside = F.when(scaled > F.lit(float(MOST)), F.lit(MOST)).when(scaled < F.lit(-float(MOST)), F.lit(-MOST))
        return inside.otherwise(F.floor(F.when(F.abs(scaled) <= float(MOST), scaled).otherwise(F.lit(0.0)))) + F.lit(SHIFT)

    return rows.select("vec_id", F.transform("_v", whole).alias("x"))


def cut_limbs(values: np.ndarray, count: int, bits: int = LIMB) -> list[np.ndarray]:
    """Limbs of signed integers (int64 or Python's), lowest first: all but the last in [0, 2^bits)."""
    out = []
    for k in range(count):
        out.append((values if k == count - 1 else values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return out


def exact_gram(values: np.ndarray, largest: int, block: int = BLOCK, bits: int = LIMB) -> np.ndarray:
    """``values.T @ values`` as big integers; no entry may exceed ``largest`` in absolute value."""
    count = max(1, -(-(largest.bit_length() + 1) // bits))
    total = np.zeros((values.shape[1],) * 2, dtype=object)
    for start in range(0, len(values), block):
        parts = cut_limbs(values[start : start + block], count, bits)
        for power in range(2 * count - 1):
            for i in range(max(0, power - count + 1), power // 2 + 1):
                product = (parts[i].T @ parts[power - i]).astype(np.int64).astype(object)
                total += (product if 2 * i == power else product + product.T) << (bits * power)
    return total


def digits_of(value: int) -> list[int]:
    """Signed digits in base 2^DIGIT, lowest first; the last carries the sign."""
    out = []
    while not -(1 << (DIGIT - 1)) <= value < 1 << (DIGIT - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


PARTS_SCHEMA = "cell long, digit int, value long, low long, high long"


def digit_batch(numbers: list[int], low: list[int] | None = None, high: list[int] | None = None) -> pa.RecordBatch:
    """Rows (cell, digit, value, low, high) of numbers that Spark is to add up, with bounds of the same cells."""
    rows = [(cell, k, v) for cell, value in enumerate(numbers) for k, v in enumerate(digits_of(int(value)))]
    cells, places, values = zip(*rows, strict=True)
    bounds = [pa.array([None if x is None else x[c] for c in cells], pa.int64()) for x in (low, high)]
    arrays = [pa.array(cells, pa.int64()), pa.array(places, pa.int32()), pa.array(values, pa.int64()), *bounds]
    return pa.RecordBatch.from_arrays(arrays, ["cell", "digit", "value", "low", "high"])


def merged(parts: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """The sums of all tasks' numbers and their bounds, in order of cells: a row for each cell and digit comes to the driver."""
    sums: dict[int, int] = {}
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    grouped = parts.groupBy("cell", "digit").agg(F.sum("value").alias("value"), F.min("low").alias("low"), F.max("high").alias("high"))
    for r in grouped.collect():
        cell = r["cell"]
        sums[cell] = sums.get(cell, 0) + (r["value"] << (DIGIT * r["digit"]))
        if r["low"] is not None:
            low[cell], high[cell] = min(low.get(cell, r["low"]), r["low"]), max(high.get(cell, r["high"]), r["high"])
    return [sums[k] for k in range(len(sums))], [low.get(k, 0) for k in range(len(sums))], [high.get(k, 0) for k in range(len(sums))]


def matrix_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


@dataclass
class Whitener:
    """What whitening takes: size and sums of the fit list, unit components by falling eigenvalue, shares of the trace."""

    n: int
    sums: list[int]
    largest: int  # of |n x - S|
    components: np.ndarray  # a column each
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as int64 where that holds it (differences are exact even where the products wrap), else as Python's."""
        if self.largest < 1 << 62:
            wrapped = [(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in self.sums]
            return x * np.int64(self.n) - np.array(wrapped, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, y: np.ndarray) -> np.ndarray:
        return y.astype(np.float64) @ self.components / (self.n * np.sqrt(self.values))


def fit_sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Size and sums of the fit list, and the largest |n x - S|."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                sums = sums + (x >> 31).sum(0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
                n += len(x)
        if n:
            yield digit_batch([n, *sums], [0, *low.tolist()], [0, *high.tolist()])

    sums, low, high = merged(fit.mapInArrow(add, PARTS_SCHEMA))
    if not sums:
        return 0, [], 0
    n, totals = sums[0], sums[1:]
    edges = zip(totals, low[1:], high[1:], strict=True)
    return n, totals, max(max(abs(n * a - s), abs(n * b - s)) for s, a, b in edges)


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Learn from ``fit(x)``, whose rows are the distinct vectors.

    Components whose eigenvalue is not above the rounding of the largest are
    left out (constant dimensions, fewer vectors than dimensions); a list of
    none or one has no component. A component's entry of largest size is
    positive. A task's output is the upper half of the covariance, so tasks
    should hold many times as many rows as there are dimensions.
    """
    n, sums, largest = fit_sums(fit)
    d = len(sums)
    model = Whitener(n, sums, largest, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    if n < 2 or not largest:
        return model
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = 0, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(matrix_of(batch.column(0)))
                size += len(held[-1])
            if size >= BLOCK:
                total, held, size = total + exact_gram(model.centred(np.concatenate(held)), largest), [], 0
        if held:
            total = total + exact_gram(model.centred(np.concatenate(held)), largest)
        if not isinstance(total, int):
            yield digit_batch(total[upper].tolist())

    cells, _, _ = merged(fit.mapInArrow(products, PARTS_SCHEMA))
    covariance = np.zeros((d, d))
    covariance[upper] = [c / n**3 for c in cells]  # Python rounds the quotient of big integers once
    covariance = covariance + np.triu(covariance, 1).T
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    sound = int((values > 8 * d * np.finfo(float).eps * values[0]).sum())
    keep = min(components, sound)
    vectors = vectors[:, :keep] / np.linalg.norm(vectors[:, :keep], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)])
    trace = sum(c for c, i, j in zip(cells, *upper, strict=True) if i == j) / n**3
    model.components, model.values, model.explained = vectors * signs, values[:keep], values[:keep] / trace
    model.identity_error = identity_error(fit, model)
    return model


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the whitened values."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                white = model.project(model.centred(matrix_of(batch.column(0))))
                total[:k] += white.T @ white
                total[k] += white.sum(0)
        cells, flat = pa.array(range(total.size), pa.int64()), pa.array(total.ravel())
        yield pa.RecordBatch.from_arrays([cells, flat], ["cell", "value"])

    found = fit.mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["cell"]] = r["value"] / model.n
    total = total.reshape(k + 1, k)
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten_rows(rows: DataFrame, model: Whitener) -> DataFrame:
    """Each row of ``rows(vec_id, x)`` in the components: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` (the sum over dimensions of (n x - S)^2) is a decimal of 38
    digits, null where that is too few.
    """
    k, d = len(model.values), len(model.sums)
    fits = d * model.largest**2 < 1 << 63
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [part.split()[0] for part in schema.split(", ")]
    wide = pa.decimal128(38, 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                y = model.centred(matrix_of(part.column(1)))
                size = len(y)
                if fits:
                    deviation = pa.array((y * y).sum(1)).cast(wide)
                else:
                    exact = (y.astype(object) ** 2).sum(1).tolist()
                    deviation = pa.array([x if x < 10**38 else None for x in exact], wide)
                again = pa.array(np.repeat(np.arange(size), k))
                columns = [
                    part.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, model.n)),
                    deviation.take(again),
                    pa.array(model.project(y).ravel()),
                    pa.array(np.tile(model.explained, size)),
                    pa.array(np.full(size * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(project, schema)


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every sound vector: see whiten_rows() for the columns.

    Rows whose vector is null, empty, of an uncommon length or holds null or
    non-finite entries are left out; null and repeated ids are kept, repeated
    vectors count once in the fit and each get their rows; an empty table gives
    an empty result, as do vectors that are all alike; columns other than the
    key and the vector are not read. Entries that 64 times over pass a long
    count as the largest that safely fits. A vector is held whole, however long.
    """
    ship_package(vectors.sparkSession)
    rows = integers(vectors, vector, key)
    fit = materialize(rows.select("x").distinct(), "fit")  # equal vectors meet before the exchange
    model = fit_whitener(fit, components)
    discard(fit)
    return whiten_rows(rows, model)
