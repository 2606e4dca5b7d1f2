"""Operator 13: embeddings whitened by an exact covariance.

Method: entries become whole numbers x = floor(scale * c) + shift. The scatter matrix of all vectors (with a one put before each, so that counts and sums
are in it) is taken in residue numbers: each partition multiplies its vectors' residues modulo several primes as matrices of doubles, in blocks so
small that no sum leaves the whole numbers a double holds, and keeps the sums' residues. The partitions' residues are added in Spark by prime and row, and Chinese
remaindering gives the scatter exactly. n * scatter - sums * sums' is then exact as well; it is rounded once, to doubles, for the eigenvalues. There are two
decompositions: one of the covariance, and one of the covariance in the coordinates of the first, which removes the first one's error.

There are as many primes as the greatest |x| and the number of vectors ask for, so no count or size is assumed. The driver holds matrices of (dimensions + 1)^2,
whatever the number of vectors.

Defined results: a vector that is null or empty, or has an entry that is null, not finite or so large that x is no long, is left out. So are vectors of another length
than most have (of two equally common lengths the greater is taken). Rows that repeat each count. A component whose variance is nothing but rounding has no whitened
values and is left out: equal vectors, or a single one, give no rows, as an empty table does. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import stage

#: Primes lie below 2**PRIME_BITS; BLOCK vectors' products of residues sum to less than 2**53.
PRIME_BITS = 20
BLOCK = 1 << 53 - 2 * PRIME_BITS
#: Greatest whole number that an entry may become.
LARGEST = 1 << 62
#: Bytes of vectors that a task turns into matrices at once.
SLICE_BYTES = 1 << 22


def primes_over(bound: int) -> list[int]:
    """The greatest primes below 2**PRIME_BITS, so many that their product is over bound."""
    found, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


@dataclass
class Whitening:
    """What whitens: of n vectors of so many dimensions, the sums, and the components as columns with their variances, greatest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    scale: int
    shift: int
    largest: int

    @property
    def dimensions(self) -> int:
        return len(self.sums)


# Vectors as whole numbers -----------------------------------------------------------------------------------------------------------------


def whole_entries(vectors: DataFrame, scale: int, shift: int, column: str = "embedding") -> DataFrame:
    """vectors with `_x`, array of long, where all entries become longs; the others are left out."""
    doubles = F.transform(column, lambda c: c.cast("double"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale)
    rows = vectors.withColumn("_c", doubles).filter(F.col("_c").isNotNull() & (F.size("_c") > 0) & F.forall("_c", fits))
    return rows.withColumn("_x", F.transform("_c", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))).drop("_c")


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches and their `_x` as matrices of longs, a row a vector."""
    rows = max(1, SLICE_BYTES // (8 * width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# The scatter in residues --------------------------------------------------------------------------------------------------------------------


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """x'x modulo p, exactly."""
    r = np.remainder(x, p).astype(np.float64)
    total = np.zeros((x.shape[1],) * 2, np.int64)
    for at in range(0, len(r), BLOCK):
        block = r[at : at + BLOCK]
        total = (total + (block.T @ block).astype(np.int64)) % p
    return total


def _scatters(width: int, primes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(primes), width + 1, width + 1), np.int64)
        any_ = False
        for _, x in matrices(batches, width):
            ones = np.hstack([np.ones((len(x), 1), np.int64), x])
            any_ = True
            for k, p in enumerate(primes):
                totals[k] = (totals[k] + residue_scatter(ones, p)) % p
        if any_:
            yield _residue_rows(((p, row) for p in range(len(primes)) for row in range(width + 1)), totals.reshape(-1, width + 1))

    return run


def _residue_rows(keys: Iterator[tuple[int, int]], sums: np.ndarray) -> pa.RecordBatch:
    prime, row = (pa.array(c, pa.int32()) for c in zip(*keys))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.reshape(-1)))
    return pa.RecordBatch.from_arrays([prime, row, values], ["prime", "row", "sums"])


def _added(primes: list[int]) -> Callable:
    """Residues of equal (prime, row) added; a task holds one sum for each row of a matrix that it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for key, line in zip(zip(batch.column("prime").to_pylist(), batch.column("row").to_pylist()), sums):
                totals[key] = (totals[key] + line) % primes[key[0]] if key in totals else line.copy()
        if totals:
            yield _residue_rows(iter(totals), np.stack(list(totals.values())))

    return run


def reconstructed(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """Whole numbers (objects) between minus and plus half the primes' product from their residues, a first axis of one for each prime."""
    value, product = residues[0].astype(object), primes[0]
    for r, p in zip(residues[1:], primes[1:]):
        step = (r - (value % p).astype(np.int64)) * pow(product, -1, p) % p
        value, product = value + step.astype(object) * product, product * p
    return np.where(value > product // 2, value - product, value)


def exact_scatter(rows: DataFrame, width: int, primes: list[int]) -> np.ndarray:
    """The scatter of the vectors `_x` of rows, each with a one before it, in whole numbers of any size."""
    schema = "prime int, row int, sums array<long>"
    parts = rows.select("_x").mapInArrow(_scatters(width, primes), schema)
    found = parts.repartition("prime", "row").mapInArrow(_added(primes), schema).collect()
    residues = np.zeros((len(primes), width + 1, width + 1), np.int64)
    for r in found:
        residues[r.prime, r.row] = r.sums
    return reconstructed(residues, primes)


# Whitening ------------------------------------------------------------------------------------------------------------------------------------


def decomposed(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, greatest first, and unit eigenvectors as columns, by two decompositions."""
    _, first = np.linalg.eigh(covariance)
    turned = first.T @ covariance @ first
    values, second = np.linalg.eigh((turned + turned.T) / 2)
    vectors = first @ second
    return values[::-1], (vectors / np.linalg.norm(vectors, axis=0))[:, ::-1]


def fit(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, most: int = 8, column: str = "embedding") -> Whitening | None:
    """What whitens vectors, fitted on all of them that are not left out; None if there are none."""
    rows = whole_entries(vectors, scale, shift, column)
    largest = F.max(F.greatest(F.abs(F.array_max("_x")), F.abs(F.array_min("_x"))))
    # a row for each length of vectors
    lengths = rows.groupBy(F.size("_x").alias("width")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), F.desc("width")).first()
    if lengths is None:
        return None
    width, n = lengths.width, lengths.n
    primes = primes_over(2 * n * max(1, lengths.largest) ** 2)
    scatter = exact_scatter(rows.filter(F.size("_x") == width), width, primes)
    sums = scatter[0, 1:]
    exact = n * scatter[1:, 1:] - np.outer(sums, sums)
    # whole numbers divide with one rounding
    covariance = (exact / (n * n)).astype(np.float64)
    values, components = decomposed(covariance)
    real = values > width * np.finfo(float).eps * max(values[0], 0)
    keep = min(most, int(real.sum()))
    trace = float(sum(int(exact[i, i]) for i in range(width)) / (n * n))
    return Whitening(n, [int(s) for s in sums], components[:, :keep], values[:keep], trace, scale, shift, int(lengths.largest))


def whitened(vectors: DataFrame, model: Whitening, *keys: str, column: str = "embedding") -> DataFrame:
    """keys, deviation (decimal: the exact sum of (n x - S)^2, null if it has over 38 digits) and `whitened`, an array of a double for each component, of the vectors that model can take."""
    rows = whole_entries(vectors, model.scale, model.shift, column).filter(F.size("_x") == model.dimensions).select(*keys, "_x")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_x"), "deviation string, whitened array<double>"])
    n, sums, width = model.n, model.sums, model.dimensions
    weights = model.components / np.sqrt(model.variances)
    # longs hold n x - S, or its squares' sum, only up to a size; whole numbers of any size hold the rest
    far = n * max(model.largest, 1) * 2
    small, tiny = far < 1 << 63, far * far * width < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, width):
            apart = x * n - np.array(sums) if small else x.astype(object) * n - np.array(sums, object)
            squares = (apart if tiny else apart.astype(object)) ** 2
            found = (apart.astype(np.float64) / n) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * weights.shape[1]), pa.array(found.reshape(-1)))
            names = [*keys, "deviation", "whitened"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array([str(s) for s in squares.sum(axis=1)]), lists], names)

    return rows.mapInArrow(run, ddl).withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def identity_error(rows: DataFrame, components: int) -> float:
    """The greatest absolute entry of the covariance of rows' `whitened` minus the identity; Spark centres each pair's moments as it merges them."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def components_of(vectors: DataFrame, *keys: str, scale: int = 1024, shift: int = 100_000, most: int = 8, column: str = "embedding") -> DataFrame:
    """A row for each vector that is not left out and each component: keys, component (1 first), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, scale, shift, most, column)
    if model is None or not len(model.variances):
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keys).schema.fields]
        return vectors.sparkSession.createDataFrame([], ", ".join([*names, "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"]))
    rows = stage(whitened(vectors, model, *keys, column=column), "whitened")
    error = identity_error(rows, len(model.variances))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    each = rows.select(*keys, "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return each.select(*keys, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("_value").alias("whitened"), shares[F.col("_at")].alias("explained"), F.lit(error).alias("identity_error"))
