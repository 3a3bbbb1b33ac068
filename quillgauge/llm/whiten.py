"""Whitening of vectors on their leading components, found by QDWH spectral divide and conquer.

Vectors become integers, x = floor(scale * c) + offset. Three passes over the rows give, as sums of
partitions added up by dimension: the number of rows and the exact sum of every dimension; the
covariance, of rows centred by the exact mean before they are multiplied; and, for the figure of
merit, the covariance of the whitened rows. Only matrices of dimension x dimension reach the driver.

There the covariance is split by the polar factor U of V - s I, which the QR-based dynamically
weighted Halley iteration finds: (U + I) / 2 projects on the eigenvectors above the shift s. An
orthonormal basis of its range and of the rest turns V into two blocks, which are split in the same
way, the upper one first and the lower one only as far as components are still wanted. The axes over
the roots of their variances are broadcast, and a last pass whitens the rows.

Edge cases: vectors that are null, empty or hold a null or non-finite entry take no part; neither do
vectors of another length than most have (of equally common lengths, the longer); entries are taken
as 2**52 or -2**52 beyond these; components without variance, up to rounding, are left out, so all
of them where rows are equal or single; components of equal variance come in any order, the same for
all rows; a deviation beyond a long is null; null or repeated ids play no part and rows that repeat
count each; columns of the input named like an added one, in any case, give way; an empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.session import stored

_BOUND = 1 << 52
_ROUNDS = 20


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its rows, exact sums by dimension, and components by falling variance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    scale: int
    offset: int
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the exact difference n*x - S."""
        return (deviations(self, x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.variances))


# Rows as integer matrices


def integers(column: pa.Array, scale: int, offset: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, x) for every length among the vectors that take part."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        values = flat[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(scale * values[good]).clip(-_BOUND, _BOUND).astype(np.int64) + offset
        out.append((int(size), rows[good], x))
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    small = len(x) == 0 or int(np.abs(x).max()) * len(x) < 1 << 62
    return [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]


def deviations(fit: Fit, x: np.ndarray) -> np.ndarray:
    """n*x - S, exact; Python integers where a long would not do."""
    largest = max([abs(s) for s in fit.sums] + [fit.n * (int(np.abs(x).max()) if x.size else 0)])
    kind = np.int64 if largest < 1 << 61 else object
    return fit.n * x.astype(kind) - np.array(fit.sums, dtype=kind)


def squared(fit: Fit, x: np.ndarray) -> list[int | None]:
    """The exact sum of the squared deviations of every row, null beyond a long."""
    d = deviations(fit, x)
    if d.size and (d.dtype == object or int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63):
        d = d.astype(object)
    return [s if s < 1 << 63 else None for s in map(int, (d * d).sum(axis=1))]


# Spectral divide and conquer


def polar(a: np.ndarray) -> np.ndarray:
    """The symmetric unitary polar factor of a symmetric matrix, by QR-based weighted Halley steps."""
    size = np.linalg.norm(a)
    d = len(a)
    if size == 0:
        return np.eye(d)
    x, low = a / size, np.finfo(float).eps
    for _ in range(_ROUNDS):
        square = low * low
        g = (4 * (1 - square) / square**2) ** (1 / 3)
        first = np.sqrt(1 + g)
        p = first + np.sqrt(max(0.0, 8 - 4 * g + 8 * (2 - square) / (square * first))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(d)]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * basis[:d] @ basis[d:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        done = low > 1 - 1e-15 and np.linalg.norm(new - x) <= 1e-13 * np.sqrt(d)
        x = new
        if done:
            break
    return x


def divide(v: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the eigenvectors above some shift, and k.

    None if all eigenvalues are equal up to rounding of ``scale``.
    """
    d = len(v)
    spread = np.abs(v - np.diag(np.diag(v))).sum(axis=1)
    low, high = (np.diag(v) - spread).min(), (np.diag(v) + spread).max()
    rounding = 4 * np.finfo(float).eps * scale
    shift, draw = float(np.mean(np.diag(v))), np.random.default_rng(d)
    while high - low > rounding:
        above = (polar(v - shift * np.eye(d)) + np.eye(d)) / 2
        k = int(round(np.trace(above)))
        if 0 < k < d and np.linalg.norm(above @ above - above) < 1e-8:
            basis = draw.normal(size=(d, k))
            for _ in range(3):
                basis, _ = np.linalg.qr(above @ basis[:, :k], mode="complete")
            return basis, k
        if k == 0:
            high = shift
        elif k == d:
            low = shift
        # A shift on an eigenvalue projects on neither side: another place between the bounds.
        share = 0.5 if k in (0, d) else draw.uniform(0.25, 0.75)
        shift = low + share * (high - low)
    return None


def components(v: np.ndarray, wanted: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.linalg.norm(v) if scale is None else scale
    split = divide(v, scale) if len(v) > 1 else None
    if split is None:
        return np.diag(v)[:wanted].copy(), np.eye(len(v))[:, :wanted]
    basis, k = split
    found = []
    for part in (basis[:, :k], basis[:, k:]):
        if wanted > 0:
            block = part.T @ v @ part
            values, axes = components((block + block.T) / 2, wanted, scale)
            found.append((values, part @ axes))
            wanted -= len(values)
    return np.concatenate([f[0] for f in found]), np.hstack([f[1] for f in found])


# Passes over the rows


def _summed(df: DataFrame, vector: str, schema: str, start: Callable[[], list], add: Callable[[list, pa.Array], None], tell: Callable[[list], pa.RecordBatch]) -> DataFrame:
    """One state per partition, to which every batch of vectors is added."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in stream:
            add(state, batch.column(0))
        yield tell(state)

    return df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)


def _matrix(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of matrices given as rows (i, row): added up by entry, then read by the driver."""
    entries = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((d, d))
    out[entries["i"].to_numpy(), entries["j"].to_numpy()] = entries["x"].to_numpy()
    return (out + out.T) / 2


def _products(df: DataFrame, vector: str, fit: Fit, make: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum of y yᵀ over all rows, y made of a block of rows."""

    def add(state: list, column: pa.Array) -> None:
        for size, _, x in integers(column, fit.scale, fit.offset):
            if size == len(fit.sums):
                for part in range(0, len(x), 1 << 12):
                    y = make(x[part : part + (1 << 12)])
                    state[0] += y.T @ y

    def tell(state: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(state[0]), pa.list_(pa.float64()))], ["i", "row"])

    return _matrix(_summed(df, vector, "i int, row array<double>", lambda: [np.zeros((d, d))], add, tell), d)


def _sums(df: DataFrame, vector: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension of the most common length."""

    def add(state: list, column: pa.Array) -> None:
        for size, _, x in integers(column, scale, offset):
            n, sums = state[0].get(size, (0, [0] * size))
            state[0][size] = (n + len(x), [a + b for a, b in zip(sums, exact_sums(x), strict=True)])

    def tell(state: list) -> pa.RecordBatch:
        rows = [(size, i, n, str(s)) for size, (n, sums) in state[0].items() for i, s in enumerate(sums) if n]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["size", "i", "n", "s"])

    parts = _summed(df, vector, "size int, i int, n long, s string", lambda: [{}], add, tell)
    totals = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    totals = stored(totals, "sums")
    most = totals.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    found = totals.filter(F.col("size") == most["size"]).select("i", F.col("s").cast("string").alias("s")).collect()
    return most["n"], [int(r["s"]) for r in sorted(found)]


def fit(df: DataFrame, vector: str = "vector", wanted: int = 8, scale: int = 1024, offset: int = 100_000) -> Fit | None:
    """Fit on all vectors of ``df``; None without any. The driver and every task hold dimension**2 numbers."""
    n, sums = _sums(df, vector, scale, offset)
    if not n:
        return None
    d = len(sums)
    bare = Fit(n, tuple(sums), np.empty((d, 0)), np.empty(0), np.empty(0), scale, offset)
    covariance = _products(df, vector, bare, bare.centred, d) / n
    values, axes = components(covariance, wanted)
    kept = values > d * np.finfo(float).eps * max(values.max(), 0.0)
    found = replace(bare, axes=axes[:, kept], variances=values[kept], explained=values[kept] / np.trace(covariance))
    k = int(kept.sum())
    # The whitened rows have mean zero, because the rows were centred by their own mean.
    error = np.abs(_products(df, vector, found, found.whitened, k) / n - np.eye(k)).max() if k else 0.0
    return replace(found, error=float(error))


def whiten(df: DataFrame, fitted: Fit | None, vector: str = "vector", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``whitened array<double>``, an entry per component, and the exact ``deviation``; other rows go."""
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = shared.value
        rows: list = [None] * len(batch)
        far: list = [None] * len(batch)
        for size, places, x in integers(batch.column(batch.schema.get_field_index(vector)), own.scale, own.offset) if own else []:
            if size == len(own.sums):
                for place, row, distance in zip(places, own.whitened(x), squared(own, x), strict=True):
                    rows[place], far[place] = row, distance
        return [pa.array(rows, pa.list_(pa.float64())), pa.array(far, pa.int64())]

    return append(df, "whitened array<double>, deviation long", make, drop).filter(F.col("whitened").isNotNull())
