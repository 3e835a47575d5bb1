"""Whitening of vectors by a bidiagonal qd solver.

Entries become integers, x = floor(`SCALE` * c) + `OFFSET`, so that counts, sums and deviations are exact.
Centred rows are reduced block by block to triangular factors (QR), which are reduced `FAN` at a time
until one R of d x d is left. Householder reflections turn R into an upper bidiagonal B, the dqds
algorithm finds its singular values, and twisted factorisations of B'B - e find the directions. R has the
size of the vectors' dimension alone, whatever the number of rows; only it, sums and small covariances
reach the driver.

Cases: rows whose vector is null or holds null, infinite or missing numbers are dropped; so are empty
vectors and those of another length than most have (of two equally frequent lengths the longer one
counts). Entries are clipped to +-`LARGEST` before scaling. Components whose eigenvalue is zero to double
precision relative to the first one don't exist: one vector, or copies of one vector, give no rows.
Repeated rows and repeated or null ids count and come out as often as they come. Of equal eigenvalues any
basis of their space comes out, the same for all rows; a component's largest entry is positive. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow_text import sums_by_row
from linkloom.operators.materialize import Scratch

SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**30
#: Vector entries that a task holds as numbers at once (a block of QR), and triangular factors that are reduced together.
ENTRIES, FAN = 1 << 18, 8
COMPONENTS = 8
EPS = np.finfo(float).eps


def integers(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable rows of that length, and their integers; without a length, the places and
    lengths of all usable rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = sums_by_row((~np.isfinite(values)).astype(np.int64), ends - sizes, ends)
    if length is None:
        usable = np.flatnonzero((sizes > 0) & (bad == 0))
        return usable, sizes[usable]
    rows = np.flatnonzero((sizes == length) & (bad == 0))
    at = (ends - sizes)[rows][:, None] + np.arange(length)
    return rows, np.floor(SCALE * np.clip(values[at], -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def pieces(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches' rows in blocks of about `ENTRIES` entries, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * ENTRIES // max(1, len(batch.column(column).flatten())))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def moments(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension; (0, []) if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in pieces(batches):
            _, lengths = integers(batch.column(0))
            for d in np.unique(lengths).tolist():
                _, x = integers(batch.column(0), d)
                n, s = total.get(d, (0, 0))
                total[d] = n + len(x), s + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], names=["length", "n", "sums"])

    parts = vectors.select(column).mapInArrow(run, "length int, n long, sums array<long>")
    scratch = Scratch(vectors.sparkSession)
    parts = scratch.keep(parts)
    most = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    sums = []
    if most:
        each = parts.where(F.col("length") == most.length).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        sums = [int(r.s) for r in each.orderBy("i").collect()]  # one row a dimension
    scratch.clear()
    return (most.n, sums) if most else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: of 64 bits where that holds them, else of Python's integers."""
    most = n * (SCALE * int(LARGEST) + OFFSET) if len(x) == 0 else n * int(np.abs(x).max())
    kind = np.int64 if most + max(map(abs, sums)) < 2**62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def triangle(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """R of the rows, below an earlier R."""
    return np.linalg.qr(rows if above is None else np.vstack((above, rows)), mode="r")


def reduced(vectors: DataFrame, column: str, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: a factor of each task's rows, then of `FAN` factors at a time."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in pieces(batches):
            _, x = integers(batch.column(0), d)
            if len(x):
                r = triangle(deviations(x, n, sums).astype(float) / n, r)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def together(table: pa.Table) -> pa.Table:
        r = None
        for raw in table.column("r").to_pylist():
            r = triangle(np.frombuffer(raw).reshape(-1, d), r)
        return pa.table({"part": pa.array([table.column("group")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    scratch = Scratch(vectors.sparkSession)
    parts = scratch.keep(vectors.select(column).mapInArrow(run, "r binary").select(F.spark_partition_id().cast("long").alias("part"), "r"))
    while True:
        left, most = parts.agg(F.count("*"), F.max("part")).first()
        if left <= 1:
            break
        # Some numbers may be empty, so groups are by number, not by rank: each round leaves a FANth of them.
        parts = scratch.keep(parts.select((F.col("part") / FAN).cast("long").alias("group"), "r").groupBy("group").applyInArrow(together, "part long, r binary"))
    r = np.frombuffer(parts.select("r").first()[0]).reshape(-1, d)
    scratch.clear()
    return np.vstack((r, np.zeros((max(0, d - len(r)), d))))[:d]


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v (unit or zero) and a, with (I - 2vv')x = a * e1."""
    size = np.linalg.norm(x)
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), x[0]
    v = x.copy()
    a = -size if x[0] >= 0 else size
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and upper diagonal b of U'rV, and V."""
    m, v = r.astype(float).copy(), np.eye(r.shape[1])
    d = r.shape[1]
    for k in range(d):
        u, _ = reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        if k < d - 2:
            w, _ = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with a shift, and the least of its pivots."""
    out_q, out_e = [0.0] * len(q), [0.0] * len(e)
    d = least = q[0] - shift
    for k in range(len(e)):
        top = d + e[k]
        out_q[k] = top
        if top <= 0:  # all further pivots are zero or less, or the matrix splits
            out_e[k], d = (0.0, q[k + 1] - shift) if e[k] == 0 else (e[k], -1.0)
        else:
            out_e[k] = q[k + 1] * (e[k] / top)
            d = q[k + 1] * (d / top) - shift
        least = min(least, d)
    out_q[-1] = d
    return out_q, out_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared singular values of the bidiagonal (a, b), falling, each to high relative accuracy.

    A shift is the bound that the last two rows give for the least value; where it is too large the
    transform shows it by a negative pivot and runs again with a guaranteed bound or without a shift."""
    found: list[float] = []
    todo = [((a**2).tolist(), (b**2).tolist(), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q) > 1:
            small = (100 * EPS) ** 2 * (sigma + q[-1])
            if e[-1] <= max(small, 1e-300):
                found.append(sigma + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 1) if e[k] <= EPS**2 * max(sigma + q[k], 1e-300)), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # Tridiagonal rows n - 1 and n of the product, and what ties them to the rest.
            x, y, tie = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = abs(x - y) / 2
            low = min(x, y) - tie / (half + (half * half + tie) ** 0.5)
            rest = (q[-3] * e[-2]) ** 0.5 if len(q) > 2 else 0.0
            weight = 1.0 if x == low else min(1.0, tie**0.5 / abs(x - low))
            root = [v**0.5 for v in q]
            edge = [v**0.5 for v in e]
            sure = min(r - ((edge[k - 1] if k else 0.0) + (edge[k] if k < len(edge) else 0.0)) / 2 for k, r in enumerate(root))
            for shift in (low - rest * weight, low * (1 - 1e-3) - 2 * rest * weight, max(0.0, sure) ** 2 * (1 - 1e-12), 0.0):
                if shift < 0:
                    continue
                new_q, new_e, least = transformed(q, e, shift)
                if least >= 0 or shift == 0:
                    break
            q, e, sigma = [max(0.0, x) for x in new_q], new_e, sigma + shift
        found.extend(sigma + x for x in q)
    return np.sort(np.array(found))[::-1]


def twisted(diag: np.ndarray, off: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots of diag/off - value from above and from below, and where they meet: the twist's residuals."""
    n, tiny = len(diag), EPS * EPS * max(np.abs(diag).max(), 1e-300)
    down, up = np.empty(n), np.empty(n)
    for k in range(n):
        x = diag[k] - value - (off[k - 1] ** 2 / down[k - 1] if k else 0.0)
        down[k] = x if abs(x) > tiny else tiny
    for k in range(n - 1, -1, -1):
        x = diag[k] - value - (off[k] ** 2 / up[k + 1] if k < n - 1 else 0.0)
        up[k] = x if abs(x) > tiny else tiny
    return down, up, down + up - (diag - value)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for the leading values, as columns. Within a cluster of values each is
    orthogonal to those before; a twist that gives nothing new is tried elsewhere."""
    diag, off = a**2 + np.concatenate(([0.0], b**2)), a[:-1] * b
    n, out = len(diag), []
    for i, value in enumerate(values):
        near = [z for z, other in zip(out, values) if abs(other - value) <= 1e-5 * values[0]]
        down, up, meet = twisted(diag, off, value)
        best, most = None, 0.0
        for k in np.argsort(np.abs(meet), kind="stable").tolist():
            z = np.zeros(n)
            z[k] = 1.0
            for j in range(k - 1, -1, -1):
                z[j] = -off[j] / down[j] * z[j + 1]
            for j in range(k + 1, n):
                z[j] = -off[j - 1] / up[j] * z[j - 1]
            z /= np.linalg.norm(z)
            left = z
            for _ in range(2):
                for other in near:
                    left = left - other * (other @ left)
            size = np.linalg.norm(left)
            if size > most:
                best, most = left / size, size
            if most > 0.5 or not near:
                break
        out.append(best)
    return np.array(out).T


@dataclass(frozen=True)
class Whitening:
    """What whitening takes from the vectors: their number, sums, eigenvalues and eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float = float("nan")

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact n * x - sums, and the whitened components."""
        far = deviations(x, self.n, self.sums)
        return far, (far.astype(float) / self.n) @ self.vectors / np.sqrt(self.values)


def solved(r: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
    a, b, right = bidiagonal(r)
    squares = dqds(a, b)
    k = min(components, int((squares > len(squares) * EPS * squares[0]).sum())) if squares[0] > 0 else 0
    vectors = right @ directions(a, b, squares[:k]) if k else np.zeros((len(sums), 0))
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0) if k else vectors
    return Whitening(n, sums, squares[:k] / n, vectors, float(squares.sum()) / n)


def covariance(vectors: DataFrame, column: str, fit: Whitening) -> np.ndarray:
    """The covariance of the whitened vectors, from sums of products by task."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in pieces(batches):
            _, x = integers(batch.column(0), len(fit.sums))
            if len(x):
                w = fit.project(x)[1]
                total += np.vstack((w.sum(axis=0), w.T @ w))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = vectors.select(column).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    flat = np.array([r.s for r in sorted(sums.collect(), key=lambda r: r.i)]).reshape(k + 1, k) / fit.n  # k + 1 times k rows
    return flat[1:] - np.outer(flat[0], flat[0])


def train(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors, up to that many components."""
    n, sums = moments(vectors, column)
    if n == 0:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    fit = solved(reduced(vectors, column, n, sums), n, sums, components)
    if len(fit.values) == 0:
        return fit
    error = float(np.abs(covariance(vectors, column, fit) - np.eye(len(fit.values))).max())
    return Whitening(fit.n, fit.sums, fit.values, fit.vectors, fit.total, error)


def whiten(vectors: DataFrame, fit: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, deviation (the exact sum of squares of n * x - sums, decimal) and whitened (array) of every usable
    row; no rows where the whitening has no component."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows, x = integers(batch.column(1), len(fit.sums))
            if k == 0 or len(x) == 0:
                continue
            far, w = fit.project(x)
            wide = far if far.dtype != object and int(np.abs(far).max()) ** 2 * far.shape[1] < 2**63 else far.astype(object)
            squares = [Decimal(int(s)) for s in (wide * wide).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(squares, pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("id"), column).mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", key)
