"""Embedding whitening by principal components from FEAST contour integration.

Vectors are lattice points: an entry c becomes the integer floor(64 c) + 10^6,
so sums over rows are exact whatever the order of partitions.

1. One pass sums rows and entries (``n`` and ``S`` per dimension), a second one
   the products of entries centred at the integer next to S / n.  Each task
   sends one sum vector or matrix (dimensions squared at most).  The products
   are integers, exact as doubles below 2^53, and the last fraction of the
   centring is taken off in whole numbers: the covariance is the exact one,
   rounded once.
2. The covariance's spectrum above rounding level is cut into intervals by
   inertia counts: the negative pivots of V - t I (symmetric elimination) are the
   eigenvalues below t.  Intervals holding more than ``PER_INTERVAL`` are cut in
   a gap near the middle while there is one.
3. FEAST: for each interval a block of start vectors is sent through the
   quadrature of the resolvent around it (Gauss-Legendre nodes on a half circle;
   complex shifted solves of the covariance), which projects onto the interval's
   eigenvectors; Rayleigh-Ritz extracts the pairs, and both steps repeat until
   the residuals are at rounding level.  The count of pairs inside has to equal
   the inertia count, so none is missed; a block that comes short grows.
4. Every row is projected in one narrow pass.  A further pass sums the products
   of the whitened values, whose distance from the identity is reported.

The driver holds matrices of dimensions squared, never rows.  Passes are narrow
but for the sums of one row per task; a lost task is run again.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
are dropped, as are empty ones and, where lengths differ, all but those of the
most frequent length (of equal ones the longest).  Repeated rows count each.
A null id stays null.  Components whose eigenvalue is at rounding level (none
varies: one row, equal rows, dependent dimensions) cannot be whitened and are
left out.  Equal eigenvalues give any orthonormal basis of their space.  An
empty table gives an empty result.  Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrad.session import ship_package

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
PER_INTERVAL = 8
NODES = 12
ROUNDS = 40
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------ small matrices
def inertia(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``v`` below ``shift``: the negative pivots
    of the symmetric elimination of v - shift I, 2 x 2 where a diagonal pivot
    would be too small against its column (Bunch-Kaufman)."""
    a = v - shift * np.eye(len(v))
    tiny = EPS * max(float(np.abs(a).max(initial=0.0)), 1e-300)
    below, alpha = 0, (1 + 17 ** 0.5) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while len(a):
        n = len(a)
        col = np.abs(a[1:, 0])
        r = 1 + int(col.argmax()) if n > 1 else 0
        lam = col[r - 1] if n > 1 else 0.0
        if max(abs(a[0, 0]), lam) <= tiny:
            a = a[1:, 1:]  # a zero pivot: an eigenvalue at the shift, not below
            continue
        if abs(a[0, 0]) < alpha * lam:
            row = np.abs(a[r]).copy()
            row[r] = 0
            sigma = row.max()
            if abs(a[0, 0]) * sigma < alpha * lam * lam:
                if abs(a[r, r]) >= alpha * sigma:
                    swap(0, r)
                else:
                    swap(1, r)
                    block = a[:2, :2]
                    below += int((np.linalg.eigvalsh(block) < 0).sum())
                    a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(block, a[:2, 2:])
                    continue
        below += int(a[0, 0] < 0)
        a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / a[0, 0]
    return below


def _gap(v: np.ndarray, low: float, high: float, scale: float) -> tuple[float, int] | None:
    """A cut near the middle with no eigenvalue close by, and the count below."""
    clear = min(1e-9 * scale, (high - low) / 64)
    for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.25, 0.75):
        mid = low + (high - low) * part
        at = inertia(v, mid + clear)
        if at == inertia(v, mid - clear):
            return mid, at
    return None


def intervals(v: np.ndarray, wanted: int, least: float, scale: float,
              per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals between eigenvalues, from the largest
    eigenvalue down to ``least`` or until ``wanted`` are inside."""
    out, have, high = [], 0, scale * (1 + 1e-6)
    todo = [(least, high, inertia(v, least), len(v))]
    while todo and have < wanted:
        low, high, under, upto = todo.pop()  # the highest interval is last
        if upto == under:
            continue
        cut = _gap(v, low, high, scale) if upto - under > per and high - low > 1e-7 * scale else None
        if cut is None:  # few enough, or too close together to be told apart
            out.append((low, high, upto - under))
            have += upto - under
        else:
            todo += [(low, cut[0], under, cut[1]), (cut[0], high, cut[1], upto)]
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in (low, high), ascending."""
    size = len(v)
    x, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - x)
    centre, radius = (low + high) / 2, max((high - low) / 2, 64 * EPS * scale)
    nodes = centre + radius * np.exp(1j * angle)
    block = min(size, max(count + 6, 2 * count))
    generator = np.random.default_rng(20)  # start vectors, the same every time
    q = np.linalg.qr(generator.standard_normal((size, block)))[0]
    values = vectors = None
    for turn in range(ROUNDS):
        p = np.zeros((size, q.shape[1]))
        for z, e, w in zip(nodes, np.exp(1j * angle), weight):
            p += (w / 2) * np.real(radius * e * np.linalg.solve(z * np.eye(size) - v, q))
        # Rayleigh-Ritz in the projected space; directions of no weight go.
        u, s, _ = np.linalg.svd(p, full_matrices=False)
        basis = u[:, s > EPS * max(s[0], 1e-300)]
        small = basis.T @ v @ basis
        ritz, mix = np.linalg.eigh((small + small.T) / 2)
        q = basis @ mix
        inside = (ritz > low) & (ritz < high)
        values, vectors = ritz[inside], q[:, inside]
        residual = np.abs(v @ vectors - vectors * values).max(initial=0.0)
        if inside.sum() == count and residual <= 16 * EPS * scale:
            return values, vectors
        if turn % 8 == 7 and q.shape[1] < size:  # too few directions: a larger block
            more = generator.standard_normal((size, min(count + 6, size - q.shape[1])))
            q = np.linalg.qr(np.hstack([q, more]))[0]
    if values is not None and len(values) == count and residual <= 1e-10 * scale:
        return values, vectors
    raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}), found {0 if values is None else len(values)}")


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the largest
    ``wanted`` eigenvalues that are above rounding level."""
    v = (v + v.T) / 2
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    least = 64 * len(v) * EPS * scale
    pairs = [feast(v, low, high, count, scale) for low, high, count in intervals(v, wanted, least, scale)]
    if not pairs:
        return np.zeros(0), np.zeros((len(v), 0))
    values = np.concatenate([p[0] for p in pairs])
    vectors = np.hstack([p[1] for p in pairs])
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    # Pairs of different intervals are orthogonal up to rounding over their
    # distance; this takes the rest off and keeps the signs.
    q, r = np.linalg.qr(vectors)
    return values, q * np.sign(np.diag(r))


# -------------------------------------------------------------- Spark passes
def lattice(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(_id, _x): the valid rows as lattice points, all of one length."""
    entry = lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(OFFSET)).cast("long")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    c = F.col(vector_col)
    valid = vectors.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite))
    lengths = valid.groupBy(F.size(c).alias("_d")).agg(F.count("*").alias("_n"))
    top = lengths.orderBy(F.desc("_n"), F.desc("_d")).limit(1).collect()
    width = top[0]["_d"] if top else 0
    return valid.where(F.size(c) == width).select(F.col(id_col).alias("_id"), F.transform(c, entry).alias("_x"))


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _summed(points: DataFrame, column: str, width: int, values) -> np.ndarray:
    """The sum over all rows of ``values(matrix of rows)``, a vector each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = values(_rows(batch, column, width))
                total = part if total is None else total + part
        if total is not None:
            kind = pa.int64() if total.dtype.kind == "i" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, kind)],
                                             ["at", "v"])

    kind = "long" if values(np.zeros((1, width), np.int64)).dtype.kind == "i" else "double"
    parts = points.select(column).mapInArrow(run, f"at int, v {kind}")
    rows = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # one row per position of the sum
    out = np.zeros(len(rows), np.int64 if kind == "long" else float)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def covariance(points: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V) of lattice points ``_x``; divisor n."""
    sums = _summed(points, "_x", width, lambda x: np.append(x.sum(axis=0), len(x)))
    n, total = int(sums[-1]), [int(s) for s in sums[:-1]]
    middle = np.array([round(s / n) for s in total], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - middle).astype(float)
        return (z.T @ z).reshape(-1)

    gram = _summed(points, "_x", width, products)
    rest = [s - n * int(m) for s, m in zip(total, middle)]  # sums of the centred entries
    v = np.empty((width, width))
    for i in range(width):
        for j in range(width):
            v[i, j] = (n * int(gram[i * width + j]) - rest[i] * rest[j]) / (n * n)
    return n, total, v


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error) for each valid
    row: ``whitened`` and ``explained`` are arrays over the components (by
    falling eigenvalue), ``deviation`` is the exact sum of (n x - S)^2."""
    ship_package(vectors.sparkSession)
    points = lattice(vectors, vector_col, id_col)
    kind = dict(vectors.dtypes)[id_col]
    schema = (f"`{id_col}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, "
              "identity_error double")
    width = points.select(F.size("_x")).take(1)
    if not width:
        return points.sparkSession.createDataFrame([], schema)
    width = width[0][0]
    n, total, v = covariance(points, width)
    values, axes = leading_components(v, components)
    k, sums, scaled = len(values), np.array(total, np.int64), axes / np.sqrt(values)

    def white(x: np.ndarray) -> np.ndarray:
        return ((n * x - sums) / n) @ scaled

    error = 0.0
    if k:
        again = _summed(points, "_x", width, lambda x: ((w := white(x)).T @ w).reshape(-1)).reshape(k, k) / n
        error = float(np.abs(again - np.eye(k)).max())
    explained = [float(e) for e in values / np.trace(v)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = white(_rows(batch, "_x", width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()),
                                                           pa.array(w.reshape(-1), pa.float64())),
                 batch.column(2)], ["_id", "whitened", "deviation"])

    # Whole numbers: more than a long holds is an error, not a wrong result.
    gap = F.zip_with("_x", F.array(*[F.lit(s).cast("long") for s in total]), lambda x, s: F.lit(n).cast("long") * x - s)
    squares = F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: a + g * g)
    out = points.select("_id", "_x", squares.alias("_deviation")).mapInArrow(
        run, f"_id {kind}, whitened array<double>, deviation long")
    return out.select(F.col("_id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"),
                      F.lit(error).alias("identity_error"))
