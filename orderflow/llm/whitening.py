"""Whitening of embeddings by an incremental eigendecomposition.

Components of a vector become whole numbers x = floor(scale * c). The fit list is each distinct x vector
once, written as a table. Every partition of it walks through its vectors and keeps a count, a mean and
the spectrum of the centred scatter matrix: a vector changes the scatter by k / (k + 1) (x - m)(x - m)',
which is a rank-one update of the spectrum. The new eigenvalues are the roots of the secular equation
1 + rho sum z_i^2 / (d_i - t) = 0, all found at once between their poles; parts that the update doesn't
touch are deflated before (small entries of z, and clusters of equal eigenvalues, which one reflection
reduces to a single entry). Two spectra are combined by as many rank-one updates as the second has
eigenvectors and one more for the distance of the means, 16 to 1 in each round until one is left.

That basis is orthogonalised and refined by a distributed Rayleigh-Ritz step: each partition adds up the
products of its centred vectors in the basis, the sums are combined 16 to 1, and the eigenvectors of the
small matrix turn the basis. As the basis is whole, the result is that of the covariance to double
precision. Means are exact sums over n; all centring is done before multiplying. A last pass over the
fit list takes the covariance of the whitened vectors themselves.

What reaches the driver is one spectrum and three matrices whose sizes are given by the dimensions.

Defined results: rows whose vector is null, or holds null or non-finite entries (or ones that scale
beyond 64 bits), are dropped; shorter vectors count as padded with 0; repeated rows and ids and null ids
stay as they are; with fewer dimensions there are fewer components; a component without variance (one
distinct vector, dependent dimensions) has whitened 0 and takes no part in identity_error; a deviation
beyond 64 bits is null; an empty table, or one with empty vectors only, gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import bounded_batches, drop_path, stored

SCALE, COMPONENTS = 256, 4
#: Partial results combined in one round.
FAN = 16
EPS = np.finfo(np.float64).eps
#: Of the largest eigenvalue: below this a component has no variance.
FLAT = 1e-12


# Rank-one updates


def _roots(d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum weight_j / (d_j - t) = 0 for ascending d and positive weights: for each the
    index of the pole next to it and the distance from that pole."""
    k, total = len(d), weight.sum()
    here = np.arange(k)
    gap = np.append(np.diff(d), total)
    delta = d[None, :] - d[:, None]
    with np.errstate(all="ignore"):
        middle = 1 + (weight / (delta - gap[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (here < k - 1)
    origin = here + right
    delta = d[None, :] - d[origin][:, None]
    low = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    left = here[None, :] <= here[:, None]
    first, second = delta[here, here], delta[here, np.minimum(here + 1, k - 1)]
    at, open_ = (low + high) / 2, np.ones(k, bool)
    for _ in range(100):
        with np.errstate(all="ignore"):
            pull = weight / (delta - at[:, None])
            slope = pull / (delta - at[:, None])
            value = 1 + pull.sum(axis=1)
            size = 1 + np.abs(pull).sum(axis=1)
            low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
            open_ &= (np.abs(value) > 16 * EPS * size) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if not open_.any():
                break
            psi, all_ = (slope * left).sum(axis=1), slope.sum(axis=1)
            a1, a2 = first - at, second - at
            c = value - a1 * psi - a2 * (all_ - psi)
            a, b = (a1 + a2) * value - a1 * a2 * all_, a1 * a2 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has one pole only.
            step[-1] = a1[-1] + a1[-1] ** 2 * all_[-1] / (value[-1] - a1[-1] * all_[-1])
            new = at + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
        at = np.where(open_, new, at)
    return origin, np.where(at == 0, EPS * gap, at)


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of q diag(d) q' + rho v v', for rho of 0 or more."""
    z = v @ q
    total = rho * float(z @ z)
    if not total > 0:
        return d, q
    tolerance = 8 * EPS * max(abs(float(d[0])), abs(float(d[-1])), total)
    close = np.diff(d) <= tolerance
    if close.any():
        q, edges = q.copy(), np.flatnonzero(~close) + 1
        for a, b in zip([0, *edges], [*edges, len(d)], strict=True):
            norm = float(np.linalg.norm(z[a:b]))
            if b - a > 1 and norm > 0:
                u = z[a:b].copy()
                s = np.copysign(norm, u[-1])
                u[-1] += s
                q[:, a:b] -= np.outer(q[:, a:b] @ u, u * (2 / (u @ u)))
                z[a:b] = 0
                z[b - 1] = -s
    live = np.flatnonzero(np.sqrt(rho) * np.abs(z) * np.sqrt(total) > tolerance)
    if not len(live):
        return d, q
    old, k = d[live], len(live)
    origin, distance = _roots(old, rho * z[live] ** 2)
    away = old[None, :] - old[origin][:, None] - distance[:, None]  # d_j - root_i
    here = np.arange(k)
    poles = np.where(here[:, None] < here[None, :], old[:, None], np.append(old[1:], 0)[:, None]) - old[None, :]
    poles[-1] = 1
    # Entries of z for which the roots found are exact, so that the eigenvectors are orthogonal.
    exact = np.copysign(np.sqrt(np.abs(np.prod(-away / poles, axis=0)) / rho), z[live])
    turn = (exact[None, :] / away).T
    turn /= np.linalg.norm(turn, axis=0)
    d, q = d.copy(), q.copy()
    d[live], q[:, live] = old[origin] + distance, q[:, live] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean and the spectrum of the centred scatter of some vectors, and their exact sums."""

    def __init__(self, dims: int):
        self.n, self.mean, self.sums = 0, np.zeros(dims), [0] * dims
        self.d, self.q = np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.d, self.q = rank_one(self.d, self.q, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        n, away = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.d, other.q.T, strict=True):
            self.d, self.q = rank_one(self.d, self.q, vector, max(0.0, float(value)))
        self.d, self.q = rank_one(self.d, self.q, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self, part: int) -> pa.RecordBatch:
        numbers = np.concatenate([[float(self.n)], self.mean, self.d, self.q.ravel()])
        return pa.RecordBatch.from_pydict({"part": [part], "state": [numbers.tobytes()], "sums": [",".join(map(str, self.sums))]})

    @classmethod
    def of(cls, state: bytes, sums: str) -> Spectrum:
        numbers, out = np.frombuffer(state), cls(0)
        out.sums = [int(s) for s in sums.split(",")]
        k = len(out.sums)
        out.n, out.mean, out.d, out.q = int(numbers[0]), numbers[1 : k + 1], numbers[k + 1 : 2 * k + 1], numbers[2 * k + 1 :].reshape(k, k)
        return out


# Distributed steps


def whole_numbers(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """All columns, with the vector as whole numbers `x`; rows with vectors that don't count are dropped."""
    cells = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda c: c * F.lit(float(scale)))
    bad = F.exists("__c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 63)))
    rows = vectors.withColumn("__c", cells).where(F.col("__c").isNotNull() & ~bad)
    return rows.withColumn("x", F.transform("__c", lambda c: F.floor(c).cast("long"))).drop("__c")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out, row = np.zeros((len(sizes), dims), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S: 64-bit integers where they are sure to fit, else Python's."""
    bound = n * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) + max((abs(s) for s in sums), default=0)
    if bound < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _tree(rows: DataFrame, many: int, combine: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """Partial results (`part` from 0 to many - 1, and others), FAN to 1 until one is left."""
    schema = rows.schema
    while many > 1:

        def step(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"part": int(frame["part"].iloc[0]) // FAN} | combine(frame)])

        rows = rows.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(step, schema)
        many = -(-many // FAN)
    return rows


def _per_part(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], schema: str) -> tuple[DataFrame, int]:
    """What `work` yields for each partition, given its number; and the number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from work(batches, TaskContext.get().partitionId())

    bounded_batches(frame.sparkSession)
    return frame.mapInArrow(run, schema), frame.rdd.getNumPartitions()


class Whitening:
    """n, the sums S, the components (columns, the first the strongest), their eigenvalues, the trace, and
    the error of the whitened covariance."""

    def __init__(self, n: int, sums: list[int], basis: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.basis, self.values, self.trace, self.error = n, sums, basis, values, trace, 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whitened vectors, and n x - S."""
        away = _scaled(x, self.n, self.sums)
        flat = self.values <= FLAT * max(self.values.max(initial=0), 0)
        with np.errstate(all="ignore"):
            out = (away.astype(np.float64) / self.n) @ self.basis / np.sqrt(self.values)
        out[:, flat] = 0.0
        return out, away

    @property
    def live(self) -> np.ndarray:
        return self.values > FLAT * max(self.values.max(initial=0), 0)


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows' vectors `x`, each distinct one counted once; None without any."""
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    distinct, path = stored(rows.select(padded.alias("x")).distinct(), "whitening")

    def spectra(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for row in x.astype(np.float64):
                own.add(row)
            own.sums = [a + int(b) for a, b in zip(own.sums, x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 1 << 40 else x.sum(axis=0), strict=True)]
        yield own.row(part)

    def merged(frame: pd.DataFrame) -> dict:
        frame = frame.sort_values("part")
        own = Spectrum.of(frame["state"].iloc[0], frame["sums"].iloc[0])
        for state, sums in zip(frame["state"].iloc[1:], frame["sums"].iloc[1:], strict=True):
            own.merge(Spectrum.of(state, sums))
        out = own.row(0).to_pydict()
        return {"state": out["state"][0], "sums": out["sums"][0]}

    state, sums = _tree(*_per_part(distinct, spectra, "part long, state binary, sums string"), merged).select("state", "sums").first()
    found = Spectrum.of(bytes(state), sums)
    whole = Whitening(found.n, found.sums, np.linalg.qr(found.q)[0], np.ones(dims), 0.0)

    def products(model: Whitening) -> np.ndarray:
        """Mean products, over the fit list, of the vectors that the model makes, less those of their means."""
        sent, k = spark.sparkContext.broadcast(model), model.basis.shape[1]

        def work(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for batch in batches:
                y, _ = sent.value.project(_matrix(batch.column(0), dims))
                total += np.vstack([y.T @ y, y.sum(axis=0)])
            yield pa.RecordBatch.from_pydict({"part": [part], "state": [total.tobytes()]})

        add = lambda frame: {"state": np.sum([np.frombuffer(s) for s in frame.sort_values("part")["state"]], axis=0).tobytes()}
        total = np.frombuffer(_tree(*_per_part(distinct, work, "part long, state binary"), add).first()["state"]).reshape(k + 1, k) / model.n
        return total[:k] - np.outer(total[k], total[k])

    ritz = products(whole)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    best = np.argsort(-values, kind="stable")[:components]
    basis = whole.basis @ turn[:, best]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(best))] < 0, -1.0, 1.0)
    model = Whitening(found.n, found.sums, basis, np.maximum(values[best], 0.0), float(np.trace(ritz)))
    live = model.live
    model.error = float(np.abs((products(model) - np.eye(len(best)))[np.ix_(live, live)]).max(initial=0.0))
    drop_path(spark, path)
    return model


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None, *, id_col: str = "vec_id") -> DataFrame:
    """One row for each vector and component."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *T.StructType.fromDDL(OUT).fields])
    if model is None:
        return spark.createDataFrame([], schema)
    sent, dims, k = spark.sparkContext.broadcast(model), len(model.sums), len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            if many:
                y, away = sent.value.project(_matrix(batch.column(1), dims))
                if away.dtype != object and dims * (int(np.abs(away).max(initial=0)) ** 2) >= 1 << 63:
                    away = away.astype(object)
                square = (away * away).sum(axis=1)
                square = pa.array([v if v < 1 << 63 else None for v in square.tolist()], pa.int64())
                again = np.repeat(np.arange(many), k)
                columns = [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, model_n)), square.take(pa.array(again)), pa.array(y.ravel()), pa.array(np.tile(share, many)), pa.array(np.full(many * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    model_n, error = model.n, model.error
    bounded_batches(spark)
    return rows.select(F.col(f"`{id_col}`"), "x").mapInArrow(run, schema)


def report(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """What the query op12_whitening returns."""
    rows = whole_numbers(vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")), vec_col)
    return whiten(rows, fit(rows), id_col=id_col)
