"""Models fitted from distributed sums: the data stay in Spark, the driver sees matrices of the size of the channels.

``x`` is an array column of one length. Fitted models are small numpy objects; applying one is an array expression or an
Arrow kernel. Order-dependent models (tracks, online clusters) run per group in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sigloom.functions import linear
from sigloom.operators.signals import of_arrays, per_group
from sigloom.operators.spatial import apply_matrix, covariance_matrix
from sigloom.operators.sums import added, moments_by, rows_of, summed, summed_by, whole_rows
from sigloom.operators.temporal import KEYS
from sigloom.sources.shared import removed, written


# Principal components, independent components -------------------------------------------------------


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.total if self.total > 0 else np.zeros_like(self.values)

    def transform(self, df: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
        centred = F.zip_with(x, F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, m: a - m)
        return apply_matrix(df.withColumn("_c", centred), self.components, "_c", out).drop("_c")


def fit_pca(df: DataFrame, k: int, x: str = "x") -> Pca:
    mean, cov, _ = covariance_matrix(df, x)
    values, vectors = linear.eigen_symmetric(cov)
    return Pca(mean, vectors[:, :k].T, values[:k], float(values.sum()))


@dataclass
class Ica:
    mean: np.ndarray
    unmixing: np.ndarray
    converged: bool
    rounds: int

    def transform(self, df: DataFrame, x: str = "x", out: str = "sources") -> DataFrame:
        centred = F.zip_with(x, F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, m: a - m)
        return apply_matrix(df.withColumn("_c", centred), self.unmixing, "_c", out).drop("_c")

    def inverse(self, df: DataFrame, sources: str = "sources", out: str = "x") -> DataFrame:
        back = apply_matrix(df, np.linalg.inv(self.unmixing), sources, "_b")
        return back.withColumn(out, F.zip_with("_b", F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, m: a + m)).drop("_b")

    def without(self, df: DataFrame, exclude: list[int], x: str = "x") -> DataFrame:
        keep = np.diag([0.0 if k in exclude else 1.0 for k in range(len(self.mean))])
        clean = np.linalg.inv(self.unmixing) @ keep @ self.unmixing
        centred = F.zip_with(x, F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, m: a - m)
        back = apply_matrix(df.withColumn("_c", centred), clean, "_c", "_b").drop("_c")
        return back.withColumn(x, F.zip_with("_b", F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, m: a + m)).drop("_b")


def fit_ica(df: DataFrame, contrast: str = "logcosh", most: int = 200, tolerance: float = 1e-4, x: str = "x") -> Ica:
    """FastICA with symmetric decorrelation from the identity; one aggregation a round. Not converged: the last result, flagged."""
    mean, cov, n = covariance_matrix(df, x)
    white = linear.whitening(cov * (n - 1) / n + 1e-8 * np.eye(len(cov)), 0.0, "pca")
    g, slope = linear.CONTRASTS[contrast]
    w, converged, k = np.eye(len(mean)), False, 0
    for k in range(1, most + 1):

        def part(rows: np.ndarray, w=w) -> np.ndarray:
            z = (rows - mean) @ white.T
            u = z @ w.T
            return np.concatenate([(g(u).T @ z).reshape(-1), slope(u).sum(axis=0)])

        s = summed(df, part, x) / n
        c = len(mean)
        new = linear.decorrelate(s[: c * c].reshape(c, c) - s[c * c :, None] * w)
        gap = float(np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1)))
        w = new
        if gap < tolerance:
            converged = True
            break
    return Ica(mean, w @ white, converged, k)


# Spatial filters ------------------------------------------------------------------------------------


def class_covariances(df: DataFrame, label: str = "label", x: str = "x") -> dict:
    """class -> (mean, covariance, frames), of all classes in one pass."""
    return moments_by(df, label, x)


def fit_csp(df: DataFrame, filters: int = 4, ridge: float = 1e-6, label: str = "label", x: str = "x", least: int = 0) -> np.ndarray:
    """Filters (rows) of two classes; fewer frames than ``least`` in a class are an error."""
    (_, a, n), (_, b, m) = class_covariances(df, label, x).values()
    if min(n, m) < least:
        raise ValueError("too few samples")
    return linear.csp_filters(a, b, filters, ridge)


def fit_multiclass_csp(df: DataFrame, filters: int = 4, ridge: float = 1e-6, label: str = "label", x: str = "x") -> np.ndarray:
    """One class against the sum of the others' covariances, for each class in turn."""
    covs = {k: c for k, (_, c, _) in class_covariances(df, label, x).items()}
    return np.concatenate([linear.csp_filters(c, sum(o for j, o in covs.items() if j != k), filters, ridge) for k, c in covs.items()])


@dataclass
class AdaptiveCsp:
    """Covariances of two classes from frames as they come; filters anew every ``interval`` frames once both have enough."""

    channels: int
    filters: int = 4
    least: int = 100
    interval: int = 0
    ridge: float = 1e-6
    matrix: np.ndarray | None = None
    sums: list = field(default_factory=lambda: [[0, None, None], [0, None, None]])

    def update(self, frames: np.ndarray, label: int) -> None:
        s = self.sums[label]
        before = s[0]
        s[1] = frames.sum(axis=0) if s[1] is None else s[1] + frames.sum(axis=0)
        s[2] = frames.T @ frames if s[2] is None else s[2] + frames.T @ frames
        s[0] += len(frames)
        if self.interval and s[0] // self.interval > before // self.interval:
            try:
                self.refit()
            except (ValueError, np.linalg.LinAlgError):
                pass  # an automatic update that fails keeps the filters

    def covariance(self, label: int) -> np.ndarray:
        n, s, q = self.sums[label]
        return (q - np.outer(s, s) / n) / (n - 1)

    def refit(self) -> np.ndarray:
        if min(s[0] for s in self.sums) < max(2, self.least):
            raise ValueError("too few samples")
        self.matrix = linear.csp_filters(self.covariance(0), self.covariance(1), self.filters, self.ridge)
        return self.matrix


def csp_features(df: DataFrame, filters: np.ndarray, trial: list[str], x: str = "x") -> DataFrame:
    """(trial, features): ln(population variance + 1e-10) of each filtered component over a trial's frames."""
    wide = apply_matrix(df, filters, x, "_y")
    return wide.groupBy(*trial).agg(F.array(*(F.ln(F.var_pop(F.get("_y", F.lit(k))) + 1e-10) for k in range(len(filters)))).alias("features"))


def fit_xdawn(df: DataFrame, filters: int = 2, ridge: float = 1e-6, label: str = "label", t: str = "t", x: str = "x") -> np.ndarray:
    """Filters of the evoked response of class 1 against the covariance of all frames."""
    c = len(df.select(x).first()[0])
    target = df.where(F.col(label) == 1).groupBy(t).agg(F.array(*(F.avg(F.get(x, F.lit(k))) for k in range(c))).alias("m")).orderBy(t)
    evoked = np.array([r["m"] for r in target.collect()])  # the samples of one epoch
    return linear.xdawn_filters(evoked, covariance_matrix(df, x)[1], filters, ridge)


# Discriminants --------------------------------------------------------------------------------------


@dataclass
class Lda:
    weights: np.ndarray
    threshold: float
    sigma: float

    def predict(self, df: DataFrame, x: str = "x") -> DataFrame:
        """``decision`` (at or above 0: class 0), ``predicted`` and ``proba``, the probability of class 0."""
        score = apply_matrix(df, self.weights[None, :], x, "_s")
        out = score.withColumn("decision", F.get("_s", F.lit(0)) - self.threshold).drop("_s")
        return out.withColumn("predicted", F.when(F.col("decision") >= 0, 0).otherwise(1)).withColumn("proba", 1 / (1 + F.exp(-F.col("decision") / self.sigma)))


def fit_lda(df: DataFrame, shrinkage: float = 0.01, label: str = "label", x: str = "x") -> Lda:
    """Two classes 0 and 1 from one aggregation each."""
    found = class_covariances(df, label, x)
    if len(found) != 2:
        raise ValueError("two classes are needed")
    means, covs, counts = zip(*found.values())
    scatter = sum(c * (n - 1) for c, n in zip(covs, counts))
    return Lda(*linear.lda(np.array(means), scatter, np.array(counts), shrinkage))


# SPD matrices ---------------------------------------------------------------------------------------


def trial_covariances(df: DataFrame, trial: list[str], x: str = "x") -> DataFrame:
    """(trial, n, m array of n * n): covariance of each trial's frames."""
    c = len(df.select(x).first()[0])
    cells = [F.covar_samp(F.get(x, F.lit(min(i, j))), F.get(x, F.lit(max(i, j)))) for i in range(c) for j in range(c)]
    return df.groupBy(*trial).agg(F.array(*cells).alias("m")).withColumn("n", F.lit(c))


def _matrices(rows: np.ndarray) -> np.ndarray:
    n = math.isqrt(rows.shape[1])
    return rows.reshape(-1, n, n)


def frechet_means(df: DataFrame, label: str, m: str = "m", most: int = 50, tolerance: float = 1e-8) -> dict:
    """class -> Riemannian mean of its matrices. They are written once, and each round sums the logarithms of all classes in one pass."""
    spd = written(df.select(label, m))
    first = summed_by(spd, label, lambda r, _: np.r_[len(r), r.sum(axis=0)], m)
    n = {k: s[0] for k, s in first.items()}
    mean = {k: _matrices(s[None, 1:] / s[0])[0] for k, s in first.items()}
    best, rate, last = dict(mean), dict.fromkeys(mean, 1.0), dict.fromkeys(mean, math.inf)
    for _ in range(most):
        if not mean:
            break
        inverse = {k: linear.matrix_inv_sqrt(v) for k, v in mean.items()}
        moving = spd.where(F.col(label).isin(*mean)) if len(mean) < len(n) else spd
        sums = summed_by(moving, label, lambda r, k, i=inverse: linear.matrix_log(i[k] @ _matrices(r) @ i[k]).sum(axis=0), m)
        for k in list(mean):
            logs = _matrices(sums[k][None, :] / n[k])[0]
            size = float(np.linalg.norm(logs))
            if size < last[k]:
                best[k], rate[k], last[k] = mean[k], rate[k] * 0.95, size
            else:
                rate[k] *= 0.5
            if size <= tolerance:
                del mean[k]  # this class stands still
            else:
                mean[k] = linear.frechet_step(mean[k], logs, rate[k])
    removed(spd)
    return best


def frechet_mean(df: DataFrame, m: str = "m", most: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """The Riemannian mean of all matrices."""
    return frechet_means(df.select(F.lit(0).alias("label"), m), "label", m, most, tolerance)[0]


def tangent_vectors(df: DataFrame, reference: np.ndarray, m: str = "m", out: str = "features") -> DataFrame:
    return of_arrays(df, lambda r: np.stack([linear.tangent(p, reference) for p in _matrices(r)]), m, out)


def recentered(df: DataFrame, mean: np.ndarray, m: str = "m", out: str = "m2") -> DataFrame:
    i = linear.matrix_inv_sqrt(mean)
    return of_arrays(df, lambda r: (i @ _matrices(r) @ i).reshape(len(r), -1), m, out)


@dataclass
class Mdm:
    labels: list
    means: list

    def predict(self, df: DataFrame, m: str = "m") -> DataFrame:
        """(keys, predicted, distance): the class whose mean is nearest."""
        found = of_arrays(df, lambda r: np.array([linear.mdm(p, self.means) for p in _matrices(r)]), m, "_d")
        names = F.array(*(F.lit(k) for k in self.labels))
        return found.withColumn("predicted", F.get(names, F.get("_d", F.lit(0)).cast("int"))).withColumn("distance", F.get("_d", F.lit(1))).drop("_d")


def fit_mdm(df: DataFrame, label: str = "label", m: str = "m") -> Mdm:
    means = frechet_means(df, label, m)
    return Mdm(list(means), list(means.values()))


# Correlation of trials ------------------------------------------------------------------------------


def ssvep(df: DataFrame, trial: str, fs: float, frequencies: list[float], harmonics: int = 2, ridge: float = 1e-6) -> DataFrame:
    """(trial, frequency, correlation): the stimulus whose references correlate most, the first of equals. Rows: trial, t (samples from 0), x.

    Canonical correlations need sums only: of products of channels and references, per trial. They are added up in one pass for all
    trials and frequencies, a trial may be any number of tasks' rows, and the correlations come from a matrix a trial. Samples count
    from their trial's first, so that a channel that never moves has no variance at all and rounding decides nothing.
    """
    one = df.where(F.col("x").isNotNull()).select(F.size("x").alias("n")).first()
    channels, references = one["n"] if one else 1, 2 * harmonics
    clean = df.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double"))))
    firsts = clean.groupBy(trial).agg(F.min_by(F.col("x").cast("array<double>"), "t").alias("_first"))
    kind = df.schema[trial]

    def gather(batches):
        for b in batches:
            x, at = whole_rows(b.column(2))
            if not len(x):
                continue
            t = b.column(1).to_numpy(zero_copy_only=False)[at]
            angle = 2 * math.pi * t[:, None] / fs * (np.array(frequencies)[:, None] * np.arange(1, harmonics + 1)).reshape(-1)
            waves = np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(t), -1)
            z = np.concatenate([np.ones((len(t), 1)), x - rows_of(b.column(3).take(pa.array(at))), waves], axis=1)
            codes = b.column(0).dictionary_encode()
            index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at]
            names = np.unique(index[index >= 0])
            sums = [(z[index == c].T @ z[index == c]).reshape(-1).tolist() for c in names.tolist()]
            if sums:
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(names)), pa.array(sums, pa.list_(pa.float64()))], names=[trial, "m"])

    def decide(batches):
        for b in batches:
            found = []
            for m in b.column(1).to_pylist():
                m = np.array(m).reshape(1 + channels + references * len(frequencies), -1)
                n = m[0, 0]
                cov = (m - np.outer(m[0], m[0]) / n)[1:, 1:] / max(1.0, n - 1)
                scores = []
                for k in range(len(frequencies)):
                    own = slice(channels + k * references, channels + (k + 1) * references)
                    try:
                        scores.append(float(linear.canonical(cov[:channels, :channels], cov[own, own], cov[:channels, own], ridge)[0]))
                    except np.linalg.LinAlgError:
                        scores.append(-1.0)
                best = int(np.argmax(scores))
                found.append((frequencies[best], scores[best]))
            f, r = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.float64()), pa.array(r, pa.float64())], names=[trial, "frequency", "correlation"])

    fields = lambda *more: StructType([kind, *more])
    rows = clean.join(firsts, trial).select(trial, F.col("t").cast("double").alias("t"), F.col("x").cast("array<double>").alias("x"), "_first")
    sums = rows.mapInArrow(gather, fields(StructField("m", ArrayType(DoubleType()))))
    return added(sums, [trial]).mapInArrow(decide, fields(StructField("frequency", DoubleType()), StructField("correlation", DoubleType())))


def kalman(df: DataFrame, track: str, f, h, q, r, x0, p0) -> DataFrame:
    """(track, t, state, covariance, innovation) of observations (track, t, z)."""

    def run(table: pa.Table) -> dict:
        one, out = linear.Kalman(f, h, q, r, x0, p0), []
        for z in table["z"].to_pylist():
            s, p, i = one.step(np.array(z, float))
            out.append((s, p.reshape(-1), i))
        return {"t": table["t"].combine_chunks(), **dict(zip(("state", "covariance", "innovation"), map(list, zip(*out))))}

    return per_group(df.select(track, "t", "z"), [track], run, "t long, state array<double>, covariance array<double>, innovation array<double>", "t")


def monopoles(df: DataFrame, keys: list[str], z: float, rounds: int = 50) -> DataFrame:
    """(keys, x, y): a source at depth z whose potential falls with distance; positive amplitudes only. Rows: keys, x, y, amplitude."""

    def run(t: pa.Table) -> dict:
        a, px, py = (t[c].to_numpy() for c in ("amplitude", "x", "y"))
        use = a > 0
        if not use.any():
            return {"sx": [None], "sy": [None]}
        a, px, py = a[use], px[use], py[use]
        at = np.array([(a * px).sum(), (a * py).sum()]) / a.sum()

        def error(p: np.ndarray) -> tuple[float, np.ndarray]:
            dx, dy = p[0] - px, p[1] - py
            b = 1 / np.sqrt(dx * dx + dy * dy + z * z)
            alpha = (a @ b) / (b @ b)
            rest = a - alpha * b
            return float(rest @ rest), 2 * alpha * np.array([(rest * b**3 * dx).sum(), (rest * b**3 * dy).sum()])

        step = max(1.0, z)
        for _ in range(rounds):
            e, grad = error(at)
            size = np.linalg.norm(grad)
            if size < 1e-12:
                break
            for _ in range(10):
                new = at - step * grad / size
                if error(new)[0] < e:
                    at = new
                    break
                step /= 2
        return {"sx": [float(at[0])], "sy": [float(at[1])]}

    return per_group(df.select(*keys, "channel", "x", "y", "amplitude"), keys, run, "sx double, sy double", "channel")


# Clusters -------------------------------------------------------------------------------------------


@dataclass
class OnlineKMeans:
    """Nearest centroid, a new one beyond ``threshold`` while there is room; the mean moves by 1 / min(count + 1, most)."""

    threshold: float
    most: int = 1000
    room: int = 32
    centroids: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def assign(self, v: np.ndarray) -> tuple[int, float, bool]:
        if self.centroids:
            d = np.sqrt(((np.array(self.centroids) - v) ** 2).sum(axis=1))
            k = int(np.argmin(d))
            if d[k] <= self.threshold or len(self.centroids) >= self.room:
                self.centroids[k] = self.centroids[k] + (v - self.centroids[k]) / min(self.counts[k] + 1, self.most)
                self.counts[k] += 1
                return k, float(d[k]), False
        self.centroids.append(np.array(v, float))
        self.counts.append(1)
        return len(self.centroids) - 1, 0.0, True

    def merge_closest(self, limit: float) -> tuple[int, int] | None:
        """The closest pair at most ``limit`` apart becomes one, weighted by counts."""
        c = np.array(self.centroids)
        if len(c) < 2:
            return None
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.where(np.tri(len(c)), np.inf, 0)
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > limit:
            return None
        n, m = self.counts[i], self.counts[j]
        self.centroids[i] = (n * c[i] + m * c[j]) / (n + m)
        self.counts[i] = n + m
        self.remove(int(j))
        return int(i), int(j)

    def remove(self, k: int) -> None:
        del self.centroids[k], self.counts[k]


def farthest_seeds(x: np.ndarray, k: int) -> np.ndarray:
    """The point of the largest norm, then those farthest from all before."""
    chosen = [int(np.argmax((x**2).sum(axis=1)))] if len(x) else []
    near = np.full(len(x), np.inf)
    while 0 < len(chosen) < min(k, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        chosen.append(far)
    return x[chosen]


def projection_seeds(x: np.ndarray, k: int, steps: int = 50) -> np.ndarray:
    """Means of equal-width bins along the first singular direction."""
    c = x - x.mean(axis=0)
    v = np.ones(x.shape[1])
    for _ in range(steps):
        v = c.T @ (c @ v)
        size = np.linalg.norm(v)
        if size < 1e-12:
            return x.mean(axis=0)[None, :]
        v /= size
    p = c @ v
    at = np.minimum(((p - p.min()) / max(p.max() - p.min(), 1e-12) * k).astype(int), k - 1)
    return np.array([x[at == b].mean(axis=0) for b in range(k) if (at == b).any()])


def online_clusters(df: DataFrame, keys: list[str], order: str, threshold: float, most: int = 1000, room: int = 32, x: str = "x") -> DataFrame:
    """(keys, order, cluster, distance, created) of points in order of arrival."""

    def run(t: pa.Table) -> dict:
        model = OnlineKMeans(threshold, most, room)
        got = [model.assign(v) for v in rows_of(t["x"].combine_chunks())]
        return {"seq": t["seq"].combine_chunks(), **dict(zip(("cluster", "distance", "created"), map(list, zip(*got))))}

    return per_group(df.select(*keys, F.col(order).cast("long").alias("seq"), F.col(x).alias("x")), keys, run, "seq long, cluster int, distance double, created boolean", "seq")


@dataclass
class Gmm:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float
    n: int

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs)):
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (x - m).T)
            out[:, k] = math.log(max(w, 1e-300)) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + (y * y).sum(axis=0)) - np.log(np.diag(low)).sum()
        return out

    @property
    def bic(self) -> float:
        k, d = self.means.shape
        return (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(self.n) - 2 * self.log_likelihood

    def predict(self, df: DataFrame, x: str = "x") -> DataFrame:
        return of_arrays(df, lambda r: self.log_prob(r).argmax(axis=1)[:, None], x, "_k").withColumn("component", F.get("_k", F.lit(0)).cast("int")).drop("_k")


def fit_gmm(df: DataFrame, centroids: np.ndarray, ridge: float = 1e-6, most: int = 50, x: str = "x") -> Gmm:
    """EM with full covariances from given centroids; one aggregation a round, until the mean log-likelihood stands still.

    The vectors alone are written once, as a table that all rounds read.
    """
    k, d = centroids.shape
    points = written(df.select(x))
    _, cov, n = covariance_matrix(points, x)
    model = Gmm(np.full(k, 1 / k), centroids, np.repeat((cov + ridge * np.eye(d))[None], k, axis=0), -math.inf, n)
    for _ in range(most):

        def part(rows: np.ndarray, model=model) -> np.ndarray:
            lp = model.log_prob(rows)
            top = lp.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(lp - top).sum(axis=1))
            r = np.exp(lp - norm[:, None])
            return np.concatenate([[norm.sum()], r.sum(axis=0), (r.T @ rows).reshape(-1), np.einsum("nk,ni,nj->kij", r, rows, rows).reshape(-1)])

        s = summed(points, part, x)
        held = np.maximum(s[1 : 1 + k], 1e-12)
        means = s[1 + k : 1 + k + k * d].reshape(k, d) / held[:, None]
        covs = s[1 + k + k * d :].reshape(k, d, d) / held[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(d)
        still = abs(s[0] - model.log_likelihood) / n < 1e-6
        model = Gmm(held / n, means, covs, float(s[0]), n)
        if still:
            break
    removed(points)
    return model


# Estimators with fit and transform ------------------------------------------------------------------


class CspTransformer:
    def __init__(self, filters: int = 4, min_samples: int = 100, regularization: float = 1e-6):
        self.filters, self.least, self.ridge = filters, min_samples, regularization

    def fit(self, epochs: DataFrame) -> CspTransformer:
        self.matrix = fit_csp(epochs, self.filters, self.ridge, least=self.least)
        return self

    def transform(self, epochs: DataFrame) -> DataFrame:
        return csp_features(epochs, self.matrix, ["trial_id"])


class TangentSpaceTransformer:
    """Vectors at the arithmetic mean of the matrices seen in ``fit``."""

    def fit(self, spd: DataFrame) -> TangentSpaceTransformer:
        self.reference = _matrices(summed(spd, lambda r: r.sum(axis=0), "m")[None, :] / spd.count())[0]
        return self

    def transform(self, spd: DataFrame) -> DataFrame:
        return tangent_vectors(spd, self.reference)


class XDawnTransformer:
    def __init__(self, filters: int = 2, regularization: float = 1e-6):
        self.filters, self.ridge = filters, regularization

    def fit(self, epochs: DataFrame) -> XDawnTransformer:
        self.matrix = fit_xdawn(epochs, self.filters, self.ridge)
        return self

    def transform(self, epochs: DataFrame) -> DataFrame:
        return apply_matrix(epochs, self.matrix)


class IcaTransformer:
    def __init__(self, contrast: str = "logcosh", max_iter: int = 200, tolerance: float = 1e-4, exclude: list[int] | None = None):
        self.options, self.exclude = (contrast, max_iter, tolerance), exclude

    def fit(self, frames: DataFrame) -> IcaTransformer:
        self.model = fit_ica(frames, *self.options)
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return self.model.without(frames, self.exclude) if self.exclude else self.model.transform(frames)


def epochs_of(samples: DataFrame, onsets: DataFrame, before: int, length: int) -> DataFrame:
    """(trial_id, label, t, channel, value): samples around each onset. ``onsets``: trial_id, label, recording_id, sample."""
    from sigloom.plans.joins import band_join

    left = onsets.select("trial_id", "label", "recording_id", F.col("sample").cast("double").alias("sample"))
    right = samples.select(*KEYS, F.col("sample_idx").cast("double").alias("at"), "value")
    hit = band_join(left, right, ["recording_id"], "sample", "at", before, length - before - 1)
    return hit.select("trial_id", "label", (F.col("at") - F.col("sample") + before).cast("int").alias("t"), "channel", "value")
