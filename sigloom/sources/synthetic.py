"""Signals to try things on: test waves, and recordings of known units, made block by block from seeds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a template, and of a block of noise.
WIDTH, BLOCK = 61, 30_000


def _wave(spark: SparkSession, n: int, value) -> DataFrame:
    return spark.range(n).select(F.lit(0).cast("long").alias("recording_id"), F.lit(0).cast("long").alias("channel"), F.col("id").alias("sample_idx"), value.cast("double").alias("value"))


def sine(spark: SparkSession, n: int, fs: float, frequency: float, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    return _wave(spark, n, amplitude * F.sin(2 * math.pi * frequency * F.col("id") / fs + phase))


def white_noise(spark: SparkSession, n: int, amplitude: float, seed: int) -> DataFrame:
    """Uniform in +-amplitude, by a hash of seed and sample (the same for any partitioning)."""
    return _wave(spark, n, amplitude * (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 24)) / float(1 << 23) - 1))


def chirp(spark: SparkSession, n: int, fs: float, start: float, end: float, amplitude: float = 1.0) -> DataFrame:
    t, span = F.col("id") / fs, n / fs
    return _wave(spark, n, amplitude * F.sin(2 * math.pi * (start * t + (end - start) / (2 * span) * t * t)))


def impulses(spark: SparkSession, n: int, fs: float, rate: float, amplitude: float = 1.0) -> DataFrame:
    return _wave(spark, n, F.when(F.col("id") % max(1, int(fs / rate)) == 0, amplitude).otherwise(0.0))


def composite(spark: SparkSession, n: int, fs: float, parts: list[tuple[float, float]], noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Sines (frequency, amplitude) and uniform noise."""
    value = sum((a * F.sin(2 * math.pi * f * F.col("id") / fs) for f, a in parts), F.lit(0.0))
    return _wave(spark, n, value + noise * (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 24)) / float(1 << 23) - 1))


def step(spark: SparkSession, n: int, at: int, low: float, high: float) -> DataFrame:
    return _wave(spark, n, F.when(F.col("id") < at, low).otherwise(high))


def templates(units: int, channels: int, seed: int = 42, width: int = WIDTH) -> np.ndarray:
    """units x width x channels: a trough and a later peak, falling off exponentially from the unit's own channel."""
    rng = np.random.default_rng(seed)
    t, out = np.arange(width, dtype=float), np.zeros((units, width, channels))
    for u in range(units):
        centre, sigma, ratio = width // 3, rng.uniform(2.0, 5.0), rng.uniform(0.2, 0.5)
        shape = -np.exp(-0.5 * ((t - centre) / sigma) ** 2) + ratio * np.exp(-0.5 * ((t - centre - 3 * sigma) / (1.5 * sigma)) ** 2)
        home = int(round((u + 0.5) * channels / units)) % channels
        out[u] = np.outer(shape / np.abs(shape).max() * rng.uniform(3.0, 10.0), np.exp(-np.abs(np.arange(channels) - home) / rng.uniform(1.5, 4.0)))
    return out


def spike_times(units: int, n: int, fs: float, rate: float, refractory_ms: float = 1.0, seed: int = 42, width: int = WIDTH) -> list[np.ndarray]:
    """Samples of each unit's spikes: exponential intervals, none below the refractory time."""
    out = []
    for u in range(units):
        rng = np.random.default_rng((seed, u))
        gaps = np.maximum(rng.exponential(fs / rate, int(2 * n * rate / fs) + 20), refractory_ms * fs / 1000)
        at = np.cumsum(gaps).astype(np.int64)
        out.append(at[at < n - width])
    return out


def frames(n_channels: int, start: int, end: int, shapes: np.ndarray, times: list[np.ndarray], noise: float, seed: int, drift: float = 0.0, total: int = 1) -> np.ndarray:
    """Samples [start, end): noise by blocks of their own seeds, and every spike that reaches in. ``drift``: channels moved over the recording."""
    first = start // BLOCK
    parts = [np.random.default_rng((seed, 7, b)).standard_normal((BLOCK, n_channels)) for b in range(first, -(-end // BLOCK))]
    x = np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK] * noise
    width = shapes.shape[1]
    for shape, at in zip(shapes, times):
        for s in at[np.searchsorted(at, start - width) : np.searchsorted(at, end)].tolist():
            a, b = max(s, start), min(s + width, end)
            if a < b:
                w = shape
                if drift:
                    to = np.arange(n_channels) - drift * s / total
                    low = np.clip(np.floor(to).astype(int), 0, n_channels - 1)
                    high, part = np.clip(low + 1, 0, n_channels - 1), np.clip(to - low, 0, 1)
                    w = shape[:, low] * (1 - part) + shape[:, high] * part
                x[a - start : b - start] += w[a - s : b - s] * noise
    return x


def recording(spark: SparkSession, channels: int = 32, seconds: float = 60.0, fs: float = 30_000.0, units: int = 5, rate: float = 5.0, noise: float = 1.0, refractory_ms: float = 1.0, seed: int = 42, drift_um: float = 0.0, pitch_um: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """(frames, truth): (recording_id, sample_idx, x) made in blocks by the tasks that hold them, and (unit, sample) of all spikes."""
    n = int(seconds * fs)
    shapes, times = templates(units, channels, seed), spike_times(units, n, fs, rate, refractory_ms, seed)
    blocks = -(-n // BLOCK)

    def make(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                a, e = k * BLOCK, min((k + 1) * BLOCK, n)
                x = frames(channels, a, e, shapes, times, noise, seed, drift_um / pitch_um, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(e - a + 1) * channels, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(e - a, np.int64)), pa.array(np.arange(a, e)), lists], names=["recording_id", "sample_idx", "x"])

    table = spark.range(0, blocks, 1, min(blocks, 200)).mapInArrow(make, "recording_id long, sample_idx long, x array<double>")
    truth = pa.table({"unit": np.concatenate([np.full(len(t), u, np.int32) for u, t in enumerate(times)]), "sample": np.concatenate(times)})
    return table, spark.createDataFrame(truth)
