"""Numpy spectra and time-frequency maps of one signal (or of many, one a row)."""

from __future__ import annotations

import math

import numpy as np

#: Cosine terms of each window, a0 - a1 cos + a2 cos(2) - a3 cos(3).
WINDOW_TERMS = {"rectangular": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168)}
#: Bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "mu": (8.0, 12.0), "smr": (12.0, 15.0), "beta": (12.0, 30.0), "motor_beta": (16.0, 24.0), "gamma": (30.0, 100.0), "low_gamma": (30.0, 50.0), "high_gamma": (50.0, 100.0)}
#: Where the Morlet envelope is cut off.
MORLET_FLOOR, OMEGA0 = 0.000335, 6.0


def window(kind: str, n: int) -> np.ndarray:
    """Symmetric window, never below zero; of length 1: one."""
    if n <= 1:
        return np.ones(n)
    at = 2 * math.pi * np.arange(n) / (n - 1)
    return np.maximum(sum((-1) ** k * a * np.cos(k * at) for k, a in enumerate(WINDOW_TERMS[kind])), 0.0)


def coherent_gain(kind: str, n: int) -> float:
    return float(window(kind, n).mean()) if n else 0.0


def noise_bandwidth(kind: str, n: int) -> float:
    w = window(kind, n)
    return float(n * (w**2).sum() / w.sum() ** 2) if n and w.sum() else 0.0


def one_sided(power: np.ndarray) -> np.ndarray:
    """Doubles all bins but the first and the last."""
    out = np.array(power, float)
    out[..., 1:-1] *= 2
    return out


def power_spectrum(x: np.ndarray) -> np.ndarray:
    return one_sided(np.abs(np.fft.rfft(x)) ** 2)


def band_power(power: np.ndarray, fs: float, low: float, high: float) -> float:
    """Sum of the bins from floor(low / df) to floor(high / df), both included."""
    n = 2 * (len(power) - 1)
    a, b = int(low * n // fs), min(int(high * n // fs), n // 2)
    return float(power[a : b + 1].sum()) if a <= b else 0.0


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.asarray(x, float)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size))


def density(segments: np.ndarray, fs: float, kind: str) -> np.ndarray:
    """One-sided power spectral density of each segment."""
    w = window(kind, segments.shape[-1])
    return one_sided(np.abs(np.fft.rfft(segments * w)) ** 2) / (fs * (w**2).sum())


def welch(x: np.ndarray, fs: float, size: int, overlap: float = 0.5, kind: str = "hann") -> np.ndarray:
    """Mean density of overlapping segments, no detrending; empty where the signal is shorter than a segment."""
    parts = frames(x, size, size - int(size * overlap))
    return density(parts, fs, kind).mean(axis=0) if len(parts) else np.zeros(0)


def frequencies(size: int, fs: float) -> np.ndarray:
    return np.arange(size // 2 + 1) * fs / size


def stft(x: np.ndarray, size: int, hop: int | None = None, kind: str = "hann") -> np.ndarray:
    """Frames x all bins, complex."""
    return np.fft.fft(frames(x, size, hop or size // 2) * window(kind, size))


def integrate_band(psd: np.ndarray, df: float, low: float, high: float, rule: str = "trapezoid") -> float:
    """Bins floor(low / df) to ceil(high / df): trapezoids, or rectangles of those below high."""
    a, b = int(math.floor(low / df)), min(int(math.ceil(high / df)), len(psd) - 1)
    if a >= len(psd) or a > b:
        return 0.0
    if rule == "rectangle":
        return float(psd[a:b].sum() * df)
    return float(((psd[a:b] + psd[a + 1 : b + 1]) / 2).sum() * df)


def analytic(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def instantaneous_frequency(x: np.ndarray, fs: float) -> np.ndarray:
    step = np.diff(np.angle(analytic(x)))
    return (step - 2 * math.pi * (step > math.pi) + 2 * math.pi * (step < -math.pi)) * fs / (2 * math.pi)


def scales(low: float, high: float, count: int, omega0: float = OMEGA0) -> np.ndarray:
    """Log-spaced, from the scale of the lowest frequency to that of the highest."""
    a, b = omega0 / (2 * math.pi * low), omega0 / (2 * math.pi * high)
    return a * (b / a) ** (np.arange(count) / max(1, count - 1))


def half_width(scale: float, fs: float) -> int:
    return max(1, int(math.sqrt(-2 * math.log(MORLET_FLOOR)) * scale * fs))


def morlet(scale: float, fs: float, omega0: float = OMEGA0) -> np.ndarray:
    k = half_width(scale, fs)
    t = np.arange(-k, k + 1) / (fs * scale)
    return np.exp(-t * t / 2 + 1j * omega0 * t) / math.sqrt(scale)


def cwt(x: np.ndarray, fs: float, scale: float, omega0: float = OMEGA0) -> np.ndarray:
    """Correlation with the cut wavelet, zeros outside the signal."""
    w = morlet(scale, fs, omega0)
    k = len(w) // 2
    padded = np.concatenate([np.zeros(k), np.asarray(x, float), np.zeros(k)])
    return np.convolve(padded, np.conj(w)[::-1], "valid")


def cross_spectra(a: np.ndarray, b: np.ndarray, size: int, overlap: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Summed Sxx, Syy, Sxy over segments, and their number."""
    hop = max(1, size - int(size * overlap))
    w = window(kind, size)
    x, y = (np.fft.rfft(frames(s, size, hop) * w) for s in (a, b))
    return (np.abs(x) ** 2).sum(axis=0), (np.abs(y) ** 2).sum(axis=0), (x * np.conj(y)).sum(axis=0), len(x)


def coherence(a: np.ndarray, b: np.ndarray, size: int, overlap: float = 0.5, kind: str = "hann") -> np.ndarray:
    """|Sxy|^2 / (Sxx Syy) of averaged segments, zero where there is no power; one segment gives ones."""
    sx, sy, sxy, n = cross_spectra(a, b, size, overlap, kind)
    if not n:
        return np.zeros(0)
    below = sx * sy / n**2
    return np.where(below > 1e-20, np.minimum(np.abs(sxy / n) ** 2 / np.maximum(below, 1e-300), 1.0), 0.0)


def modulation_index(phase: np.ndarray, amplitude: np.ndarray, bins: int) -> float:
    """Divergence of the mean amplitude over phase bins from uniform, over ln(bins)."""
    at = np.clip(((np.asarray(phase) + math.pi) / (2 * math.pi) * bins).astype(int), 0, bins - 1)
    count = np.bincount(at, minlength=bins)
    mean = np.bincount(at, amplitude, bins) / np.maximum(count, 1)
    if mean.sum() <= 1e-12:
        return 0.0
    p = mean / mean.sum()
    return float(np.clip((p * np.log(np.maximum(p, 1e-12) * bins)).sum() / math.log(bins), 0, 1))


def mean_vector_length(phase: np.ndarray, amplitude: np.ndarray) -> float:
    mean = float(np.mean(amplitude)) if len(amplitude) else 0.0
    return 0.0 if mean <= 1e-12 else min(1.0, float(np.abs(np.mean(amplitude * np.exp(1j * np.asarray(phase))))) / mean)


def xcorr(x: np.ndarray, y: np.ndarray, norm: str = "none") -> np.ndarray:
    """Sum of x[n] y[n + lag] for lags from -(len(y) - 1) on, len(x) + len(y) - 1 of them."""
    n, m = len(x), len(y)
    lags = np.arange(n + m - 1) - (m - 1)
    full = np.correlate(np.asarray(y, float), np.asarray(x, float), "full")  # lags from -(n - 1)
    out = np.where((lags + n - 1 >= 0) & (lags + n - 1 < n + m - 1), full[np.clip(lags + n - 1, 0, n + m - 2)], 0.0)
    if norm == "biased":
        return out / max(n, m)
    if norm == "unbiased":
        count = np.maximum(np.minimum(n, m - lags) - np.maximum(0, -lags), 0)
        return np.where(count > 0, out / np.maximum(count, 1), 0.0)
    if norm == "coeff":
        energy = math.sqrt(float(np.dot(x, x)) * float(np.dot(y, y)))
        return out / energy if energy > 1e-20 else np.zeros_like(out)
    return out
