"""Filter coefficients, computed when a plan is built. A section is (b0, b1, b2, a1, a2) with a0 = 1."""

from __future__ import annotations

import cmath
import math

Section = tuple[float, float, float, float, float]


def _section(b: tuple[float, float, float], a0: float, a1: float, a2: float) -> Section:
    return b[0] / a0, b[1] / a0, b[2] / a0, a1 / a0, a2 / a0


def _pass(fs: float, cutoff: float, alpha_of, high: bool) -> Section:
    w = 2 * math.pi * cutoff / fs
    c, alpha = math.cos(w), alpha_of(math.sin(w))
    edge = (1 + c) / 2 if high else (1 - c) / 2
    return _section((edge, -2 * edge if high else 2 * edge, edge), 1 + alpha, -2 * c, 1 - alpha)


def lowpass(fs: float, cutoff: float) -> Section:
    """One section with alpha = sin(w) / (2 sqrt 2)."""
    return _pass(fs, cutoff, lambda s: s / (2 * math.sqrt(2)), False)


def highpass(fs: float, cutoff: float) -> Section:
    return _pass(fs, cutoff, lambda s: s / (2 * math.sqrt(2)), True)


def _quality(k: int, n: int) -> float:
    """Q of section k of a Butterworth cascade of n sections."""
    return 1 / (2 * math.cos(math.pi * (2 * k + 1) / (4 * n)))


def lowpass_sections(fs: float, cutoff: float, n: int) -> list[Section]:
    """A maximally flat cascade of order 2n."""
    return [_pass(fs, cutoff, lambda s, q=_quality(k, n): s / (2 * q), False) for k in range(n)]


def highpass_sections(fs: float, cutoff: float, n: int) -> list[Section]:
    return [_pass(fs, cutoff, lambda s, q=_quality(k, n): s / (2 * q), True) for k in range(n)]


def bandpass(fs: float, low: float, high: float) -> Section:
    """One section around the geometric mean of both edges, alpha = sin(w) sinh(bandwidth / 2)."""
    w = 2 * math.pi * math.sqrt(low * high) / fs
    alpha = math.sin(w) * math.sinh(math.pi * (high - low) / fs)
    return _section((alpha, 0.0, -alpha), 1 + alpha, -2 * math.cos(w), 1 - alpha)


def bandpass_sections(fs: float, low: float, high: float, n: int, mode: str = "reference") -> list[Section]:
    """Band-pass cascade of order 2n by the analog prototype.

    ``reference`` pairs both band poles of one prototype pole and keeps real parts; ``sos`` pairs conjugate poles.
    """
    wl, wh = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    centre, width = math.sqrt(wl * wh), wh - wl
    z = cmath.exp(1j * 2 * math.atan2(centre, 2 * fs))
    digital = lambda s: (2 * fs + s) / (2 * fs - s)
    pairs = []
    for k in range(n):
        half = cmath.exp(1j * (math.pi * (2 * k + 1) / (2 * n) + math.pi / 2)) * width / 2
        root = cmath.sqrt(half * half - centre * centre)
        pairs.append((digital(half + root), digital(half - root)))
    if mode == "sos":
        upper = sorted((p for pair in pairs for p in pair if p.imag >= 0), key=lambda p: p.imag)
        pairs = [(p, p.conjugate()) for p in upper[:n]]
    out = []
    for p, q in pairs:
        a1, a2 = -(p + q).real, (p * q).real
        gain = abs(z * z + a1 * z + a2) / abs(z * z - 1)
        out.append((gain, 0.0, -gain, a1, a2))
    return out


def notch(fs: float, centre: float, q: float = 30.0) -> Section:
    w = 2 * math.pi * centre / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return _section((1.0, -2 * c, 1.0), 1 + alpha, -2 * c, 1 - alpha)


PASS_THROUGH: Section = (1.0, 0.0, 0.0, 0.0, 0.0)


def notch_bank(fs: float, base: float, harmonics: int, q: float = 30.0) -> list[Section]:
    """Notches at a frequency and its multiples; those at or above half the rate let all through."""
    return notch_list(fs, [base * (k + 1) for k in range(harmonics)], q)


def notch_list(fs: float, centres: list[float], q: float = 30.0) -> list[Section]:
    return [notch(fs, f, q) if f < fs / 2 else PASS_THROUGH for f in centres]


def sorter_bandpass(fs: float, low: float, high: float) -> Section:
    """The pre-warped section that the spike sorter runs twice."""
    wl, wh = math.tan(math.pi * low / fs), math.tan(math.pi * high / fs)
    bw, w2 = wh - wl, wl * wh
    return _section((bw, 0.0, -bw), 1 + bw + w2, 2 * (w2 - 1), 1 - bw + w2)


def ac_section(alpha: float) -> Section:
    """y[n] = x[n] - x[n-1] + alpha y[n-1]."""
    return 1.0, -1.0, 0.0, -alpha, 0.0


def ac_alpha(fs: float, cutoff: float) -> float:
    return math.exp(-2 * math.pi * cutoff / fs)


def oasis_gamma(fs: float, tau: float) -> float:
    return math.exp(-1 / (fs * tau))


def follower_coefficient(fs: float, seconds: float) -> float:
    return 1.0 if seconds <= 0 else 1 - math.exp(-2 * math.pi / (fs * seconds))
