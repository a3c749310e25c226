"""Numpy kernels against their definitions, and properties over random input."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from sigloom.functions import design, kernels, linear, spectrum

signals_ = hnp.arrays(float, st.integers(0, 200), elements=st.floats(-100, 100))


def direct_form(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in x:
            out = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, out, y1
            y.append(out)
        x = y
    return np.array(x)


@given(signals_, st.integers(0, 200))
@settings(max_examples=60, deadline=None)
def test_cascade_in_one_run_or_two(x, cut):
    sections = design.bandpass_sections(250.0, 8.0, 30.0, 2)
    want = direct_form(x, sections)
    first, state = kernels.cascade(x[:cut], sections)
    second, _ = kernels.cascade(x[cut:], sections, state)
    assert np.allclose(kernels.cascade(x, sections)[0], want, atol=1e-8)
    assert np.allclose(np.r_[first, second], want, atol=1e-8)


@pytest.mark.parametrize("fs", [100.0, 250.0, 1000.0, 30000.0])
def test_designs_pass_and_stop(fs):
    def gain(sections, f):
        z = np.exp(-2j * math.pi * f / fs)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))

    low, high = design.lowpass_sections(fs, fs / 10, 2), design.highpass_sections(fs, fs / 10, 2)
    assert abs(gain(low, 0) - 1) < 1e-9 and gain(low, fs / 2.01) < 1e-3 and abs(gain(low, fs / 10) - 2**-0.5) < 1e-6
    assert gain(high, 0) < 1e-9 and abs(gain(high, fs / 2) - 1) < 1e-6
    assert gain([design.notch(fs, fs / 8)], fs / 8) < 1e-9
    assert design.notch_bank(fs, fs / 3, 2)[1] == design.PASS_THROUGH
    sos = design.bandpass_sections(fs, fs / 20, fs / 10, 2, "sos")
    assert gain(sos, math.sqrt(fs / 20 * fs / 10)) > 0.5 and gain(sos, fs / 200) < 0.05
    assert all(abs(s[4]) < 1 for s in sos)


@given(signals_, st.sampled_from([3, 4, 5, 6, 8, 9]))
@settings(max_examples=60, deadline=None)
def test_median_filter(x, width):
    padded = [0.0] * (width - 1) + x.tolist()
    at = width // 2 if width % 2 or width > 7 else width // 2 - 1
    assert kernels.median_filter(x, width).tolist() == [sorted(padded[k : k + width])[at] for k in range(len(x))]


@given(hnp.arrays(float, st.integers(2, 64), elements=st.floats(-50, 50)), st.integers(1, 3))
@settings(max_examples=40, deadline=None)
def test_haar_without_threshold_is_the_identity(x, levels):
    # soft thresholds of zero noise leave the signal; a constant has no details
    assert np.allclose(kernels.denoise_haar(np.full(16, 3.0), levels), 3.0)
    assert np.isfinite(kernels.denoise_haar(x, levels)).all()
    assert np.allclose(kernels.soft_threshold(x, 0), x) and (np.abs(kernels.soft_threshold(x, 5)) <= np.abs(x)).all()


def test_oasis_by_hand():
    c, s = kernels.oasis(np.array([1.0, 0.5, 2.0, -1.0]), 0.5, 0.0)
    # 0.5 is not above 0.5 * 1; 2 merges with what is before it, then with the first
    p = (0.5 + 0.5 * 2) / 1.5
    p2 = (1 + 0.5 * 1.5 * p) / (1 + 0.5 * 1.5)
    assert np.allclose(c, [1.0, 0.5, p2, 0.0]) and (s >= 0).all()
    assert len(kernels.oasis(np.arange(50.0), 0.9, 0.1, most=4)[0]) == 50


@given(hnp.arrays(float, st.integers(5, 300), elements=st.floats(-1000, 1000)))
@settings(max_examples=40, deadline=None)
def test_p_square_stays_in_range(x):
    y = kernels.p_square(x, 0.5)
    assert np.isnan(y[:4]).all() and (y[4:] >= x.min() - 1e-9).all() and (y[4:] <= x.max() + 1e-9).all()


def test_p_square_is_close():
    x = np.random.default_rng(0).standard_normal(5000)
    assert abs(kernels.p_square(x, 0.9)[-1] - np.quantile(x, 0.9)) < 0.1


@given(hnp.arrays(bool, st.integers(0, 100)), st.integers(0, 8))
@settings(max_examples=60, deadline=None)
def test_refractory_hits(over, refractory):
    want, wait = [], 0
    for k, o in enumerate(over.tolist()):
        if wait > 0:
            wait -= 1
        elif o:
            want.append(k)
            wait = refractory
    assert kernels.refractory_hits(over, refractory).tolist() == want


def test_first_hits_keep_later_counters():
    frames = np.array([[9.0, 9.0], [0.0, 9.0], [9.0, 9.0], [9.0, 9.0]])
    assert [(t, c) for t, c, _ in kernels.first_hits(frames, 5, 2)] == [(0, 0), (1, 1), (3, 0)]


def test_negative_peaks_and_deduplication():
    x = np.zeros(50)
    x[[10, 12, 14, 30]] = -5, -9, -7, -6
    assert kernels.negative_peaks(x, 4, 5).tolist() == [12, 30]
    alive = kernels.keep_larger(np.array([1, 2, 3, 20]), np.array([5.0, 7.0, 7.0, 1.0]), lambda i, j: True, 3)
    assert alive.tolist() == [False, True, False, True]


def test_peeling_takes_templates_off():
    t = np.array([[0, 1.0, 2.0, 1.0], [2.0, 0, -2.0, 0]])
    x = np.zeros(40)
    x[10:14] += 3 * t[0]
    x[20:24] += 2 * t[1]
    rest, found = kernels.peel(x, [11, 21], t, np.array([0.5, 0.5]), np.array([5.0, 5.0]), 1, 3)
    assert np.abs(rest).max() < 1e-12 and found == [(11, 0, 3.0), (21, 1, 2.0)]
    z = kernels.matched_statistic(x, t[0])
    assert int(np.argmax(z)) == 10 and abs(z[10] / np.sqrt(6) - 3) < 1e-12


def test_matching_trains():
    assert kernels.match_first([10, 12], [11, 13], 2) == 2 and kernels.match_first([10], [8, 12, 13], 1) == 0
    assert kernels.match_nearest([10, 20], [9, 11, 21], 2) == 2


def test_entropies_by_definition():
    x = np.random.default_rng(4).standard_normal(60)

    def count(m, n, r, same):
        return sum(np.abs(x[i : i + m] - x[j : j + m]).max() < r for i in range(n) for j in range(n) if (same or i < j))

    b, a = count(2, 58, 0.5, False), count(3, 58, 0.5, False)
    assert abs(kernels.sample_entropy(x, 2, 0.5) + math.log(a / b)) < 1e-12
    assert kernels.sample_entropy(np.arange(20.0), 2, 0.1) == math.inf
    phi = lambda m: np.mean([math.log(sum(np.abs(x[i : i + m] - x[j : j + m]).max() < 0.5 for j in range(61 - m)) / (61 - m)) for i in range(61 - m)])
    assert abs(kernels.approximate_entropy(x, 2, 0.5) - max(0, phi(2) - phi(3))) < 1e-12
    assert kernels.approximate_entropy(np.ones(30), 2, 0.1) == 0


def test_lms_learns():
    rng = np.random.default_rng(0)
    u = rng.standard_normal(4000)
    d = np.convolve(u, [0.5, -0.3])[:4000]
    for epsilon in (None, 0.01):
        _, e, w = kernels.lms(u, d, 2, 0.05, epsilon)
        assert np.abs(e[-100:]).max() < 1e-3 and np.allclose(w, [0.5, -0.3], atol=1e-3)


# Spectra --------------------------------------------------------------------------------------------


@given(hnp.arrays(float, st.just(64), elements=st.floats(-10, 10)))
@settings(max_examples=30, deadline=None)
def test_parseval_and_analytic(x):
    assert abs(spectrum.power_spectrum(x).sum() / 64 - (x**2).sum()) < 1e-6
    assert np.allclose(spectrum.analytic(x).real, x, atol=1e-9)


def test_windows_and_densities():
    assert spectrum.window("hann", 5).tolist() == pytest.approx([0, 0.5, 1, 0.5, 0]) and spectrum.window("hann", 1).tolist() == [1.0]
    assert abs(spectrum.noise_bandwidth("rectangular", 32) - 1) < 1e-12
    t = np.arange(2048) / 256
    p = spectrum.welch(np.sin(2 * math.pi * 32 * t), 256.0, 256)
    assert int(p.argmax()) == 32 and abs(p.sum() * 1.0 - 0.5) < 0.01
    assert abs(np.median(spectrum.instantaneous_frequency(np.sin(2 * math.pi * 32 * t), 256.0)) - 32) < 0.01
    assert spectrum.welch(np.zeros(10), 256.0, 256).size == 0
    a, b = np.random.default_rng(0).standard_normal((2, 2048))
    assert np.allclose(spectrum.coherence(a, b, 2048), 1, atol=1e-9) and spectrum.coherence(a, b, 64).mean() < 0.2


def test_cwt_is_a_cut_correlation():
    x, s, fs = np.random.default_rng(1).standard_normal(200), 0.1, 100.0
    k = spectrum.half_width(s, fs)
    w = spectrum.morlet(s, fs)
    want = [sum(x[n + j] * np.conj(w[j + k]) for j in range(-k, k + 1) if 0 <= n + j < 200) for n in range(0, 200, 37)]
    assert np.allclose(spectrum.cwt(x, fs, s)[::37], want)
    assert 6 / (2 * math.pi * spectrum.scales(4, 40, 5)) == pytest.approx([4, 4 * 10**0.25, 4 * 10**0.5, 4 * 10**0.75, 40])


def test_coupling():
    phase = np.linspace(-math.pi, math.pi, 720, endpoint=False)
    assert spectrum.modulation_index(phase, np.ones(720), 18) < 1e-9 < 0.05 < spectrum.modulation_index(phase, 1 + np.cos(phase), 18)
    assert abs(spectrum.mean_vector_length(phase, 1 + np.cos(phase)) - 0.5) < 1e-9


@given(hnp.arrays(float, st.integers(1, 12), elements=st.floats(-5, 5)), hnp.arrays(float, st.integers(1, 12), elements=st.floats(-5, 5)))
@settings(max_examples=60, deadline=None)
def test_xcorr(x, y):
    n, m = len(x), len(y)
    want = [sum(x[i] * y[i + lag] for i in range(n) if 0 <= i + lag < m) for lag in range(-(m - 1), n)]
    assert np.allclose(spectrum.xcorr(x, y), want, atol=1e-9)
    assert np.allclose(spectrum.xcorr(x, x)[n - 1], (x**2).sum())


# Matrices -------------------------------------------------------------------------------------------


def spd(n, seed):
    a = np.random.default_rng(seed).standard_normal((n, n))
    return a @ a.T + n * np.eye(n)


def test_spd_geometry():
    a, b = spd(4, 1), spd(4, 2)
    assert np.allclose(linear.matrix_exp(linear.matrix_log(a)), a) and np.allclose(linear.matrix_sqrt(a) @ linear.matrix_sqrt(a), a)
    assert np.allclose(linear.matrix_inv_sqrt(a) @ a @ linear.matrix_inv_sqrt(a), np.eye(4))
    assert abs(linear.riemannian_distance(a, a)) < 1e-7 and abs(linear.riemannian_distance(a, b) - linear.riemannian_distance(b, a)) < 1e-9
    assert np.allclose(linear.from_tangent(linear.tangent(b, a), a), b)
    assert np.allclose(linear.frechet_mean(np.stack([a, a])), a)
    two = linear.frechet_mean(np.stack([a, b]))
    assert abs(linear.riemannian_distance(a, two) - linear.riemannian_distance(b, two)) < 1e-4
    assert np.allclose(linear.recenter(a, a), np.eye(4)) and linear.mdm(a, [b, a])[0] == 1
    with pytest.raises(ValueError):
        linear.matrix_log(np.diag([1.0, -1.0]))


def test_eigen_and_whitening():
    a, b = spd(5, 3), spd(5, 4)
    values, w = linear.generalized_eigen(a, b)
    assert np.allclose(a @ w, b @ w * values) and (np.diff(values) <= 0).all() and np.allclose(np.linalg.norm(w, axis=0), 1)
    for mode in ("zca", "pca"):
        m = linear.whitening(a, 1e-12, mode)
        assert np.allclose(m @ a @ m.T, np.eye(5))


def test_decoders():
    rng = np.random.default_rng(0)
    s = rng.standard_normal((4000, 1))
    x, y = np.hstack([s, rng.standard_normal((4000, 1))]), np.hstack([s + 0.1 * rng.standard_normal((4000, 1)), rng.standard_normal((4000, 1))])
    r = linear.cca(x, y)
    assert r[0] > 0.99 and r[1] < 0.1
    w, t, _ = linear.lda(np.array([[2.0, 0], [-2.0, 0]]), np.eye(2) * 98, np.array([50, 50]))
    assert np.allclose(w, [1, 0], atol=1e-9) and abs(t) < 1e-9
    k = linear.Kalman([[1, 1], [0, 1]], [[1, 0]], np.eye(2) * 1e-4, [[1.0]], [0, 0], np.eye(2) * 100)
    for step in range(200):
        x, p, _ = k.step([2.0 * step + rng.standard_normal()])
    assert abs(x[1] - 2) < 0.1 and np.allclose(p, p.T)


def test_granger():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(1000)
    y = np.r_[0, 0.8 * x[:-1]] + 0.3 * rng.standard_normal(1000)
    assert linear.granger(x, y, 2)[1] < 1e-6 < 0.01 < linear.granger(y, x, 2)[1]
    assert linear.granger(x, y, 2, rng.standard_normal(1000))[1] < 1e-6
    assert abs(linear.f_survival(3.0, 2, 10) - 0.0953674) < 1e-6 and linear.f_survival(0, 1, 1) == 1
