"""Spike sorting of multi-channel segments, batch, by library of templates, and online.

A segment (recording, run of samples) is one Arrow task: noise, reference, band-pass, whitening, detection, alignment,
features, online clusters, merges and splits, subtraction, matched filter, metrics and curation. Segments are independent
(as many as the data have); their labels are offset afterwards, or matched to a library of templates in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import design, kernels, linear
from sigloom.operators.models import OnlineKMeans, farthest_seeds, projection_seeds
from sigloom.operators.signals import per_group

FEATURES = 4


@dataclass(frozen=True)
class SortConfig:
    threshold: float = 5.0
    refractory: int = 15
    spatial_radius_um: float = 75.0
    temporal_radius: int = 5
    align_half_window: int = 15
    before: int = 20
    width: int = 48
    cluster_threshold: float = 5.0
    most_count: int = 1000
    epsilon: float = 1e-6
    merge_dprime: float = 4.5
    isi_limit: float = 0.05
    isi_split: float = 0.1
    least_split: int = 10
    bimodality: float = 2.0
    subtract_passes: int = 2
    least_count: int = 3
    least_snr: float = 2.5
    ccg_merge: bool = False
    ccg_correlation: float = 0.5
    matched_filter: bool = False
    matched_threshold: float = 4.0
    common_median: bool = False
    band: tuple[float, float] = (0.0, 0.0)
    fs: float = 30_000.0
    detection: str = "amplitude"
    sneo_half: int = 3
    seeds: str = "farthest"
    clusters: int = 32
    #: Separation below which clusters of neighbouring channels become one (0: no such pass).
    spatial_dprime: float = 0.0
    #: Whether clusters are fitted again as Gaussians with full covariances, in so many rounds.
    gmm: bool = False
    gmm_rounds: int = 10
    #: Thresholds of channels by their own noise, a floor, and a rate beyond which they rise.
    adaptive: bool = False
    adaptive_floor: float = 0.5
    adaptive_rate: float = 200.0
    #: Rounds in which the templates find their spikes in the frames anew and are fitted to these; the least gain of a spike.
    refine: int = 0
    refine_gain: float = 20.0
    refine_merge: float = 4.0

    def __post_init__(self):
        if self.threshold <= 0 or self.refractory < 1 or self.width < 4 or not 0 <= self.before < self.width:
            raise ValueError("threshold, refractory time, width or lead are out of range")
        if self.detection not in ("amplitude", "neo", "sneo") or self.seeds not in ("farthest", "svd"):
            raise ValueError("unknown detection or seeds")


@dataclass
class Sorted:
    """Spikes (sample, channel, amplitude, label) and one row for each cluster."""

    sample: np.ndarray
    channel: np.ndarray
    amplitude: np.ndarray
    label: np.ndarray
    clusters: list[dict] = field(default_factory=list)
    templates: np.ndarray | None = None


def _empty(width: int) -> Sorted:
    z = np.zeros(0, np.int64)
    return Sorted(z, z, np.zeros(0), z, [], np.zeros((0, width)))


def noise_of(x: np.ndarray) -> np.ndarray:
    """Median absolute value over 0.6745 of each channel, channel by channel in memory."""
    a = np.empty(x.shape[::-1])
    for k in range(0, len(x), 2048):  # pieces that fit the cache
        np.abs(x[k : k + 2048].T, out=a[:, k : k + 2048])
    if not a.shape[1]:
        return np.full(len(a), np.nan)
    k = a.shape[1] // 2
    a.partition(k, axis=1)
    middle = a[:, k] if a.shape[1] % 2 else (a[:, :k].max(axis=1) + a[:, k]) / 2
    return middle / 0.6745


def prepared(x: np.ndarray, c: SortConfig) -> np.ndarray:
    """Referenced, filtered and whitened frames."""
    x = np.array(x, float)
    if c.common_median and x.shape[1] > 2:
        x -= np.median(x, axis=1, keepdims=True)
    if c.band[1] > c.band[0] > 0:
        section = [design.sorter_bandpass(c.fs, *c.band)] * 2
        x = np.stack([kernels.cascade(x[:, k], section)[0] for k in range(x.shape[1])], axis=1)
    # covariance of quiet frames where there are enough of them, else of all
    noise = noise_of(x)
    quiet = (np.abs(x) < 4 * np.maximum(noise, 1e-12)).all(axis=1)
    return x @ linear.whitening(np.cov((x[quiet] if quiet.sum() > 10 * x.shape[1] else x).T).reshape(x.shape[1], -1), c.epsilon).T


def detected(x: np.ndarray, c: SortConfig) -> tuple[np.ndarray, np.ndarray]:
    """(sample, channel) of troughs beyond the threshold of each channel, in order of sample, then channel."""
    noise = np.maximum(noise_of(x), 1e-12)
    found = []
    for k in range(x.shape[1]):
        if c.detection == "amplitude":
            limit = channel_limit(x[:, k], noise[k], c) if c.adaptive else c.threshold * noise[k]
            at = kernels.negative_peaks(x[:, k], limit, c.refractory)
        else:
            e = kernels.neo(x[:, k]) if c.detection == "neo" else kernels.sneo(x[:, k], c.sneo_half)
            middle = np.median(e)
            limit = middle + c.threshold**2 * np.median(np.abs(e - middle)) / 0.6745
            at = kernels.matched_peaks(e, limit, c.refractory) + 1
            at = np.array([max(0, t - 5) + int(np.argmin(x[max(0, t - 5) : t + 6, k])) for t in at.tolist()], np.int64)
        found += [(t, k) for t in at.tolist()]
    found.sort()
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def channel_limit(x: np.ndarray, noise: float, c: SortConfig) -> float:
    """A channel's threshold: a multiple of its noise above a floor, raised by the root of how far its crossings exceed the rate."""
    limit = max(c.threshold * noise, c.adaptive_floor)
    below = x < -limit
    rate = float((below[1:] & ~below[:-1]).sum()) / max(len(x) / c.fs, 1e-12)
    return limit * math.sqrt(rate / c.adaptive_rate) if rate > c.adaptive_rate else limit


def _near(xy: np.ndarray, channel: np.ndarray, radius: float):
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    return lambda i, j: d2[channel[i], channel[j]] <= radius**2


def snippets(x: np.ndarray, sample: np.ndarray, channel: np.ndarray, c: SortConfig) -> np.ndarray:
    return x[(sample - c.before)[:, None] + np.arange(c.width), channel[:, None]]


def violation_rate(times: np.ndarray, refractory: int) -> float:
    return float((np.diff(np.sort(times)) < refractory).mean()) if len(times) > 1 else 0.0


def d_prime(a: np.ndarray, b: np.ndarray) -> float:
    """Separation of two clouds along the line between their means."""
    axis = a.mean(axis=0) - b.mean(axis=0)
    size = np.linalg.norm(axis)
    if size < 1e-12:
        return 0.0
    p, q = a @ axis / size, b @ axis / size
    pooled = math.sqrt((p.var(ddof=1) if len(p) > 1 else 0) / 2 + (q.var(ddof=1) if len(q) > 1 else 0) / 2)
    return abs(p.mean() - q.mean()) / pooled if pooled > 0 else math.inf


def merged(features: np.ndarray, sample: np.ndarray, label: np.ndarray, c: SortConfig, allowed=None) -> np.ndarray:
    """The least separated pair becomes one while it is below the limit and the union keeps its refractory time."""
    label, failed = label.copy(), set()
    while True:
        names = np.unique(label).tolist()
        means = {k: features[label == k] for k in names}
        pairs = [(d_prime(means[i], means[j]), i, j) for n, i in enumerate(names) for j in names[n + 1 :] if (i, j) not in failed and (allowed is None or allowed(i, j))]
        pairs = [p for p in pairs if p[0] <= c.merge_dprime]
        if not pairs:
            return label
        _, i, j = min(pairs)
        if violation_rate(sample[(label == i) | (label == j)], c.refractory) <= c.isi_limit:
            label[label == j] = i
            failed.clear()
        else:
            failed.add((i, j))


def principal(f: np.ndarray, steps: int = 3) -> np.ndarray:
    """Projection on the main axis by a few power steps."""
    centred = f - f.mean(axis=0)
    v = np.ones(f.shape[1])
    for _ in range(steps):
        v = centred.T @ (centred @ v)
        v /= max(np.linalg.norm(v), 1e-300)
    return centred @ v


def split(features: np.ndarray, sample: np.ndarray, label: np.ndarray, c: SortConfig) -> np.ndarray:
    """Cuts clusters at a wide gap of the main axis, or at its median where too many intervals are short."""
    label = label.copy()
    for k in np.unique(label).tolist():
        own = np.flatnonzero(label == k)
        if len(own) < 2 * c.least_split:
            continue
        p = principal(features[own])
        s = np.sort(p)
        gaps = np.diff(s)
        g = int(np.argmax(gaps))
        if gaps[g] > c.bimodality * max(p.std(), 1e-12):
            upper = p > (s[g] + s[g + 1]) / 2
        elif violation_rate(sample[own], c.refractory) > c.isi_split:
            upper = p > np.median(p)
        else:
            continue
        if c.least_split <= upper.sum() <= len(own) - c.least_split and len(np.unique(label)) < c.clusters:
            label[own[upper]] = label.max() + 1
    return label


def gaussian_labels(features: np.ndarray, label: np.ndarray, rounds: int, ridge: float = 1e-6) -> np.ndarray:
    """Labels of a mixture of Gaussians with full covariances that starts from ``label``; clusters of few points start from the whole's."""
    names, own = np.unique(label, return_inverse=True)
    d = features.shape[1]
    whole = np.cov(features.T).reshape(d, d) + ridge * np.eye(d)
    share = np.eye(len(names))[own]
    for _ in range(rounds):
        held = np.maximum(share.sum(axis=0), 1e-12)
        means = share.T @ features / held[:, None]
        log = np.zeros((len(features), len(names)))
        for k in range(len(names)):
            gap = features - means[k]
            cov = (share[:, k, None] * gap).T @ gap / held[k] + ridge * np.eye(d) if held[k] > 2 * d else whole
            low = np.linalg.cholesky(cov + ridge * np.trace(cov) / d * np.eye(d))
            z = np.linalg.solve(low, gap.T)
            log[:, k] = math.log(held[k] / len(features)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum()
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        still = np.abs(new - share).max() < 1e-6
        share = new
        if still:
            break
    return names[share.argmax(axis=1)]


def cut_by_amplitude(amplitude: np.ndarray, label: np.ndarray, c: SortConfig) -> np.ndarray:
    """Cuts clusters at a gap of their amplitudes that is wide against the spread on both sides."""
    label = label.copy()
    spread = lambda v: np.median(np.abs(v - np.median(v))) / 0.6745
    for k in np.unique(label).tolist():
        own = np.flatnonzero(label == k)
        a = np.sort(amplitude[own])
        inner = np.diff(a)[c.least_split - 1 : max(0, len(a) - c.least_split)]
        if len(inner) and len(np.unique(label)) < c.clusters:
            g = int(np.argmax(inner)) + c.least_split - 1
            if a[g + 1] - a[g] >= c.bimodality * 2 * max(spread(a[: g + 1]), spread(a[g + 1 :]), 1e-12):
                label[own[amplitude[own] > (a[g] + a[g + 1]) / 2]] = label.max() + 1
    return label


# Templates over all channels ------------------------------------------------------------------------


def wide_templates(w: np.ndarray, sample: np.ndarray, label: np.ndarray, c: SortConfig) -> dict[int, np.ndarray]:
    """Mean frames (width x channels) of each cluster; channels that do not stand out of the mean's own noise are zero."""
    out = {}
    for k in np.unique(label).tolist():
        own = sample[label == k]
        if len(own) < c.least_count:
            continue
        m = np.zeros((c.width, w.shape[1]))
        for part in np.array_split(own, -(-len(own) // 256)):
            m += w[(part - c.before)[:, None] + np.arange(c.width)].sum(axis=0)
        m /= len(own)
        m[:, np.abs(m).max(axis=0) < max(0.5, 4.5 / math.sqrt(len(own)))] = 0.0
        if m.any():
            out[k] = m
    return out


def aligned_gap(a: np.ndarray, b: np.ndarray, reach: int) -> float:
    """The least distance of two templates over shifts of at most ``reach`` samples."""
    best, both = 0.0, (a * a).sum() + (b * b).sum()
    for shift in range(-reach, reach + 1):
        x, y = (a[shift:], b[: len(b) - shift]) if shift >= 0 else (a[:shift], b[-shift:])
        best = max(best, float((x * y).sum()))
    return math.sqrt(max(0.0, both - 2 * best))


def fewer_templates(templates: dict[int, np.ndarray], counts: dict[int, int], c: SortConfig) -> dict[int, np.ndarray]:
    """Templates that differ by less than noise can tell are one: the one of more spikes stays."""
    kept: dict[int, np.ndarray] = {}
    for k in sorted(templates, key=lambda k: (-counts[k], k)):
        if all(aligned_gap(templates[k], m, c.align_half_window) > max(c.refine_merge, 0.25 * min(np.linalg.norm(m), np.linalg.norm(templates[k]))) for m in kept.values()):
            kept[k] = templates[k]
    return kept


def pursued(w: np.ndarray, templates: dict[int, np.ndarray], c: SortConfig, rounds: int = 3, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, label, what is left of the frames) of spikes whose template, taken off the frames, lowers their energy by ``refine_gain`` at least.

    Of all templates and samples within a template's width the largest gain is taken; taken ones are subtracted, and the rest is
    searched again. Products run over blocks by Fourier transforms.
    """
    names, n, width = list(templates), len(w), c.width
    rest = np.array(w, np.float32)
    if not names or n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rest
    norms = np.array([(templates[k] ** 2).sum() for k in names])
    spectra = []
    for k in names:
        on = np.flatnonzero(templates[k].any(axis=0))
        spectra.append((on, np.conj(np.fft.rfft(templates[k][:, on].astype(np.float32), block, axis=0))))
    step, found = block - width + 1, []
    for _ in range(rounds):
        gain, which = np.full(n - width + 1, -np.inf, np.float32), np.zeros(n - width + 1, np.int32)
        for a in range(0, n - width + 1, step):
            part = np.fft.rfft(rest[a : a + block], block, axis=0)
            size = min(step, n - width + 1 - a)
            for j, (on, z) in enumerate(spectra):
                g = 2 * np.fft.irfft((part[:, on] * z).sum(axis=1), block)[:size] - norms[j]
                better = g > gain[a : a + size]
                gain[a : a + size][better] = g[better]
                which[a : a + size][better] = j
        at = np.flatnonzero(gain > c.refine_gain)
        keep = np.zeros(n + 2 * width, bool)
        fresh = []
        for i in at[np.argsort(-gain[at], kind="stable")].tolist():
            if not keep[i + width - width // 2 : i + width + width // 2].any():
                keep[i + width] = True
                fresh.append(i)
        if not fresh:
            break
        for i in fresh:
            m = templates[names[which[i]]]
            on = spectra[which[i]][0]
            rest[i : i + width, on] -= m[:, on].astype(np.float32)
            found.append((i + c.before, names[which[i]]))
    found = np.array(sorted(found), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1], rest


def overlooked(rest: np.ndarray, xy: np.ndarray, c: SortConfig, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(sample, channel) of troughs that stand out once frames are smoothed over ``width`` / 16 samples; a channel with few of them has none."""
    reach = c.width // 4
    shape = np.exp(-0.5 * (np.arange(-reach, reach + 1) / (c.width / 16)) ** 2)
    shape /= np.linalg.norm(shape)
    smooth = np.stack([np.convolve(rest[:, k], shape, "same") for k in range(rest.shape[1])], axis=1)
    s, k = detected(smooth, replace(c, detection="amplitude", adaptive=False))
    if not len(s):
        return s, k
    keep = kernels.keep_larger(s, np.abs(smooth[s, k]), _near(xy, k, c.spatial_radius_um), c.refractory)
    keep &= (s >= c.before) & (s - c.before + c.width <= len(rest))
    s, k = s[keep], k[keep]
    often = np.bincount(k, minlength=rest.shape[1])[k] >= least
    return s[often], k[often]


def refined(w: np.ndarray, xy: np.ndarray, sample: np.ndarray, label: np.ndarray, c: SortConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """(sample, channel, label, labels whose whole template has four times the energy of the least gain) after ``refine`` rounds: templates find their spikes anew, and these give the next templates.

    Between rounds, troughs that no template explains give a template for each channel that has enough of them.
    """
    for k in range(c.refine):
        counts = dict(zip(*(v.tolist() for v in np.unique(label, return_counts=True))))
        templates = fewer_templates(wide_templates(w, sample, label, c), counts, c)
        s, l, rest = pursued(w, templates, c)
        whole = (s >= c.before) & (s - c.before + c.width <= len(w))
        sample, label = s[whole], l[whole]
        if k < c.refine - 1:
            new, channel = overlooked(rest, xy, c)
            sample, label = np.r_[sample, new], np.r_[label, max([0, *counts]) + 1 + channel]
        if not len(sample):
            break
    last = wide_templates(w, sample, label, c)
    home = {k: int(np.abs(m).max(axis=0).argmax()) for k, m in last.items()}
    known = np.isin(label, list(home))
    return sample[known], np.array([home[k] for k in label[known].tolist()], np.int64), label[known], {k for k, m in last.items() if (m * m).sum() >= 4 * c.refine_gain}


def has_dip(a: np.ndarray, b: np.ndarray, fs: float, width: float = 0.0005, span: float = 0.025) -> bool:
    """Whether the cross-correlogram of two trains lacks short lags."""
    a, b = np.sort(a), np.sort(b)
    counts = np.zeros(int(round(span / width)), np.int64)
    for t in a.tolist():
        near = b[np.searchsorted(b, t - span * fs, "right") : np.searchsorted(b, t + span * fs)]
        lag = np.abs(near - t)
        np.add.at(counts, np.minimum((lag[lag > 0] / (width * fs)).astype(int), len(counts) - 1), 1)
    close, far = counts[:4].mean(), counts[4:8].mean()
    return bool(far > 0 and close < 0.5 * far)


def troughs(signal: np.ndarray, xy: np.ndarray, c: SortConfig) -> tuple[np.ndarray, np.ndarray]:
    """(sample, channel) of events, of near ones the larger, moved to their least sample, whole within the signal, in order."""
    s, k = detected(signal, c)
    keep = kernels.keep_larger(s, np.abs(signal[s, k]), _near(xy, k, c.spatial_radius_um), c.temporal_radius) if len(s) else np.zeros(0, bool)
    s, k = s[keep], k[keep]
    for i in range(len(s)):
        low = max(0, s[i] - c.align_half_window)
        part = signal[low : s[i] + c.align_half_window + 1, k[i]]
        if part.min() < signal[s[i], k[i]]:
            s[i] = low + int(np.argmin(part))
    whole = (s >= c.before) & (s - c.before + c.width <= len(signal))
    s, k = s[whole], k[whole]
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    return s[fresh], k[fresh]


def sort_reduced(x: np.ndarray, xy: np.ndarray, c: SortConfig) -> Sorted:
    """The shorter way that wide probes are sorted by: detection by amplitude, three components and the channel's place (between 0 and 1), as many
    seeds as clusters, merges, splits by gaps and amplitudes; a cluster's SNR is its mean amplitude over the mean noise.

    No subtraction, matched filter, spatial or correlogram merges, splits by intervals or Gaussians.
    """
    x = np.asarray(x, float)
    if len(x) < c.width:
        return _empty(c.width)
    c = replace(c, detection="amplitude", isi_split=math.inf)
    w = prepared(x, c)
    sample, channel = troughs(w, xy, c)
    if not len(sample):
        return _empty(c.width)
    waves = snippets(w, sample, channel, c)
    if len(sample) > 1:
        shape = (waves - waves.mean(axis=0)) @ linear.eigen_symmetric(np.cov(waves.T))[1][:, : FEATURES - 1]
    else:
        shape = waves[:, : FEATURES - 1]
    features = np.hstack([shape, (channel / w.shape[1])[:, None]])
    seeds = (farthest_seeds if c.seeds == "farthest" else projection_seeds)(features, c.clusters)
    model = OnlineKMeans(c.cluster_threshold, c.most_count, c.clusters, [s.copy() for s in seeds], [1] * len(seeds))
    label = np.array([model.assign(f)[0] for f in features])
    label = split(features, sample, merged(features, sample, label, c), c)
    amplitude = np.abs(w[sample, channel])
    label = cut_by_amplitude(amplitude, label, c)
    noise = max(float(noise_of(w).mean()), 1e-12)
    out, rows, means = np.full(len(sample), -1), [], []
    for k in np.unique(label).tolist():
        own = label == k
        snr = float(amplitude[own].mean() / noise)
        if snr >= c.least_snr:
            out[own] = len(rows)
            rows.append({"cluster": len(rows), "count": int(own.sum()), "snr": snr, "isi_violation_rate": violation_rate(sample[own], c.refractory), "channel": int(np.bincount(channel[own]).argmax())})
            means.append(waves[own].mean(axis=0))
    keep = np.flatnonzero(out >= 0)
    return Sorted(sample[keep], channel[keep], amplitude[keep], out[keep], rows, np.array(means).reshape(-1, c.width))


def sort_frames(x: np.ndarray, xy: np.ndarray, c: SortConfig) -> Sorted:
    """The whole sorter over one segment (samples x channels) and channel positions."""
    x = np.asarray(x, float)
    if len(x) < c.width:
        return _empty(c.width)
    w = prepared(x, c)

    def events(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return troughs(signal, xy, c)

    sample, channel = events(w)
    if len(sample) < 2:
        return _empty(c.width)
    waves = snippets(w, sample, channel, c)
    mean = waves.mean(axis=0)
    _, axes = linear.eigen_symmetric(np.cov(waves.T))
    basis = axes[:, : FEATURES - 1]
    place = lambda k: (k / w.shape[1] * c.cluster_threshold * w.shape[1])[:, None]
    features = np.hstack([(waves - mean) @ basis, place(channel.astype(float))])
    seeds = (farthest_seeds if c.seeds == "farthest" else projection_seeds)(features, max(1, math.isqrt(c.clusters)))
    model = OnlineKMeans(c.cluster_threshold, c.most_count, c.clusters, [s.copy() for s in seeds], [1] * len(seeds))
    label = np.array([model.assign(f)[0] for f in features])
    at = {k: channel[label == k] for k in np.unique(label).tolist()}
    mode = lambda v: int(np.bincount(v).argmax())
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= c.spatial_radius_um**2
    label = merged(features[:, :-1], sample, label, c, lambda i, j: near[mode(at[i]), mode(at[j])])
    if c.spatial_dprime > 0:
        at = {k: channel[label == k] for k in np.unique(label).tolist()}
        label = merged(features[:, :-1], sample, label, replace(c, merge_dprime=c.spatial_dprime), lambda i, j: mode(at[i]) != mode(at[j]) and near[mode(at[i]), mode(at[j])])
    amplitude = np.abs(w[sample, channel])
    label = cut_by_amplitude(amplitude, split(features[:, :-1], sample, label, c), c)
    if c.gmm:
        label = gaussian_labels(features, label, c.gmm_rounds)

    def shapes() -> dict[int, tuple[np.ndarray, int]]:
        return {k: (waves[label == k].mean(axis=0), mode(channel[label == k])) for k in np.unique(label).tolist() if (label == k).sum() >= c.least_count}

    if c.ccg_merge:
        known = shapes()
        for i in sorted(known):
            for j in sorted(known):
                if i < j and (label == i).any() and (label == j).any():
                    a, b = known[i][0], known[j][0]
                    if a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-30) > c.ccg_correlation and has_dip(sample[label == i], sample[label == j], c.fs):
                        label[label == j] = i
    rest = w.copy()
    for _ in range(c.subtract_passes):
        known = shapes()
        if not known:
            break
        spread = np.mean([((waves[label == k] - m) ** 2).sum(axis=1).mean() for k, (m, _) in known.items()])
        rest = w.copy()
        for s, k, l in zip(sample.tolist(), channel.tolist(), label.tolist()):
            if l in known:
                m = known[l][0]
                part = rest[s - c.before : s - c.before + c.width, k]
                part -= np.clip(part @ m / max(m @ m, 1e-30), 0.3, 3.0) * m
        s2, k2 = events(rest)
        if len(s2):
            order = np.sort(sample)
            gap = np.searchsorted(order, s2 - c.temporal_radius), np.searchsorted(order, s2 + c.temporal_radius, "right")
            free = gap[0] == gap[1]
            s2, k2 = s2[free], k2[free]
        if not len(s2):
            break
        new = snippets(rest, s2, k2, c)
        names = sorted(known)
        d = ((new[:, None] - np.array([known[n][0] for n in names])[None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        ok = d.min(axis=1) <= 3 * spread
        if not ok.any():
            break
        sample, channel = np.r_[sample, s2[ok]], np.r_[channel, k2[ok]]
        amplitude, label = np.r_[amplitude, np.abs(rest[s2[ok], k2[ok]])], np.r_[label, np.array(names)[best[ok]]]
        waves = np.vstack([waves, new[ok]])
    if c.matched_filter:
        for k, (m, ch) in shapes().items():
            z = kernels.matched_statistic(rest[:, ch], m)
            for p in kernels.matched_peaks(z, c.matched_threshold * max(np.median(np.abs(z)) / 0.6745, 1e-12), c.refractory).tolist():
                s, size = p + c.before, z[p] / np.linalg.norm(m)
                if 0.2 <= size <= 5 and not (np.abs(sample - s) <= c.temporal_radius).any():
                    sample, channel, label = np.r_[sample, s], np.r_[channel, ch], np.r_[label, k]
                    amplitude, waves = np.r_[amplitude, abs(w[s, ch]) if s < len(w) else 0.0], np.vstack([waves, rest[p : p + c.width, ch]])
    strong: set[int] = set()
    if c.refine:
        sample, channel, label, strong = refined(w, xy, sample, label, c)
        if not len(sample):
            return _empty(c.width)
        amplitude, waves = np.abs(w[sample, channel]), snippets(w, sample, channel, c)
    noise = np.maximum(noise_of(w), 1e-12)
    out, rows, means = np.full(len(sample), -1), [], []
    for k in np.unique(label).tolist():
        own = label == k
        m = waves[own].mean(axis=0)
        snr = float((m.max() - m.min()) / (2 * noise[mode(channel[own])]))
        if own.sum() >= c.least_count and (snr >= c.least_snr or k in strong):
            out[own] = len(rows)
            rows.append({"cluster": len(rows), "count": int(own.sum()), "snr": snr, "isi_violation_rate": violation_rate(sample[own], c.refractory), "channel": mode(channel[own])})
            means.append(m)
    keep = np.flatnonzero(out >= 0)
    keep = keep[np.lexsort((channel[keep], sample[keep]))]
    return Sorted(sample[keep], channel[keep], amplitude[keep], out[keep], rows, np.array(means).reshape(-1, c.width))


# In Spark -------------------------------------------------------------------------------------------


def sort_segments(frames: DataFrame, xy: np.ndarray, config: SortConfig, segment: int, margin: int = 0) -> DataFrame:
    """(recording_id, segment, sample, channel, amplitude, label, clusters) of every segment; labels count within it.

    ``margin``: frames that a segment borrows on both sides, so that spikes at its edges are whole; it gives its own spikes only.
    """
    at = lambda i: F.floor(i / segment).cast("long")
    i = F.col("sample_idx")
    needed = F.explode(F.sequence(F.greatest(at(i - margin), F.lit(0).cast("long")), at(i + margin))) if margin else at(i)
    rows = frames.select("recording_id", "sample_idx", "x", needed.alias("segment"))

    def run(t: pa.Table) -> dict:
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        first, k = t["sample_idx"][0].as_py(), t["segment"][0].as_py()
        s = sort_frames(x, xy, config)
        sample = s.sample + first
        own = (sample >= k * segment) & (sample < (k + 1) * segment)
        return {"sample": sample[own], "channel": s.channel[own], "amplitude": s.amplitude[own], "label": s.label[own], "clusters": np.full(int(own.sum()), len(s.clusters))}

    return per_group(rows, ["recording_id", "segment"], run, "sample long, channel int, amplitude double, label int, clusters int")


def neighbourhoods(xy: np.ndarray, most: int, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(own, all) channels of each part of a probe: runs along it of ``most`` channels at most, and these with all within ``reach`` of them."""
    order = np.lexsort((xy[:, 0], xy[:, 1]))
    parts = np.array_split(order, max(1, -(-len(order) // most)))
    return [(np.sort(own), np.flatnonzero((((xy[:, None] - xy[None, own]) ** 2).sum(axis=2) <= reach**2).any(axis=1))) for own in parts]


def sort_probe(frames: DataFrame, xy: np.ndarray, config: SortConfig, segment: int, margin: int = 0, most: int = 64, reach: float | None = None, reduced: bool = False) -> DataFrame:
    """(recording_id, segment, part, sample, channel, amplitude, label, clusters) of a wide probe, by segments of time and parts of the probe.

    A part gets its own channels and those within ``reach`` (the radius within which events are one, twice), so that which of near
    troughs is the larger is decided alike on both sides of an edge; it gives the spikes of its own channels only. A unit that peaks on
    both sides of an edge is a cluster in each of two parts, which ``curation.merged`` may join. Labels count within a segment and part. No
    task holds more than ``most`` channels and their edge. ``reduced``: see ``sort_reduced``.
    """
    parts = neighbourhoods(np.asarray(xy, float), most, 2 * config.spatial_radius_um if reach is None else reach)
    at = lambda i: F.floor(i / segment).cast("long")
    i = F.col("sample_idx")
    needed = F.explode(F.sequence(F.greatest(at(i - margin), F.lit(0).cast("long")), at(i + margin))) if margin else at(i)
    rows = frames.select("recording_id", "sample_idx", "x", needed.alias("segment"))

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for p, (_, every) in enumerate(parts):
                own = np.ascontiguousarray(x[:, every])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, b.column(3), pa.array(np.full(len(own), p, np.int32))], names=["recording_id", "sample_idx", "x", "segment", "part"])

    def run(t: pa.Table) -> dict:
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        first, k = t["sample_idx"][0].as_py(), t["segment"][0].as_py()
        own, every = parts[t["part"][0].as_py()]
        s = (sort_reduced if reduced else sort_frames)(x, np.asarray(xy, float)[every], config)
        sample, channel = s.sample + first, every[s.channel]
        mine = (sample >= k * segment) & (sample < (k + 1) * segment) & np.isin(channel, own)
        return {"sample": sample[mine], "channel": channel[mine], "amplitude": s.amplitude[mine], "label": s.label[mine], "clusters": np.full(int(mine.sum()), len(s.clusters))}

    dealt = rows.mapInArrow(deal, "recording_id long, sample_idx long, x array<double>, segment long, part int")
    return per_group(dealt, ["recording_id", "segment", "part"], run, "sample long, channel int, amplitude double, label int, clusters int")


def joined_segments(spikes: DataFrame) -> DataFrame:
    """Labels offset by the clusters of all segments before."""
    w = Window.partitionBy("recording_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spikes.groupBy("recording_id", "segment").agg(F.max("clusters").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return spikes.join(offsets.drop("n"), ["recording_id", "segment"]).withColumn("label", (F.col("label") + F.col("offset")).cast("int")).drop("offset")


@dataclass
class TemplateLibrary:
    """Segments in order: clusters are matched to known templates by shape and depth, others become new ones."""

    config: SortConfig
    xy: np.ndarray
    decay: float = 0.95
    least_match: float = 0.5
    shapes: list = field(default_factory=list)
    depths: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    samples: int = 0
    #: Depths of spikes by bins of so many samples: (number, sum), so that the library does not grow with them.
    bin_samples: int = 30_000
    bins: dict = field(default_factory=dict)

    def feed(self, x: np.ndarray) -> Sorted:
        s = sort_frames(x, self.xy, self.config)
        names, taken = {}, set()
        for row, m in zip(s.clusters, s.templates):
            y = float(self.xy[row["channel"], 1])
            scores = [(float(m @ t) / max(np.linalg.norm(m) * np.linalg.norm(t), 1e-30) * math.exp(-((y - d) ** 2) / (2 * 50.0**2)), -k) for k, (t, d) in enumerate(zip(self.shapes, self.depths)) if k not in taken]
            if scores and max(scores)[0] > self.least_match:
                k = -max(scores)[1]
                self.shapes[k] = self.decay * self.shapes[k] + (1 - self.decay) * m
                self.depths[k] = self.decay * self.depths[k] + (1 - self.decay) * y
                self.counts[k] += row["count"]
            else:
                k = len(self.shapes)
                self.shapes.append(m.copy())
                self.depths.append(y)
                self.counts.append(row["count"])
            taken.add(k)
            names[row["cluster"]] = k
        for t, k in zip(s.sample.tolist(), s.channel.tolist()):
            at = (t + self.samples) // self.bin_samples
            n, total = self.bins.get(at, (0, 0.0))
            self.bins[at] = n + 1, total + float(self.xy[k, 1])
        out = replace(s, sample=s.sample + self.samples, label=np.array([names[k] for k in s.label.tolist()], np.int64))
        self.samples += len(x)
        return out

    def drift(self, bin_samples: int | None = None) -> float | None:
        """Slope of the mean depths of bins (of a multiple of ``bin_samples``); None below two bins."""
        times = (bin_samples or self.bin_samples) // self.bin_samples
        joined: dict[int, tuple[int, float]] = {}
        for at, (n, total) in self.bins.items():
            m, old = joined.get(at // max(1, times), (0, 0.0))
            joined[at // max(1, times)] = m + n, old + total
        if len(joined) < 2:
            return None
        at = np.array(sorted(joined))
        return float(np.polyfit((at + 0.5) * max(1, times) * self.bin_samples, [joined[b][1] / joined[b][0] for b in at.tolist()], 1)[0])


@dataclass
class OnlineSorter:
    """Nearest template in feature space; beyond ``reject`` no template (-1)."""

    templates: np.ndarray
    reject: float | None = None
    seen: int = 0
    rejected: int = 0

    def classify(self, v: np.ndarray) -> tuple[int, float]:
        d = np.sqrt(((self.templates - v) ** 2).sum(axis=1))
        k = int(np.argmin(d))
        self.seen += 1
        if self.reject is not None and d[k] > self.reject:
            self.rejected += 1
            return -1, float(d[k])
        return k, float(d[k])


@dataclass
class OnlineLearner:
    """Means of classes as they come; a class gives a template once it has enough spikes, and like templates become one."""

    least: int = 10
    merge: float = 0.95
    sums: dict = field(default_factory=dict)

    def add(self, cluster: int, wave: np.ndarray) -> None:
        n, s = self.sums.get(cluster, (0, np.zeros(len(wave))))
        self.sums[cluster] = n + 1, s + wave

    def templates(self) -> dict[int, np.ndarray]:
        out: dict[int, tuple[int, np.ndarray]] = {}
        for k, (n, s) in sorted(self.sums.items()):
            if n < self.least:
                continue
            m = s / n
            for j, (q, t) in out.items():
                if m @ t / max(np.linalg.norm(m) * np.linalg.norm(t), 1e-30) > self.merge:
                    out[j] = q + n, (q * t + n * m) / (q + n)
                    break
            else:
                out[k] = n, m
        return {k: t for k, (_, t) in out.items()}


def sort_channel(x: np.ndarray, fs: float, threshold: float = 5.0, width: int = 32, clusters: int = 4) -> dict:
    """One channel: noise, troughs, snippets, three components, two passes of seeded means, templates."""
    x = np.asarray(x, float)
    noise = float(np.median(np.abs(x)) / 0.6745)
    at = kernels.negative_peaks(x, threshold * noise, max(1, int(0.001 * fs)))
    at = at[(at >= width // 4) & (at - width // 4 + width <= len(x))]
    if not len(at):
        return {"sample": at, "label": at, "templates": np.zeros((0, width))}
    waves = x[(at - width // 4)[:, None] + np.arange(width)]
    f = waves - waves.mean(axis=0)
    if len(at) > 2:
        f = f @ linear.eigen_symmetric(np.cov(waves.T))[1][:, :3]
    centres = farthest_seeds(f, clusters)
    for _ in range(2):
        label = ((f[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([f[label == k].mean(axis=0) if (label == k).any() else centres[k] for k in range(len(centres))])
    label = ((f[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return {"sample": at, "label": label, "templates": np.array([waves[label == k].mean(axis=0) if (label == k).any() else np.zeros(width) for k in range(len(centres))])}


def channel_spikes(df: DataFrame, fs: float, threshold: float = 5.0, width: int = 32, clusters: int = 4) -> DataFrame:
    """(recording_id, channel, sample, label) of the one-channel sorter."""
    from sigloom.operators.temporal import KEYS

    def run(t: pa.Table) -> dict:
        s = sort_channel(t["value"].to_numpy(), fs, threshold, width, clusters)
        return {"sample": t["sample_idx"].to_numpy()[s["sample"]], "label": s["label"]}

    return per_group(df.select(*KEYS, "sample_idx", "value"), list(KEYS), run, "sample long, label int")
