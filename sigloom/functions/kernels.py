"""Numpy bodies of the order-dependent operators. One signal in, one array (or several) out; no Spark here."""

from __future__ import annotations

import math

import numpy as np

from sigloom.functions.design import Section


# Linear recurrences -------------------------------------------------------------------------------


def section_response(section: Section, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How a block of zeros answers to y[-1] = 1 and to y[-2] = 1."""
    _, _, _, a1, a2 = section
    out = np.zeros((2, length + 2))
    out[0, 1] = out[1, 0] = 1.0
    for k in range(2, length + 2):
        out[:, k] = -a1 * out[:, k - 1] - a2 * out[:, k - 2]
    return out[0, 2:], out[1, 2:]


def biquad(x: np.ndarray, section: Section, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One section over x; ``state`` is (x[-1], x[-2], y[-1], y[-2]). Blocks run side by side, then their ends are joined."""
    x = np.asarray(x, float)
    b0, b1, b2, a1, a2 = section
    x1, x2, y1, y2 = state if state is not None else (0.0, 0.0, 0.0, 0.0)
    n = len(x)
    if not n:
        return x, np.array([x1, x2, y1, y2])
    full = np.concatenate([[x2, x1], x])
    u = b0 * full[2:] + b1 * full[1:-1] + b2 * full[:-2]
    width = max(1, math.isqrt(n))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width)
    padded[:n] = u
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for k in range(width):
        if k > 0:
            grid[k] -= a1 * grid[k - 1]
        if k > 1:
            grid[k] -= a2 * grid[k - 2]
    if a1 or a2:
        h1, h2 = section_response(section, width)
        e1, e2 = np.zeros(blocks), np.zeros(blocks)
        for k in range(blocks):
            e1[k], e2[k] = y1, y2
            last = grid[-1, k] + h1[-1] * y1 + h2[-1] * y2
            y2 = grid[-2, k] + h1[-2] * y1 + h2[-2] * y2 if width > 1 else y1
            y1 = last
        grid = grid + np.outer(h1, e1) + np.outer(h2, e2)
    y = grid.T.reshape(-1)[:n]
    tail = np.concatenate([[state[3], state[2]] if state is not None else [0.0, 0.0], y])
    return y, np.array([full[-1], full[-2], tail[-1], tail[-2]])


def cascade(x: np.ndarray, sections: list[Section], state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after another; ``state`` has a row for each."""
    out = np.zeros((len(sections), 4)) if state is None else np.array(state, float)
    for k, s in enumerate(sections):
        x, out[k] = biquad(x, s, out[k])
    return np.asarray(x, float), out


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    return np.convolve(np.asarray(x, float), np.asarray(taps, float))[: len(x)]


def median_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Median of the last ``width`` samples, zeros before the first; even widths: see ``median_index``."""
    padded = np.concatenate([np.zeros(width - 1), np.asarray(x, float)])
    if len(padded) < width:
        return np.zeros(0)
    return np.sort(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)[:, median_index(width)]


def median_index(width: int) -> int:
    """The middle; of even widths the lower middle up to 6, the upper above 7."""
    return width // 2 if width % 2 or width > 7 else width // 2 - 1


def envelope(x: np.ndarray, attack: float, release: float, squared: bool = False, level: float = 0.0) -> np.ndarray:
    """One-pole follower of |x| (or x^2) with coefficients for rising and falling."""
    out = np.zeros(len(x))
    for k, v in enumerate((np.square(x) if squared else np.abs(x)).tolist()):
        level += (attack if v > level else release) * (v - level)
        out[k] = level
    return out


def lms(u: np.ndarray, d: np.ndarray, taps: int, mu: float = 0.01, epsilon: float | None = None, weights: np.ndarray | None = None, learn: bool = True, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output, error, weights) of the least-mean-squares filter; normalised where ``epsilon`` is given. ``before``: samples ahead of ``u``, else zeros."""
    w = np.zeros(taps) if weights is None else np.array(weights, float)
    past = np.zeros(0) if before is None or taps == 1 else np.asarray(before, float)[1 - taps :]
    padded = np.concatenate([np.zeros(taps - 1 - len(past)), past, np.asarray(u, float)])
    y, e = np.zeros(len(u)), np.zeros(len(u))
    for k in range(len(u)):
        line = padded[k : k + taps][::-1]
        y[k] = w @ line
        e[k] = d[k] - y[k]
        if learn:
            w = w + (mu if epsilon is None else mu / (epsilon + line @ line)) * e[k] * line
    return y, e, w


# Thresholds and wavelets --------------------------------------------------------------------------


def soft_threshold(x: np.ndarray, limit: float) -> np.ndarray:
    x = np.asarray(x, float)
    return x if limit <= 0 else np.sign(x) * np.maximum(np.abs(x) - limit, 0)


def hard_threshold(x: np.ndarray, limit: float) -> np.ndarray:
    x = np.asarray(x, float)
    return x if limit <= 0 else np.where(np.abs(x) >= limit, x, 0.0)


def universal_threshold(sigma: float, n: int) -> float:
    return 0.0 if n <= 1 else sigma * math.sqrt(2 * math.log(n))


def denoise_haar(x: np.ndarray, levels: int, hard: bool = False) -> np.ndarray:
    """Undecimated Haar transform with circular indices, thresholds on all details, mean of both inverses."""
    now, details = np.asarray(x, float), []
    for k in range(levels):
        past = np.roll(now, 1 << k)
        details.append((past - now) / math.sqrt(2))
        now = (past + now) / math.sqrt(2)
    limit = universal_threshold(float(np.median(np.abs(details[0]))) / 0.6745, len(now))
    for k in reversed(range(levels)):
        d = (hard_threshold if hard else soft_threshold)(details[k], limit)
        now = ((now - d) + np.roll(now + d, -(1 << k))) / (2 * math.sqrt(2))
    return now


def neo(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x[1:-1] ** 2 - x[:-2] * x[2:] if len(x) > 2 else np.zeros(0)


def sneo(x: np.ndarray, half: int) -> np.ndarray:
    """NEO under a triangular window, divided by the whole window's weight at the edges too."""
    e = neo(x)
    taps = half + 1 - np.abs(np.arange(-half, half + 1.0))
    return np.convolve(e, taps)[half : half + len(e)] / taps.sum() if len(e) else e


class Oasis:
    """Pools of a trace deconvolved as it comes: (value, weight, length) each, from the oldest on.

    A sample becomes a pool; then, from the newest pair to the oldest, pools become one where the later begins above what the earlier
    decays to. The two oldest become one where ``most`` are held (None: any number).
    """

    def __init__(self, gamma: float, penalty: float, baseline: float = 0.0, most: int | None = None):
        self.gamma, self.rise, self.baseline, self.most = gamma, penalty * (1 - gamma), baseline, most
        self.pools: list[tuple[float, float, int]] = []
        self.last = 0.0

    def _joined(self, a: tuple[float, float, int], b: tuple[float, float, int]) -> tuple[float, float, int]:
        share = self.gamma ** a[2] * b[1]
        weight = a[1] + share
        return (a[1] * a[0] + share * b[0]) / weight, weight, a[2] + b[2]

    def run(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(calcium, spike) of the next samples."""
        calcium = np.zeros(len(f))
        for t, v in enumerate(np.maximum(np.asarray(f, float) - self.baseline, 0.0).tolist()):
            if self.most and len(self.pools) >= self.most:
                self.pools[:2] = [self._joined(*self.pools[:2])] if len(self.pools) > 1 else self.pools
            swept, now = [], (v, 1.0, 1)
            for earlier in reversed(self.pools):
                if now[0] > self.gamma * earlier[0] + self.rise:
                    now = self._joined(earlier, now)
                else:
                    swept.append(now)
                    now = earlier
            swept.append(now)
            self.pools = swept[::-1]
            calcium[t] = self.pools[-1][0]
        spike = np.maximum(calcium - self.gamma * np.concatenate([[self.last], calcium[:-1]]), 0) if len(calcium) else calcium
        self.last = float(calcium[-1]) if len(calcium) else self.last
        return calcium, spike


def oasis(f: np.ndarray, gamma: float, penalty: float, baseline: float = 0.0, most: int | None = 256) -> tuple[np.ndarray, np.ndarray]:
    """(calcium, spike) of a whole trace."""
    return Oasis(gamma, penalty, baseline, most).run(f)


# Streaming percentile -----------------------------------------------------------------------------


class PSquare:
    """The P-square estimate of one percentile with five markers; None before five samples."""

    def __init__(self, p: float):
        self.p, self.q, self.n, self.first = p, [], [], []
        self.wish = [0.0] * 5

    def update(self, x: float) -> float | None:
        if len(self.first) < 5:
            self.first.append(x)
            if len(self.first) == 5:
                self.q, self.n = sorted(self.first), [1, 2, 3, 4, 5]
                self.wish = [1, 1 + 2 * self.p, 1 + 4 * self.p, 3 + 2 * self.p, 5]
            return self.value()
        q, n = self.q, self.n
        q[0], q[4] = min(q[0], x), max(q[4], x)
        cell = next((k for k in range(3) if x < q[k + 1]), 3)
        for k in range(cell + 1, 5):
            n[k] += 1
        for k, step in enumerate((0, self.p / 2, self.p, (1 + self.p) / 2, 1)):
            self.wish[k] += step
        for k in (1, 2, 3):
            gap = self.wish[k] - n[k]
            if gap >= 1 and n[k + 1] - n[k] > 1 or gap <= -1 and n[k - 1] - n[k] < -1:
                d = 1 if gap > 0 else -1
                up, down = (q[k + 1] - q[k]) / (n[k + 1] - n[k]), (q[k] - q[k - 1]) / (n[k] - n[k - 1])
                curve = q[k] + d / (n[k + 1] - n[k - 1]) * ((n[k] - n[k - 1] + d) * up + (n[k + 1] - n[k] - d) * down)
                q[k] = curve if q[k - 1] < curve < q[k + 1] else q[k] + d * (q[k + d] - q[k]) / (n[k + d] - n[k])
                n[k] += d
        return self.value()

    def value(self) -> float | None:
        return self.q[2] if len(self.first) == 5 else None


def p_square(x: np.ndarray, p: float) -> np.ndarray:
    one = PSquare(p)
    return np.array([np.nan if (v := one.update(float(s))) is None else v for s in x])


# Detection ----------------------------------------------------------------------------------------


def refractory_positions(at: np.ndarray, refractory: int) -> list[int]:
    """Which of the rising sample numbers are hits, where each hit silences the next ``refractory`` samples."""
    out, free = [], -math.inf
    for k, t in enumerate(at.tolist()):
        if t >= free:
            out.append(k)
            free = t + refractory + 1
    return out


def refractory_hits(over: np.ndarray, refractory: int) -> np.ndarray:
    """The samples that are hits."""
    at = np.flatnonzero(over)
    return at[refractory_positions(at, refractory)]


def first_hits(frames: np.ndarray, threshold: float, refractory: int, number: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(row, channel, value) where only the first channel of a frame may hit; later channels keep their counters.

    ``number``: the frames' places, where those without any sample beyond the threshold are left out.
    """
    wait = [0] * frames.shape[1]
    out, before = [], None
    for t, (row, place) in enumerate(zip(frames.tolist(), range(len(frames)) if number is None else number.tolist())):
        quiet = 0 if before is None else place - before - 1
        before = place
        if quiet:
            wait = [max(0, w - quiet) for w in wait]
        for c, v in enumerate(row):
            if wait[c] > 0:
                wait[c] -= 1
            elif abs(v) > threshold:
                wait[c] = refractory
                out.append((t, c, v))
                break
    return out


def negative_peaks(x: np.ndarray, threshold: float, refractory: int) -> np.ndarray:
    """Below -threshold: the least sample of the next ``refractory`` ones, then on from behind them."""
    x = np.asarray(x, float)
    out, free = [], 0
    for k in np.flatnonzero(x < -threshold).tolist():
        if k >= free:
            out.append(k + int(np.argmin(x[k : k + max(1, refractory)])))
            free = k + max(1, refractory)
    return np.array(out, np.int64)


def keep_larger(sample: np.ndarray, amplitude: np.ndarray, near, radius: int) -> np.ndarray:
    """Which of the events, ordered by sample, stay: of two close ones the larger (the earlier of equals)."""
    alive = np.ones(len(sample), bool)
    for i in range(len(sample)):
        j = i + 1
        while alive[i] and j < len(sample) and sample[j] - sample[i] <= radius:
            if alive[j] and near(i, j):
                if amplitude[j] > amplitude[i]:
                    alive[i] = False
                else:
                    alive[j] = False
            j += 1
    return alive


def keep_larger_placed(sample: np.ndarray, amplitude: np.ndarray, x: np.ndarray, y: np.ndarray, radius_um: float, radius: int, chunk: int = 1 << 16) -> np.ndarray:
    """``keep_larger`` of events at places: each meets those of its cell of the plane and of the cells around it only."""
    n = len(sample)
    width = radius_um * (1 + 1e-9) if radius_um > 0 else 1.0
    cx, cy = (np.floor(np.nan_to_num(v) / width).astype(np.int64) for v in (x, y))
    columns, inverse = np.unique(np.stack([cx, cy], axis=1), axis=0, return_inverse=True) if n else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    cell = inverse.reshape(-1).astype(np.int64)
    number = {tuple(c): k for k, c in enumerate(columns.tolist())}
    around = [np.array([number.get((a + dx, b + dy), -1) for a, b in columns.tolist()], np.int64) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    low = int(sample[0]) if n else 0
    span = int(sample[-1]) - low + radius + 2 if n else 1
    key = cell * span + (sample - low)
    order = np.argsort(key, kind="stable")
    key = key[order]
    alive, size = bytearray(b"\x01") * n, amplitude.tolist()
    for start in range(0, n, chunk):
        i = np.arange(start, min(start + chunk, n))
        ours, theirs = [], []
        for near in around:
            c = near[cell[i]]
            at = c * span + (sample[i] - low)
            a, b = np.searchsorted(key, at), np.searchsorted(key, at + radius, side="right")
            count = np.where(c >= 0, b - a, 0)
            ours.append(np.repeat(i, count))
            theirs.append(order[np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())])
        p, q = np.concatenate(ours), np.concatenate(theirs)
        close = (q > p) & ((x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= radius_um**2)
        p, q = p[close], q[close]
        sort = np.lexsort((q, p))
        p, q = p[sort], q[sort].tolist()
        ends = np.searchsorted(p, i, side="right").tolist()
        begin = 0
        for k, end in zip(i.tolist(), ends):
            if alive[k]:
                for j in q[begin:end]:
                    if alive[j]:
                        if size[j] > size[k]:
                            alive[k] = 0
                            break
                        alive[j] = 0
            begin = end
    return np.frombuffer(bytes(alive), np.uint8).astype(bool)


def firmware_detector(raw: np.ndarray, factor: float, level: float = 0.0, noise: float = 0.0) -> np.ndarray:
    """Hits of |x - level| > factor * noise with running level and noise and one hit for each excursion; x = raw / 32768."""
    inside, out = False, []
    for k, v in enumerate((np.asarray(raw, float) / 32768).tolist()):
        level += 0.002 * (v - level)
        gap = abs(v - level)
        noise += 0.001 * (gap - noise)
        over = gap > factor * max(noise, 1 / 32768)
        if over and not inside:
            out.append(k)
        inside = over
    return np.array(out, np.int64)


# Templates ----------------------------------------------------------------------------------------


def peel(x: np.ndarray, times: list[int], templates: np.ndarray, low: np.ndarray, high: np.ndarray, before: int, rounds: int, failures: int = 3) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(residual, [(sample, template, amplitude)]): the best template is taken off at each time while its size is allowed."""
    x, found = np.array(x, float), []
    norms, width = (templates**2).sum(axis=1), templates.shape[1]
    failed = {k: 0 for k, t in enumerate(times) if t >= before and t - before + width <= len(x)}
    for _ in range(rounds):
        again = False
        for k in list(failed):
            part = slice(times[k] - before, times[k] - before + width)
            dots = templates @ x[part]
            best = int(np.argmax(np.abs(dots)))
            if norms[best] < 1e-30:
                del failed[k]
                continue
            size = dots[best] / norms[best]
            if low[best] <= size <= high[best]:
                x[part] -= size * templates[best]
                found.append((times[k], best, float(size)))
                again = True
            else:
                failed[k] += 1
                if failed[k] >= failures:
                    del failed[k]
        if not again:
            break
    return x, found


def matched_statistic(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Inner product of the unit template with the signal from each sample on."""
    norm = math.sqrt(float(template @ template))
    return np.correlate(np.asarray(x, float), template, "valid") / norm if len(x) >= len(template) and 0 < norm < math.inf else np.zeros(0)


def matched_peaks(z: np.ndarray, threshold: float, refractory: int) -> np.ndarray:
    """Where z exceeds the threshold: its largest sample of the next ``refractory`` ones, then on behind them."""
    return negative_peaks(-z, threshold, refractory)


# Trains -------------------------------------------------------------------------------------------


def match_first(truth: list[int], found: list[int], tolerance: int, times: list[int] | None = None, held: list[int] | None = None) -> int:
    """Matches of sorted trains: each true spike takes the first free found one within the tolerance. ``times``, ``held``: how many of each there are.

    What lies before the first free one is taken, or too early for all that follow.
    """
    left = [1] * len(found) if held is None else list(held)
    at, hits = 0, 0
    for t, n in zip(truth, [1] * len(truth) if times is None else times):
        while n and at < len(found) and found[at] <= t + tolerance:
            took = min(n, left[at]) if found[at] >= t - tolerance else 0
            hits, n, left[at] = hits + took, n - took, left[at] - took
            if not n and left[at]:
                break
            at += 1
    return hits


def match_nearest(truth: list[int], found: list[int], tolerance: int, times: list[int] | None = None, held: list[int] | None = None) -> int:
    """Matches where each true spike takes the nearest free one within the tolerance; counts as in ``match_first``."""
    found_ = np.asarray(found, np.int64)
    left, hits = np.ones(len(found_), np.int64) if held is None else np.array(held, np.int64), 0
    for t, n in zip(truth, [1] * len(truth) if times is None else times):
        a, b = np.searchsorted(found_, [t - tolerance, t + tolerance + 1])
        free = np.flatnonzero(left[a:b]) + a
        for k in free[np.argsort(np.abs(found_[free] - t), kind="stable")].tolist():
            if not n:
                break
            took = min(n, int(left[k]))
            hits, n, left[k] = hits + took, n - took, left[k] - took
    return hits


# Entropy ------------------------------------------------------------------------------------------


def _close(x: np.ndarray, m: int, n: int, r: float) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(x, m)[:n]
    return np.abs(w[:, None, :] - w[None, :, :]).max(axis=2) < r


def sample_entropy(x: np.ndarray, m: int, r: float) -> float:
    """-ln(A / B) over pairs of the first n - m starts; infinite without matches."""
    x = np.asarray(x, float)
    n = len(x) - m
    if n < 2:
        return math.inf
    b, a = (np.triu(_close(x, k, n, r), 1).sum() for k in (m, m + 1))
    return math.inf if not a or not b else -math.log(a / b)


def approximate_entropy(x: np.ndarray, m: int, r: float) -> float:
    x = np.asarray(x, float)
    phi = lambda k: float(np.log(_close(x, k, len(x) - k + 1, r).mean(axis=1)).mean())
    return 0.0 if len(x) < m + 2 else max(0.0, phi(m) - phi(m + 1))


def coarse_grain(x: np.ndarray, scale: int) -> np.ndarray:
    n = len(x) // scale
    return np.asarray(x[: n * scale], float).reshape(n, scale).mean(axis=1)


def multiscale_entropy(x: np.ndarray, scale: int, m: int, r: float) -> float:
    return sample_entropy(coarse_grain(x, scale), m, r)
