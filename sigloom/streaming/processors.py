"""Online operators: the same kernels with their state in Spark's state store.

Rows of a channel may arrive in any order inside a micro-batch. With a watermark, a processor holds rows back in a map state,
an entry for each run of samples, and releases what the watermark has passed in order of ``sample_idx``; an event-time timer releases it even
if the channel sends nothing more. Rows behind the released sample are late: they are dropped, and every row put out says how
many were so far. Without a watermark each micro-batch is put in order and released at once. A row without a value ends its
channel: all that waits before it is released.

Input: (recording_id, channel, sample_idx, ts, value). Output: (recording_id, channel, sample_idx, y, late).

Sorters work alike: ``segments`` sorts frames of a recording segment by segment against a growing library of templates,
``classified`` names spikes by the nearest template and learns new ones.
"""

from __future__ import annotations

import math
import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sigloom.functions import kernels
from sigloom.functions.design import Section
from sigloom.operators.sorter import OnlineLearner, OnlineSorter, SortConfig, TemplateLibrary

OUTPUT = "recording_id long, channel long, sample_idx long, y double, late long"


class Step:
    """One operator: ``start()`` gives its state, ``run(values, state)`` the outputs and the state after them."""

    def start(self) -> Any:
        raise NotImplementedError

    def run(self, x: np.ndarray, state: Any) -> tuple[np.ndarray, Any]:
        raise NotImplementedError


class Cascade(Step):
    def __init__(self, sections: list[Section]):
        self.sections = sections

    def start(self):
        return np.zeros((len(self.sections), 4))

    def run(self, x, state):
        return kernels.cascade(x, self.sections, state)


class Moments(Step):
    """Running z-score with the current sample included; 0 below ``least`` samples or without spread."""

    def __init__(self, least: int = 2):
        self.least = least

    def start(self):
        return 0, 0.0, 0.0

    def run(self, x, state):
        n, mean, m2 = state
        out = np.zeros(len(x))
        for k, v in enumerate(x.tolist()):
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
            s = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            out[k] = (v - mean) / s if n >= self.least and s > 0 else 0.0
        return out, (n, mean, m2)


class Rms(Step):
    """Root mean square of the last ``width`` samples, NaN before."""

    def __init__(self, width: int):
        self.width = width

    def start(self):
        return np.zeros(0)

    def run(self, x, state):
        full = np.concatenate([state, x])
        c = np.concatenate([[0.0], np.cumsum(full**2)])
        end = np.arange(len(state), len(full)) + 1
        out = np.where(end >= self.width, np.sqrt(np.maximum(c[end] - c[np.maximum(end - self.width, 0)], 0) / self.width), np.nan)
        return out, full[max(0, len(full) - self.width + 1) :]


class Threshold(Step):
    """1 at hits; a hit silences the next ``refractory`` samples."""

    def __init__(self, threshold: float, refractory: int):
        self.threshold, self.refractory = threshold, refractory

    def start(self):
        return 0

    def run(self, x, state):
        out = np.zeros(len(x))
        for k, v in enumerate(np.abs(x).tolist()):
            if state > 0:
                state -= 1
            elif v > self.threshold:
                out[k], state = 1.0, self.refractory
        return out, state


class Percentile(Step):
    def __init__(self, p: float):
        self.p = p

    def start(self):
        return kernels.PSquare(self.p).__dict__

    def run(self, x, state):
        one = kernels.PSquare(self.p)
        one.__dict__.update(state)
        out = np.array([np.nan if (v := one.update(float(s))) is None else v for s in x])
        return out, one.__dict__


class Envelope(Step):
    def __init__(self, attack: float, release: float, squared: bool = False):
        self.options = attack, release, squared

    def start(self):
        return 0.0

    def run(self, x, state):
        out = kernels.envelope(x, *self.options, level=state)
        return out, float(out[-1]) if len(out) else state


class Adaptive(Step):
    """The error of an LMS filter that foretells a signal from its own past."""

    def __init__(self, taps: int, mu: float, epsilon: float | None = None):
        self.options = taps, mu, epsilon

    def start(self):
        return np.zeros(self.options[0]), np.zeros(self.options[0])

    def run(self, x, state):
        taps, mu, epsilon = self.options
        past, weights = state
        full = np.concatenate([past, x])
        out = np.zeros(len(x))
        for k in range(len(x)):
            line = full[k : k + taps][::-1]
            out[k] = x[k] - weights @ line
            weights = weights + (mu if epsilon is None else mu / (epsilon + line @ line)) * out[k] * line
        return out, (full[len(full) - taps :], weights)


class NearestTemplate(Step):
    """Index of the nearest of a few levels: the online sorter on one feature."""

    def __init__(self, levels: list[float]):
        self.levels = np.array(levels)

    def start(self):
        return None

    def run(self, x, state):
        return np.abs(x[:, None] - self.levels).argmin(axis=1).astype(float), state


class Matched(Step):
    """Matched filter: the unit template's product with the samples up to now where it passes the threshold, else 0; a hit silences the next ``refractory`` samples."""

    def __init__(self, template: list[float], threshold: float, refractory: int):
        t = np.asarray(template, float)
        self.shape, self.threshold, self.refractory = t / np.linalg.norm(t), threshold, refractory

    def start(self):
        return np.zeros(0), 0

    def run(self, x, state):
        past, wait = state
        full = np.concatenate([past, x])
        z = np.full(len(x), -np.inf)
        if len(full) >= len(self.shape):
            found = np.correlate(full, self.shape, "valid")
            z[len(x) - min(len(x), len(found)) :] = found[len(found) - min(len(x), len(found)) :]
        out = np.zeros(len(x))
        for k, v in enumerate(z.tolist()):
            if wait > 0:
                wait -= 1
            elif v > self.threshold:
                out[k], wait = v, self.refractory
        return out, (full[max(0, len(full) - len(self.shape) + 1) :], wait)


#: Samples that one entry of the map of waiting rows spans.
SPAN = 1024


class Waiting:
    """Rows that wait for the watermark: a map state by runs of ``SPAN`` samples, the last released sample and the late ones."""

    def __init__(self, handle: StatefulProcessorHandle, payload: str, ordered: bool):
        self.handle, self.ordered = handle, ordered
        self.rows = handle.getMapState("waiting", "run long", f"i array<long>, ts array<long>, v array<{payload}>")
        self.done = handle.getValueState("done", "last long, late long")

    def release(self, fresh: dict[int, tuple[int, Any]], watermark_ms: int, end: int | None) -> tuple[list[tuple[int, Any]], int]:
        """Puts rows in, and takes those out, in order, that nothing that still may come precedes; and the late rows so far."""
        last, late = self.done.get() or (-1, 0)  # each call to the store is a trip to the JVM
        own: dict[int, tuple[int, Any]] = {}
        if self.ordered:
            for _, (i, ts, v) in self.rows.iterator():
                own |= zip(i, zip(ts, v))
        held = {i // SPAN for i in own}
        late += sum(i <= last for i in fresh)
        own |= {i: row for i, row in fresh.items() if i > last}
        if end is not None:
            blocked = end
        else:
            blocked = min((i for i, (ts, _) in own.items() if ts >= watermark_ms), default=None) if self.ordered else None
        ready = sorted(i for i in own if blocked is None or i < blocked)
        out = [(i, own.pop(i)[1]) for i in ready]
        if self.ordered:
            left: dict[int, list[int]] = {}
            for i in sorted(own):
                left.setdefault(i // SPAN, []).append(i)
            for run in {i // SPAN for i in [*fresh, *ready]} | held - left.keys():  # what is as it was is not written again
                if run in left:
                    self.rows.updateValue((run,), (left[run], [own[i][0] for i in left[run]], [own[i][1] for i in left[run]]))
                elif run in held:
                    self.rows.removeKey((run,))
            if own:
                self.handle.registerTimer(min(ts for ts, _ in own.values()) + 1)
        self.done.update((ready[-1] if ready else last, late))
        return out, late


def _time(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def processor(step: Step, ordered: bool) -> StatefulProcessor:
    """A stateful processor of a step; ``ordered``: hold rows until the watermark has passed."""

    class Online(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.waiting = Waiting(handle, "double", ordered)
            self.state = handle.getValueState("state", "b binary")

        def advance(self, key, fresh, timer_values, end=None) -> Iterator[pd.DataFrame]:
            ready, late = self.waiting.release(fresh, timer_values.getCurrentWatermarkInMs() if ordered else 0, end)
            if ready:
                kept = self.state.get()
                inner = pickle.loads(bytes(kept[0])) if kept else step.start()
                y, inner = step.run(np.array([v for _, v in ready]), inner)
                self.state.update((pickle.dumps(inner),))
                yield pd.DataFrame({"recording_id": key[0], "channel": key[1], "sample_idx": [i for i, _ in ready], "y": y, "late": late})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh, end = {}, None
            for frame in rows:
                at = (pd.to_datetime(frame["ts"]).to_numpy("datetime64[ns]").view(np.int64) // 1_000_000).tolist()
                for i, ts, v in zip(frame["sample_idx"].tolist(), at, frame["value"].tolist()):
                    if v is None or v != v:
                        end = i if end is None else max(i, end)
                    else:
                        fresh[i] = (ts, v)
            yield from self.advance(key, fresh, timerValues, end)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.advance(key, {}, timerValues)

        def close(self) -> None:
            pass

    return Online()


def watched(rows: DataFrame, watermark: str) -> DataFrame:
    """``rows`` with a watermark on ``ts`` that drops none of them, so that processors see what is late and can count it.

    Spark drops rows behind the watermark ahead of a stateful operator. Here each row comes twice: a copy with a time
    moves the watermark and ends there, and the row itself has none, so that no filter on time holds for it.
    """
    clock = rows.withColumn("_clock", F.explode(F.array("ts", F.lit(None).cast("timestamp"))))
    return clock.withWatermark("_clock", watermark).where("_clock is null")


def online(stream: DataFrame, step: Step, watermark: str | None = None) -> DataFrame:
    """A stream of samples through a step. With ``watermark`` (a delay on ``ts``) order is restored across micro-batches."""
    rows = stream.select(F.col("recording_id").cast("long").alias("recording_id"), F.col("channel").cast("long").alias("channel"), F.col("sample_idx").cast("long").alias("sample_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = watched(rows, watermark) if watermark else rows
    return rows.groupBy("recording_id", "channel").transformWithStateInPandas(processor(step, bool(watermark)), OUTPUT, "Append", "EventTime" if watermark else "None")


SPIKES = "recording_id long, sample long, channel int, amplitude double, label int, late long"


def segments(stream: DataFrame, xy: np.ndarray, config: SortConfig, segment: int, watermark: str) -> DataFrame:
    """Spikes of frames (recording_id, sample_idx, ts, x): each segment is sorted once it is whole, in order, and its clusters are matched to the recording's library of templates.

    The state is the frames of a segment and the library. A frame without ``x`` ends its recording; its last segment is sorted
    as short as it is.
    """

    class Sorting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.waiting = Waiting(handle, "array<double>", True)
            self.frames = handle.getListState("frames", "i long, x array<double>")
            self.library = handle.getValueState("library", "b binary")

        def advance(self, key, fresh, timer_values, end=None) -> Iterator[pd.DataFrame]:
            ready, late = self.waiting.release(fresh, timer_values.getCurrentWatermarkInMs(), end)
            held = [(i, x) for i, x in self.frames.get()] if self.frames.exists() else []
            rows = held + [(i, list(x)) for i, x in ready]
            library = TemplateLibrary(config, xy, **(pickle.loads(bytes(self.library.get()[0])) if self.library.exists() else {}))
            done = 0
            while len(rows) - done >= segment or end is not None and len(rows) > done:
                part = rows[done : done + segment]
                library.samples = part[0][0]
                found = library.feed(np.array([x for _, x in part], float))
                done += len(part)
                if len(found.sample):
                    yield pd.DataFrame({"recording_id": key[0], "sample": found.sample, "channel": found.channel.astype(np.int32), "amplitude": found.amplitude, "label": found.label.astype(np.int32), "late": late})
            if done:
                self.library.update((pickle.dumps({k: v for k, v in vars(library).items() if k not in ("config", "xy")}),))
            if done or ready:
                self.frames.clear()
                if rows[done:]:
                    self.frames.put(rows[done:])

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh, end = {}, None
            for frame in rows:
                for i, ts, x in zip(frame["sample_idx"].tolist(), frame["ts"], frame["x"]):
                    if x is None:
                        end = i if end is None else max(i, end)
                    else:
                        fresh[i] = (_time(ts), [float(v) for v in x])
            yield from self.advance(key, fresh, timerValues, end)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.advance(key, {}, timerValues)

        def close(self) -> None:
            pass

    rows = stream.select(F.col("recording_id").cast("long").alias("recording_id"), F.col("sample_idx").cast("long").alias("sample_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("array<double>").alias("x"))
    return watched(rows, watermark).groupBy("recording_id").transformWithStateInPandas(Sorting(), SPIKES, "Append", "EventTime")


NAMED = "recording_id long, sample long, template_id int, distance double, seen long, rejected long"


def classified(stream: DataFrame, templates: np.ndarray, reject: float | None = None, learn: int | None = None) -> DataFrame:
    """Spikes (recording_id, sample, x) with the nearest template, -1 beyond ``reject``; counts of spikes and rejections so far.

    With ``learn``, the recording's own means take a template's place once it has had that many spikes. Spikes of a micro-batch
    are taken in order of their samples.
    """

    class Naming(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "b binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own, sums = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else ({"templates": np.array(templates, float), "reject": reject}, {})
            sorter, learner = OnlineSorter(**own), OnlineLearner(learn or 1, 1.0, sums)
            spikes = sorted(((int(i), np.array(x, float)) for frame in rows for i, x in zip(frame["sample"].tolist(), frame["x"]) if x is not None), key=lambda p: p[0])
            out = []
            for i, x in spikes:
                k, far = sorter.classify(x)
                if learn and k >= 0:
                    learner.add(k, x)
                    n, total = learner.sums[k]
                    if n >= learn:
                        sorter.templates[k] = total / n
                out.append((key[0], i, k, far, sorter.seen, sorter.rejected))
            self.state.update((pickle.dumps((vars(sorter), learner.sums)),))
            if out:
                yield pd.DataFrame(out, columns=["recording_id", "sample", "template_id", "distance", "seen", "rejected"]).astype({"template_id": "int32"})

        def close(self) -> None:
            pass

    rows = stream.select(F.col("recording_id").cast("long").alias("recording_id"), F.col("sample").cast("long").alias("sample"), F.col("x").cast("array<double>").alias("x"))
    return rows.groupBy("recording_id").transformWithStateInPandas(Naming(), NAMED, "Append", "None")


def windowed(stream: DataFrame, length: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Mean, deviation and size over event-time windows of each channel; late rows are dropped behind the watermark."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    stats = stream.withWatermark("ts", watermark).groupBy("channel", span).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))
    return stats.select("channel", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n")


def bursts(stream: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Sessions of events that follow each other within ``gap``."""
    runs = stream.withWatermark("ts", watermark).groupBy("channel", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return runs.select("channel", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_stats(df: DataFrame, name: str = "run") -> DataFrame:
    """Observed metrics of a run (frames, hits and drops where there are such columns), read by a query listener."""
    parts = [F.count("*").alias("frames")]
    parts += [F.count_if(F.col(c).cast("boolean")).alias(f"n_{c}") for c in ("spike", "classified", "dropped") if c in df.columns]
    return df.observe(name, *parts)


def stale(last_sample: int, now_sample: int, timeout: int) -> bool:
    """Whether no sample came for longer than ``timeout``."""
    return now_sample - last_sample > timeout


@dataclass
class WatchdogConfig:
    """How long a query may go without new rows, and what is done then (``act`` gets the query's id and the seconds waited)."""

    timeout_seconds: float = 5.0
    act: Callable[[str, float], None] | None = None


class Watchdog(StreamingQueryListener):
    """A listener of a session's queries: notes progress, and reports those that went without rows for too long, once each time."""

    def __init__(self, config: WatchdogConfig = WatchdogConfig(), clock: Callable[[], float] = time.monotonic):
        self.config, self.clock = config, clock
        self.last: dict[str, float] = {}
        self.rows: dict[str, int] = {}
        self.barked: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = self.clock()

    def onQueryProgress(self, event) -> None:
        self.feed(str(event.progress.id), int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.check()

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)

    def feed(self, query: str, rows: int) -> None:
        self.rows[query] = self.rows.get(query, 0) + rows
        if rows:
            self.last[query] = self.clock()
            self.barked.discard(query)
        self.check()

    def check(self) -> list[str]:
        """The queries that are stale now."""
        now, out = self.clock(), []
        for query, last in list(self.last.items()):
            if stale(last, now, self.config.timeout_seconds):
                out.append(query)
                if query not in self.barked and self.config.act:
                    self.config.act(query, now - last)
                self.barked.add(query)
        return out


def into(sink: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Starts a query that hands each micro-batch to a function (packets, tables)."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
