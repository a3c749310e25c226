"""Recurrences along channels of any length: streams that carry a state, and blocks whose effects on a state are composed.

``scanned`` sorts and streams: a task holds one batch of a channel and the state. ``scanned_in_blocks`` makes a channel as many
tasks as it has blocks: each block gives what it does to any state that it may be entered with, these effects are chained along the
channel (a few numbers a block), and every block runs again from its true state. Adaptive filters do something affine to
their weights, followers something monotone and piecewise linear to their level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigloom.operators.temporal import KEYS

BLOCK = 1 << 16


def scanned(df: DataFrame, columns: list[str], step: Callable, schema: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, sample_idx, schema): ``step(arrays, state)`` gets the next samples of a channel and what it returned before them.

    ``arrays`` maps ``columns`` to numpy arrays; the state is None at a channel's start. ``step`` returns a dict of arrays as
    long as those, named as in ``schema`` (doubles), and the state.
    """
    rows = df.select(*keys, "sample_idx", *(F.col(c).cast("double").alias(c) for c in columns)).repartition(*keys).sortWithinPartitions(*keys, "sample_idx")
    names = [c.split()[0] for c in schema.split(", ")]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in range(n):
                column = batch.column(k)
                differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                new[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new).tolist()
            parts: dict[str, list] = {c: [] for c in names}
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(k)[s].as_py() for k in range(n))
                if key != held:
                    held, state = key, None
                arrays = {c: batch.column(n + 1 + k).slice(s, e - s).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)}
                out, state = step(arrays, state)
                for c in names:
                    parts[c].append(np.asarray(out[c], float))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *(pa.array(np.concatenate(parts[c])) for c in names)], names=[*keys, "sample_idx", *names])

    head = StructType([rows.schema[k] for k in (*keys, "sample_idx")])
    return rows.mapInArrow(run, StructType([*head, *StructType.fromDDL(schema)]))


def scanned_in_blocks(df: DataFrame, columns: list[str], effect: Callable, entered: Callable, step: Callable, schema: str, block: int = BLOCK, past: int = 0) -> DataFrame:
    """The same with tasks of one block.

    ``effect(arrays, before)`` gives what a block does to a state, as an array; ``entered(effects)`` turns a channel's effects, in order,
    into the states that its blocks are entered with; ``step(arrays, before, state)`` runs a block. ``before`` holds the ``past`` samples ahead of the
    block (fewer at the channel's start), which blocks get copies of.
    """
    from sigloom.operators.signals import per_group

    at = lambda c: F.floor(c / block).cast("long")
    i = F.col("sample_idx")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.select(*KEYS, "sample_idx", *(F.col(c).cast("double").alias(c) for c in columns), F.explode(F.sequence(at(i), at(i + past))).alias("block"))
    keys = [*KEYS, "block"]

    def cut(t: pa.Table) -> tuple[dict, dict, np.ndarray]:
        where = t["sample_idx"].to_numpy()
        own = where // block == t["block"][0].as_py()
        every = {c: t[c].to_numpy() for c in columns}
        return {c: v[own] for c, v in every.items()}, {c: v[~own] for c, v in every.items()}, where[own]

    def end(t: pa.Table) -> dict:
        arrays, before, where = cut(t)
        return {"effect": [effect(arrays, before)] if len(where) else []}

    def chain(t: pa.Table) -> dict:
        return {"block": t["block"].combine_chunks(), "state": entered([np.array(e) for e in t["effect"].to_pylist()])}

    def again(t: pa.Table) -> dict:
        arrays, before, where = cut(t)
        out = step(arrays, before, np.array(t["state"][0].as_py()))
        return {"sample_idx": where, **{c: np.asarray(out[c], float) for c in names}}

    effects = per_group(rows, keys, end, "effect array<double>")
    states = per_group(effects, list(KEYS), chain, "block long, state array<double>", "block")
    return per_group(rows.join(states, keys), keys, again, f"sample_idx long, {schema}").drop("block")


# Followers ----------------------------------------------------------------------------------------


def follower_effect(x: np.ndarray, attack: float, release: float) -> np.ndarray:
    """What samples do to a level at or above 0: pieces (from, slope, offset), continuous and rising.

    A sample splits the piece whose values it falls into: below it levels rise, above it they fall.
    """
    start, slope, offset = np.zeros(1), np.ones(1), np.zeros(1)
    for k, v in enumerate(x.tolist()):
        low = slope * start + offset  # what each piece begins with
        at = int(np.searchsorted(low, v, side="right")) - 1  # the last that begins at or below the sample
        if at >= 0 and slope[at] > 1e-200:
            cut = (v - offset[at]) / slope[at]
            if cut > start[at] and (at + 1 == len(start) or cut < start[at + 1]):
                start, slope, offset = (np.insert(a, at + 1, b) for a, b in ((start, cut), (slope, slope[at]), (offset, offset[at])))
                low = np.insert(low, at + 1, v)
        c = np.where(low < v, attack, release)
        slope, offset = slope * (1 - c), offset + c * (v - offset)
        if k % 64 == 63 and len(start) > 2:  # pieces that say the same in doubles are one
            value = slope * start + offset
            keep = np.r_[True, value[1:] > value[:-1]]
            keep[-1] = True
            start, slope, offset = start[keep], slope[keep], offset[keep]
    return np.stack([start, slope, offset])


def followed(effects: list[np.ndarray]) -> list[np.ndarray]:
    """The levels that blocks are entered with, from 0."""
    level, out = 0.0, []
    for e in effects:
        out.append(np.array([level]))
        start, slope, offset = e.reshape(3, -1)
        k = max(0, int(np.searchsorted(start, level, side="right")) - 1)
        level = slope[k] * level + offset[k]
    return out


# Adaptive filters ---------------------------------------------------------------------------------


def adaptive_effect(u: np.ndarray, d: np.ndarray, taps: int, mu: float, epsilon: float | None, before: np.ndarray) -> np.ndarray:
    """What samples do to the weights: a matrix and a vector, side by side."""
    padded = np.concatenate([np.zeros(max(0, taps - 1 - len(before))), before[len(before) - taps + 1 :] if taps > 1 else [], u])
    move = np.eye(taps, taps + 1)
    for k in range(len(u)):
        line = padded[k : k + taps][::-1]
        gain = mu if epsilon is None else mu / (epsilon + line @ line)
        gap = -(line @ move)
        gap[taps] += d[k]
        move += np.outer(gain * line, gap)
    return move


def adapted(effects: list[np.ndarray], taps: int) -> list[np.ndarray]:
    """The weights that blocks are entered with, from 0."""
    w, out = np.zeros(taps), []
    for e in effects:
        out.append(w)
        move = e.reshape(taps, taps + 1)
        w = move[:, :taps] @ w + move[:, taps]
    return out
