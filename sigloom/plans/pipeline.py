"""Pipelines of stages, from code or from a description (a dict, or a file of JSON or TOML).

A stage maps a table of long samples to another. Stages of window expressions are left to the optimizer; neighbouring
array stages of one channel become one Arrow task.
"""

from __future__ import annotations

import json
import math
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sigloom.functions import design, kernels, spectrum
from sigloom.operators import signals, spatial, temporal
from sigloom.sources import synthetic


@dataclass(frozen=True)
class Stage:
    """``table`` maps a table, or ``kernel`` maps one channel's samples; ``rate`` is output samples for each input sample."""

    name: str
    table: Callable[[DataFrame], DataFrame] | None = None
    kernel: Callable[[np.ndarray], np.ndarray] | None = None
    rate: float = 1.0


def fused(stages: list[Stage]) -> list[Stage]:
    """Neighbouring kernels as one stage."""
    out: list[Stage] = []
    for s in stages:
        if s.kernel and out and out[-1].kernel:
            first, then = out[-1].kernel, s.kernel
            out[-1] = Stage(f"{out[-1].name}+{s.name}", kernel=lambda x, a=first, b=then: b(a(x)))
        else:
            out.append(s)
    return out


def apply(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Runs stages in order; kernels replace ``value``."""

    def one(rows: DataFrame, s: Stage) -> DataFrame:
        if s.table:
            return s.table(rows)
        return signals.per_channel(rows, s.kernel, "filtered").drop("value").withColumnRenamed("filtered", "value")

    return reduce(one, fused(stages), df)


def output_length(stages: list[Stage], samples: int) -> int:
    return int(reduce(lambda n, s: n * s.rate, stages, samples))


def _sections(sections) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: kernels.cascade(x, sections)[0]


def stage_of(spec: dict, fs: float) -> Stage:
    """A stage from its description, ``{"type": ..., parameters}``."""
    kind, n = spec["type"], int(spec.get("order", 4)) // 2
    if kind == "lowpass":
        return Stage(kind, kernel=_sections(design.lowpass_sections(fs, spec["cutoff"], n)))
    if kind == "highpass":
        return Stage(kind, kernel=_sections(design.highpass_sections(fs, spec["cutoff"], n)))
    if kind == "bandpass":
        return Stage(kind, kernel=_sections(design.bandpass_sections(fs, spec["low"], spec["high"], n)))
    if kind == "notch":
        return Stage(kind, kernel=_sections(design.notch_bank(fs, spec["frequency"], int(spec.get("harmonics", 1)), spec.get("q", 30.0))))
    if kind == "fir":
        return Stage(kind, kernel=lambda x: kernels.fir(x, np.array(spec["taps"])))
    if kind == "car":
        return Stage(kind, table=spatial.average_reference_long)
    if kind == "laplacian":
        def surface(df: DataFrame) -> DataFrame:
            near = spatial.linear_neighbors(df.sparkSession, int(spec["channels"]))
            return spatial.laplacian(df, spatial.laplacian_weights(near))

        return Stage(kind, table=surface)
    if kind == "decimate":
        return Stage(kind, table=lambda df: temporal.decimate(df, int(spec["factor"])), rate=1 / int(spec["factor"]))
    if kind == "interpolate":
        return Stage(kind, table=lambda df: temporal.interpolate(df, int(spec["factor"]), spec.get("method", "linear")), rate=int(spec["factor"]))
    raise ValueError(f"unknown stage: {kind}")


#: Ready descriptions.
RECIPES = {
    "lowpass_noise": {"signal": {"type": "composite", "fs": 1000.0, "samples": 4000, "parts": [[10.0, 1.0]], "noise": 0.5}, "filters": [{"type": "lowpass", "cutoff": 40.0}]},
    "alpha_band": {"signal": {"type": "composite", "fs": 250.0, "samples": 2500, "parts": [[10.0, 1.0], [50.0, 0.5]], "noise": 0.1}, "filters": [{"type": "notch", "frequency": 50.0}, {"type": "bandpass", "low": 8.0, "high": 12.0}]},
    "chirp_highpass": {"signal": {"type": "chirp", "fs": 1000.0, "samples": 4000, "start": 1.0, "end": 200.0}, "filters": [{"type": "highpass", "cutoff": 50.0}]},
    "step_decimated": {"signal": {"type": "step", "fs": 100.0, "samples": 1000, "at": 500, "low": 0.0, "high": 1.0}, "filters": [{"type": "lowpass", "cutoff": 10.0}, {"type": "decimate", "factor": 4}]},
    "impulse_response": {"signal": {"type": "impulses", "fs": 1000.0, "samples": 2000, "rate": 2.0}, "filters": [{"type": "bandpass", "low": 20.0, "high": 60.0}]},
}


def signal_of(spark: SparkSession, spec: dict) -> DataFrame:
    n, fs = int(spec["samples"]), float(spec["fs"])
    make = {
        "sine": lambda: synthetic.sine(spark, n, fs, spec["frequency"], spec.get("amplitude", 1.0)),
        "noise": lambda: synthetic.white_noise(spark, n, spec.get("amplitude", 1.0), spec.get("seed", 1)),
        "chirp": lambda: synthetic.chirp(spark, n, fs, spec["start"], spec["end"]),
        "impulses": lambda: synthetic.impulses(spark, n, fs, spec["rate"]),
        "composite": lambda: synthetic.composite(spark, n, fs, [tuple(p) for p in spec["parts"]], spec.get("noise", 0.0), spec.get("seed", 1)),
        "step": lambda: synthetic.step(spark, n, int(spec["at"]), spec["low"], spec["high"]),
    }
    return make[spec["type"]]()


def described(job: dict | str) -> dict:
    """A job as it is, a recipe by name, or the job of a TOML or JSON file that the driver can read."""
    if not isinstance(job, str):
        return job
    if job in RECIPES:
        return RECIPES[job]
    with open(job, "rb") as lines:
        return tomllib.load(lines) if job.endswith(".toml") else json.load(lines)


def run(spark: SparkSession, job: dict | str) -> DataFrame:
    """A described job: signal, filters, and an optional ``output`` {"csv" | "parquet": path}."""
    job = described(job)
    fs = float(job["signal"]["fs"])
    out = apply(signal_of(spark, job["signal"]), [stage_of(s, fs) for s in job.get("filters", [])])
    for kind, path in job.get("output", {}).items():
        out.write.mode("overwrite").format(kind).save(path)
    return out


def write_stages(spark: SparkSession, job: dict, folder: str) -> list[str]:
    """The table behind each stage as CSV, one folder a stage."""
    fs, now, out = float(job["signal"]["fs"]), signal_of(spark, job["signal"]), []
    for k, s in enumerate([None, *(stage_of(x, fs) for x in job.get("filters", []))]):
        now = apply(now, [s]) if s else now
        out.append(f"{folder}/{k:02d}_{s.name if s else 'signal'}")
        now.orderBy("channel", "sample_idx").write.mode("overwrite").csv(out[-1], header=True)
    return out


def _over(f: Callable, kind: str):
    """A function from one array to a value as a vectorised SQL function; null gives null."""

    @pandas_udf(kind)
    def run_(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(np.asarray(v, float)))

    return run_


def _over_two(f: Callable, kind: str):
    @pandas_udf(kind)
    def run_(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else f(np.asarray(a, float), b) for a, b in zip(x, y)], dtype=object)

    return run_


@pandas_udf(DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.inf if v <= 0 and v == math.floor(v) else math.lgamma(v))


#: Functions of one array: (name, kernel, type).
ARRAY_FUNCTIONS = (
    ("signal_power_spectrum", lambda v: spectrum.power_spectrum(v).tolist(), "array<double>"),
    ("signal_hilbert_amplitude", lambda v: np.abs(spectrum.analytic(v)).tolist(), "array<double>"),
    ("signal_hilbert_phase", lambda v: np.angle(spectrum.analytic(v)).tolist(), "array<double>"),
    ("signal_sample_entropy", lambda v: kernels.sample_entropy(v, 2, 0.2 * float(np.std(v))), "double"),
    ("signal_approximate_entropy", lambda v: kernels.approximate_entropy(v, 2, 0.2 * float(np.std(v))), "double"),
    ("signal_neo", lambda v: kernels.neo(v).tolist(), "array<double>"),
    ("signal_mad_noise", lambda v: float(np.median(np.abs(v)) / 0.6745) if len(v) else None, "double"),
)
#: Functions of an array and a second argument.
ARRAY_FUNCTIONS_2 = (
    ("signal_fir", lambda v, taps: kernels.fir(v, np.asarray(taps, float)).tolist(), "array<double>"),
    ("signal_median_filter", lambda v, width: kernels.median_filter(v, int(width)).tolist(), "array<double>"),
    ("signal_sneo", lambda v, half: kernels.sneo(v, int(half)).tolist(), "array<double>"),
    ("signal_soft_threshold", lambda v, limit: kernels.soft_threshold(v, float(limit)).tolist(), "array<double>"),
    ("signal_hard_threshold", lambda v, limit: kernels.hard_threshold(v, float(limit)).tolist(), "array<double>"),
    ("signal_haar_denoise", lambda v, levels: kernels.denoise_haar(v, int(levels)).tolist(), "array<double>"),
    ("signal_coarse_grain", lambda v, scale: kernels.coarse_grain(v, int(scale)).tolist(), "array<double>"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Kernels as SQL functions on array columns; gives their names."""
    for name, f, kind in ARRAY_FUNCTIONS:
        spark.udf.register(name, _over(f, kind))
    for name, f, kind in ARRAY_FUNCTIONS_2:
        spark.udf.register(name, _over_two(f, kind))
    spark.udf.register("signal_lgamma", _lgamma)
    return [name for name, *_ in ARRAY_FUNCTIONS + ARRAY_FUNCTIONS_2] + ["signal_lgamma"]
