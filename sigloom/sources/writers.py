"""Recordings as files: the bytes of EDF, XDF and MDA, and a sink that writes one file for each group of rows.

Executors write to a folder that all machines share (a path, or a URL that pyarrow's file systems know), under the group's
name; a task that runs again writes the same bytes to the same name.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from sigloom.sources.files import EdfSignal, MDA_TYPES, XDF_FORMATS


def edf(signals: list[EdfSignal], values: list[np.ndarray], records: int = 1, duration: float = 1.0, patient: str = "", recording: str = "") -> bytes:
    """Physical values of each signal (records x samples of it), rounded half up to its digital range and cut at its ends."""
    pad = lambda v, n: str(v)[:n].ljust(n).encode("latin-1", "replace")
    n = len(signals)
    head = [pad(0, 8), pad(patient, 80), pad(recording, 80), pad("01.01.00", 8), pad("00.00.00", 8), pad(256 + 256 * n, 8), pad("", 44), pad(records, 8), pad(f"{duration:g}", 8), pad(n, 4)]
    for width, of in ((16, "label"), (80, "transducer"), (8, "unit"), (8, "phys_min"), (8, "phys_max"), (8, "dig_min"), (8, "dig_max"), (80, "prefilter"), (8, "samples")):
        head += [pad(f"{v:g}" if isinstance(v := getattr(s, of), float) else v, width) for s in signals]
    head.append(pad("", 32 * n))
    grids = []
    for s, v in zip(signals, values):
        scaled = (np.asarray(v, float) - s.phys_min) * ((s.dig_max - s.dig_min) / (s.phys_max - s.phys_min)) + s.dig_min
        grids.append(np.clip(np.floor(scaled + 0.5), s.dig_min, s.dig_max).astype("<i2").reshape(records, s.samples))
    return b"".join(head) + np.concatenate(grids, axis=1).tobytes()


def mda(x: np.ndarray) -> bytes:
    """An array (channels first) column by column, with its type's code, two leading fields and 32-bit sizes."""
    x = np.asarray(x)
    code = next((k for k, t in MDA_TYPES.items() if np.dtype(t) == x.dtype), None)
    if code is None:
        raise ValueError(f"no code for {x.dtype}")
    return struct.pack(f"<{2 + x.ndim}i", code, x.ndim, *x.shape) + x.tobytes(order="F")


def _length(n: int) -> bytes:
    return b"\x01" + bytes([n]) if n < 256 else b"\x04" + struct.pack("<I", n) if n < 1 << 32 else b"\x08" + struct.pack("<Q", n)


def _chunk(tag: int, body: bytes) -> bytes:
    return _length(len(body) + 2) + struct.pack("<H", tag) + body


def xdf(streams: list[dict]) -> bytes:
    """Streams: id, name, type, rate, format, times (seconds, or None), values (samples x channels), offsets (time, offset)."""
    out = [b"XDF:", _chunk(1, b"<?xml version='1.0'?><info><version>1.0</version></info>")]
    for s in streams:
        channels = len(s["values"][0]) if len(s["values"]) else 0
        info = f"<info><name>{s['name']}</name><type>{s['type']}</type><channel_count>{channels}</channel_count><nominal_srate>{s['rate']:g}</nominal_srate><channel_format>{s['format']}</channel_format></info>"
        out.append(_chunk(2, struct.pack("<I", s["id"]) + info.encode()))
    for s in streams:
        rows = []
        for time, values in zip(s["times"], s["values"]):
            stamp = b"\x00" if time is None else b"\x08" + struct.pack("<d", time)
            cells = b"".join(_length(len(v.encode())) + v.encode() for v in values) if s["format"] == "string" else np.asarray(values, XDF_FORMATS[s["format"]]).tobytes()
            rows.append(stamp + cells)
        out.append(_chunk(3, struct.pack("<I", s["id"]) + _length(len(rows)) + b"".join(rows)))
        out += [_chunk(4, struct.pack("<Idd", s["id"], time, offset)) for time, offset in s.get("offsets", [])]
    out += [_chunk(6, struct.pack("<I", s["id"]) + b"<info/>") for s in streams]
    return b"".join(out)


def put(path: str, content: bytes) -> None:
    system, inner = pafs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(content)


def write(df: DataFrame, by: str, folder: str, content: Callable[[pa.Table], bytes], suffix: str) -> int:
    """One file for each value of ``by``, made by ``content`` from the group's rows; gives the number of files. A group must fit a task."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        put(f"{folder.rstrip('/')}/{key[0].as_py()}{suffix}", content(rows))
        return pa.table({"files": pa.array([1], pa.int32())})

    return df.groupBy(by).applyInArrow(one, "files int").count()
