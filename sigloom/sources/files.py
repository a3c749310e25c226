"""Biosignal files as Spark data sources: EDF/EDF+, XDF and MDA.

``register(spark)`` makes ``spark.read.format("edf" | "xdf" | "mda").load(path)`` work. A planning pass reads headers (and
chunk lengths) only; partitions are ranges of records, chunks or elements, so a large file is read by many tasks. Paths
with a scheme go through Arrow's file systems, others are local.

A folder's files named ``<recording>-<first>`` are parts of recordings (see ``parts``, which writes them).

Tables by ``option("table", ...)``: ``samples`` (recording, channel, sample_idx, value) is the default; EDF has ``header``
and ``signals``; XDF has ``streams``, ``strings`` and ``clock_offsets``. Filters on ``channel`` and ``stream_id`` are pushed
into the reader.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Rows of an Arrow batch and values of a partition, about.
BATCH, PART = 1 << 16, 1 << 22
#: Bytes of small files that one task reads.
PACK = 1 << 21


def open_input(path: str):
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        system, path = pafs.FileSystem.from_uri(path)
        return system.open_input_file(path)
    return pafs.LocalFileSystem().open_input_file(path.removeprefix("file:"))


def sized(path: str) -> list[tuple[str, int]]:
    """The file itself, or the files of a folder by name, and their bytes."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        system, inner = pafs.FileSystem.from_uri(path)
        head = path[: len(path) - len(inner)]
    else:
        system, inner, head = pafs.LocalFileSystem(), path.removeprefix("file:"), ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        return sorted((head + f.path, f.size) for f in system.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and f.base_name[:1] not in "_.")
    return [(path, info.size or 0)]


def listed(path: str) -> list[str]:
    return [name for name, _ in sized(path)]


def placed(path: str) -> tuple[str, int]:
    """The recording that a file is a part of, and the record or frame that it begins with; a file without a place is a recording."""
    m = re.fullmatch(r"(.*)-(\d{15})(\.[a-z]+)", path, re.S)
    return (m[1] + m[3], int(m[2])) if m else (path, 0)


# EDF ------------------------------------------------------------------------------------------------


@dataclass
class EdfSignal:
    label: str
    transducer: str
    unit: str
    phys_min: float
    phys_max: float
    dig_min: int
    dig_max: int
    prefilter: str
    samples: int

    def physical(self, digital: np.ndarray) -> np.ndarray:
        """Scaled values; without a digital range, constantly the physical minimum."""
        if self.dig_max == self.dig_min:
            return np.full(len(digital), self.phys_min)
        return (digital - self.dig_min) * ((self.phys_max - self.phys_min) / (self.dig_max - self.dig_min)) + self.phys_min


@dataclass
class EdfHeader:
    patient: str
    recording: str
    start_date: str
    start_time: str
    header_bytes: int
    plus: bool
    discontinuous: bool
    records: int
    duration: float
    signals: list[EdfSignal]

    @property
    def record_bytes(self) -> int:
        return 2 * sum(s.samples for s in self.signals)


def _number(text: str) -> float:
    """A plain decimal; exponents are refused."""
    text = text.strip()
    if not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", text):
        raise ValueError(f"not a number: {text!r}")
    return float(text)


def edf_header(raw: bytes) -> EdfHeader:
    """The main header and those of all signals; ``raw`` holds at least as many bytes as the header says."""
    if len(raw) < 256 or raw[:1] != b"0":
        raise ValueError("not an EDF file")
    text = raw.decode("latin-1")
    cut = lambda a, n: text[a : a + n].strip()
    size, count = int(_number(cut(184, 8))), int(_number(cut(252, 4)))
    if size != 256 + 256 * count or len(raw) < size:
        raise ValueError("header size does not fit the number of signals")
    widths = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
    columns, at = [], 256
    for w in widths:
        columns.append([cut(at + k * w, w) for k in range(count)])
        at += w * count
    signals = [EdfSignal(a, b, c, _number(d), _number(e), int(_number(f)), int(_number(g)), h, int(_number(i))) for a, b, c, d, e, f, g, h, i, _ in zip(*columns)]
    reserved = cut(192, 44)
    return EdfHeader(cut(8, 80), cut(88, 80), cut(168, 8), cut(176, 8), size, reserved.startswith("EDF+"), reserved.startswith("EDF+D"), int(_number(cut(236, 8))), _number(cut(244, 8)), signals)


def read_edf_header(path: str) -> EdfHeader:
    with open_input(path) as f:
        head = f.read(256)
        if len(head) < 256 or head[:1] != b"0":
            raise ValueError("not an EDF file")
        return edf_header(head + f.read(max(0, int(_number(head[184:192].decode("latin-1"))) - 256)))


def edf_records(raw: bytes, header: EdfHeader, channel: int) -> np.ndarray:
    """Physical values of one channel from whole records."""
    n = len(raw) // header.record_bytes
    grid = np.frombuffer(raw, "<i2", n * header.record_bytes // 2).reshape(n, -1)
    at = sum(s.samples for s in header.signals[:channel])
    return header.signals[channel].physical(grid[:, at : at + header.signals[channel].samples].reshape(-1).astype(float))


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int
    extra: object = None


class _Reader(DataSourceReader):
    """Options, and equality filters on the columns that a reader can use."""

    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def wants(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]


def _cut(total: int, unit: int) -> list[tuple[int, int]]:
    step = max(1, PART // max(1, unit))
    return [(a, min(a + step, total)) for a in range(0, total, step)]


class EdfReader(_Reader):
    columns = ("channel",)

    def partitions(self):
        out = []
        for path in listed(self.options["path"]):
            header = read_edf_header(path)
            if self.options.get("table", "samples") != "samples":
                out.append(Span(path, 0, 0, header))
                continue
            if header.records < 0:
                raise ValueError("the number of records is not known")
            out += [Span(path, a, b, header) for a, b in _cut(header.records, header.record_bytes // 2)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator:
        if not span.path:
            return
        h, table = span.extra, self.options.get("table", "samples")
        if table == "header":
            yield span.path, h.patient, h.recording, h.start_date, h.start_time, h.records, h.duration, len(h.signals), h.plus, h.discontinuous
            return
        if table == "signals":
            for k, s in enumerate(h.signals):
                yield span.path, k, s.label, s.unit, s.phys_min, s.phys_max, s.dig_min, s.dig_max, s.samples
            return
        with open_input(span.path) as f:
            f.seek(h.header_bytes + span.start * h.record_bytes)
            raw = f.read((span.end - span.start) * h.record_bytes)
        recording, begin = placed(span.path)
        for k, s in enumerate(h.signals):
            if self.wants("channel", k):
                values = edf_records(raw, h, k)
                for a in range(0, len(values), BATCH):
                    v = values[a : a + BATCH]
                    first = (begin + span.start) * s.samples + a
                    yield pa.RecordBatch.from_arrays([pa.repeat(recording, len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(first, first + len(v))), pa.array(v)], names=["recording", "channel", "sample_idx", "value"])


_SAMPLES = "recording string, channel int, sample_idx long, value double"


class EdfSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return {
            "samples": _SAMPLES,
            "header": "recording string, patient string, description string, start_date string, start_time string, records int, duration double, signals int, plus boolean, discontinuous boolean",
            "signals": "recording string, channel int, label string, unit string, phys_min double, phys_max double, dig_min int, dig_max int, samples_per_record int",
        }[self.options.get("table", "samples")]

    def reader(self, schema):
        return EdfReader(dict(self.options))


# XDF ------------------------------------------------------------------------------------------------

#: Channel formats: struct code and bytes.
XDF_FORMATS = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "string": ""}


def varlen(raw: bytes, at: int) -> tuple[int, int]:
    """A length of 1, 4 or 8 bytes behind a byte that says which, and the place behind it."""
    width = raw[at] if at < len(raw) else 0
    if width not in (1, 4, 8) or at + 1 + width > len(raw):
        raise ValueError("bad length")
    return int.from_bytes(raw[at + 1 : at + 1 + width], "little"), at + 1 + width


def xdf_chunks(f) -> Iterator[tuple[int, int, int, int | None]]:
    """(tag, offset of the content, bytes, stream) of each chunk; reads lengths and tags only."""
    if f.read(4) != b"XDF:":
        raise ValueError("not an XDF file")
    at, size = 4, f.size()
    while at < size:
        f.seek(at)
        head = f.read(15)
        length, behind = varlen(head, 0)
        if len(head) < behind + 2:
            raise ValueError("cut chunk")
        tag = int.from_bytes(head[behind : behind + 2], "little")
        start, end = at + behind + 2, at + behind + length
        if end > size:
            raise ValueError("cut chunk")
        stream = None
        if 2 <= tag <= 6 and tag != 5 and end - start >= 4:
            f.seek(start)
            stream = int.from_bytes(f.read(4), "little")
            start += 4
        yield tag, start, end - start, stream
        at = end


def tag_value(xml: str, tag: str, default: str = "") -> str:
    m = re.search(f"<{tag}>(.*?)</{tag}>", xml, re.S)
    return m[1] if m else default


def xdf_samples(raw: bytes, channels: int, kind: str) -> Iterator[tuple[float | None, list]]:
    """(time or None, values) of each sample of a samples chunk."""
    count, at = varlen(raw, 0)
    dtype = np.dtype(XDF_FORMATS[kind]) if kind != "string" else None
    for _ in range(count):
        time, flag = None, raw[at]
        at += 1
        if flag == 8:
            (time,) = struct.unpack_from("<d", raw, at)
            at += 8
        if dtype is not None:
            yield time, np.frombuffer(raw, dtype, channels, at).astype(float).tolist()
            at += dtype.itemsize * channels
        else:
            values = []
            for _ in range(channels):
                n, at = varlen(raw, at)
                values.append(raw[at : at + n].decode("utf-8", "replace"))
                at += n
            yield time, values


class XdfReader(_Reader):
    """Small files go to tasks several together, which look for their chunks there; only a large one's chunks are listed beforehand and cut."""

    columns = ("stream_id",)

    def partitions(self):
        out, held, small = [], 0, []
        for path, size in sized(self.options["path"]):
            if size > PART * 4:
                out += self.parts(path)
                continue
            if small and held + size > PACK:
                out.append(Span("", 0, 0, small))
                held, small = 0, []
            small.append(path)
            held += size
        if small:
            out.append(Span("", 0, 0, small))
        return out or [Span("", 0, 0)]

    def parts(self, path: str) -> list:
        table, out = self.options.get("table", "samples"), []
        streams, chunks = {}, []
        with open_input(path) as f:
            for tag, start, size, stream in xdf_chunks(f):
                if tag == 2:
                    f.seek(start)
                    xml = f.read(size).decode("utf-8", "replace")
                    streams[stream] = (tag_value(xml, "name"), tag_value(xml, "type"), int(tag_value(xml, "channel_count", "0")), float(tag_value(xml, "nominal_srate", "0") or 0), tag_value(xml, "channel_format"))
                elif tag == 3 and table in ("samples", "strings"):
                    f.seek(start)
                    chunks.append((stream, start, size, varlen(f.read(min(9, size)), 0)[0]))
                elif tag == 4 and table == "clock_offsets":
                    chunks.append((stream, start, size, 1))
        if table == "streams":
            return [Span(path, 0, 0, streams)]
        name, first, held, part = self.options.get("stream"), {}, 0, []
        for stream, start, size, n in chunks:
            info = streams.get(stream)
            if info and self.wants("stream_id", stream) and (not name or info[0] == name) and (table == "clock_offsets" or (info[4] == "string") == (table == "strings")):
                part.append((stream, start, size, first.get(stream, 0), info))
                held += size
            first[stream] = first.get(stream, 0) + n
            if held > PART * 4:
                out.append(Span(path, 0, 0, part))
                held, part = 0, []
        if part:
            out.append(Span(path, 0, 0, part))
        return out

    def read(self, span: Span) -> Iterator:
        if not span.path:
            for path in span.extra or []:
                for part in self.parts(path):
                    yield from self.read(part)
            return
        table = self.options.get("table", "samples")
        if table == "streams":
            for k, v in span.extra.items():
                if self.wants("stream_id", k):
                    yield span.path, k, *v
            return
        with open_input(span.path) as f:
            for stream, start, size, first, info in span.extra:
                f.seek(start)
                raw = f.read(size)
                if table == "clock_offsets":
                    yield span.path, stream, *struct.unpack("<dd", raw[:16])
                else:
                    for k, (time, values) in enumerate(xdf_samples(raw, info[2], info[4])):
                        yield span.path, stream, first + k, time, values


class XdfSource(DataSource):
    @classmethod
    def name(cls):
        return "xdf"

    def schema(self):
        return {
            "samples": "recording string, stream_id long, sample_idx long, ts_sec double, x array<double>",
            "strings": "recording string, stream_id long, sample_idx long, ts_sec double, s array<string>",
            "streams": "recording string, stream_id long, name string, type string, channel_count int, nominal_srate double, channel_format string",
            "clock_offsets": "recording string, stream_id long, collection_time double, offset double",
        }[self.options.get("table", "samples")]

    def reader(self, schema):
        return XdfReader(dict(self.options))


# MDA ------------------------------------------------------------------------------------------------

#: Type codes of the format.
MDA_TYPES = {-2: "u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}


@dataclass
class MdaHeader:
    dtype: str
    dims: tuple[int, ...]
    offset: int

    @property
    def elements(self) -> int:
        return int(np.prod([min(d, 1 << 40) for d in self.dims], dtype=object)) if self.dims else 0


def mda_header(raw: bytes, size: int) -> MdaHeader | None:
    """The reading with two or three leading fields that fits the file's size; of equals that with two."""
    found: list[tuple[int, int, MdaHeader]] = []
    for fields in (2, 3):
        if len(raw) < 4 * fields:
            continue
        head = struct.unpack(f"<{fields}i", raw[: 4 * fields])
        kind, n = MDA_TYPES.get(head[0]), head[-1]
        wide = fields == 3 and n < 0
        n, width = abs(n), 8 if wide else 4
        if kind is None or not 1 <= n <= 50 or len(raw) < 4 * fields + n * width:
            continue
        if fields == 3 and head[1] != np.dtype(kind).itemsize:
            continue
        dims = struct.unpack(f"<{n}{'q' if wide else 'i'}", raw[4 * fields : 4 * fields + n * width])
        if min(dims) < 0:
            continue
        h = MdaHeader(kind, dims, 4 * fields + n * width)
        rest = size - h.offset - h.elements * np.dtype(kind).itemsize
        found.append((0 if rest == 0 else 1 if rest > 0 else 2, fields, h))
    return min(found, key=lambda x: x[:2])[2] if found else None


class MdaReader(_Reader):
    columns = ("channel",)

    def partitions(self):
        out = []
        for path in listed(self.options["path"]):
            with open_input(path) as f:
                size = f.size()
                h = mda_header(f.read(min(size, 512)), size)
            if h is None or size < h.offset + h.elements * np.dtype(h.dtype).itemsize:
                raise ValueError(f"not a complete MDA file: {path}")
            rows = h.dims[0]
            out += [Span(path, a, b, h) for a, b in _cut(h.elements // rows if rows else 0, rows)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator:
        if not span.path:
            return
        h = span.extra
        kind, rows = np.dtype(h.dtype), h.dims[0]
        with open_input(span.path) as f:
            f.seek(h.offset + span.start * rows * kind.itemsize)
            grid = np.frombuffer(f.read((span.end - span.start) * rows * kind.itemsize), kind).reshape(-1, rows)
        recording, begin = placed(span.path)
        for k in range(rows):
            if self.wants("channel", k):
                v = grid[:, k].astype(float)
                yield pa.RecordBatch.from_arrays([pa.repeat(recording, len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(begin + span.start, begin + span.end)), pa.array(v)], names=["recording", "channel", "sample_idx", "value"])


class MdaSource(DataSource):
    @classmethod
    def name(cls):
        return "mda"

    def schema(self):
        return _SAMPLES

    def reader(self, schema):
        return MdaReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from sigloom.sources.parts import EdfParts, MdaParts  # they write, too

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdfParts, XdfSource, MdaParts):
        spark.dataSource.register(source)
