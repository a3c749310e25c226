"""Binary packets of the embedded recorder: spike events, configuration and run statistics, and ADC words."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the converter's serial protocol.
CONVERT, READ, WRITE, CALIBRATE, CLEAR_CALIBRATE = 0x0000, 0xC000, 0x8000, 0x5500, 0x6A00
#: Full scale of an amplitude.
SCALE = 32767.0


def spike_bytes(sample: int, channel: int, cluster: int, amplitude: float) -> bytes:
    """Eight bytes: sample (unsigned 32), channel, cluster, amplitude within [-1, 1] as signed 16; little-endian."""
    return struct.pack("<IBBh", sample & 0xFFFFFFFF, channel, cluster, int(max(-1.0, min(1.0, amplitude)) * SCALE))


def spike_of(raw: bytes) -> tuple[int, int, int, float]:
    s, c, k, a = struct.unpack("<IBBh", raw)
    return s, c, k, a / SCALE


def batch_bytes(events: list[tuple[int, int, int, float]], most: int) -> bytes:
    """The packets of at most so many events."""
    return b"".join(spike_bytes(*e) for e in events[:most])


def config_bytes(factor: float, templates: int, fs: int) -> bytes:
    return struct.pack("<fBHx", factor, templates, fs)


def config_of(raw: bytes) -> tuple[float, int, int]:
    return struct.unpack("<fBHx", raw)


def stats_bytes(frames: int, spikes: int, dropped_frames: int, dropped_events: int, peak_rate: int, uptime: int) -> bytes:
    """Sixteen bytes: two unsigned 32, four unsigned 16 that stop at their largest value."""
    return struct.pack("<2I4H", frames & 0xFFFFFFFF, spikes & 0xFFFFFFFF, *(min(v, 65535) for v in (dropped_frames, dropped_events, peak_rate, uptime)))


def command(kind: int, register: int, value: int = 0) -> int:
    """A 16-bit word: convert a channel, read or write a register."""
    return kind | (register & 0x3F) << 8 | (value & 0xFF)


def adc_signed(raw: Column | str) -> Column:
    """Offset binary of 16 bits as a signed number."""
    return (F.col(raw) if isinstance(raw, str) else raw).cast("int") - 32768


def _low_bytes(c: Column, n: int) -> Column:
    return F.concat(*(F.lpad(F.hex(F.pmod(F.floor(c / (1 << 8 * k)), F.lit(256)).cast("long")), 2, "0") for k in range(n)))


def with_packets(df: DataFrame, out: str = "packet") -> DataFrame:
    """Events (sample, channel, cluster_id, amplitude) with their packet, by expressions only."""
    size = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("amplitude"))) * SCALE).cast("long")
    text = F.concat(_low_bytes(F.pmod("sample", F.lit(1 << 32)), 4), _low_bytes(F.col("channel"), 1), _low_bytes(F.col("cluster_id"), 1), _low_bytes(F.pmod(size, F.lit(65536)), 2))
    return df.withColumn(out, F.unhex(text))
