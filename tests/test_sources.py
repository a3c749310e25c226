"""File formats from bytes built by hand, generated recordings, packets."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.sources import files, packets, synthetic


def edf_bytes(signals, records, duration=1.0, reserved="", count=None):
    """signals: (label, phys_min, phys_max, dig_min, dig_max, samples of each record); records: a list of arrays a record."""
    ns = len(signals)
    pad = lambda v, n: str(v).ljust(n).encode()
    head = b"".join([pad(0, 8), pad("patient", 80), pad("rec", 80), pad("01.01.20", 8), pad("00.00.00", 8), pad(256 + 256 * ns, 8), pad(reserved, 44), pad(len(records) if count is None else count, 8), pad(duration, 8), pad(ns, 4)])
    cols = [[s[0] for s in signals], ["t"] * ns, ["uV"] * ns, [s[1] for s in signals], [s[2] for s in signals], [s[3] for s in signals], [s[4] for s in signals], ["-"] * ns, [s[5] for s in signals], [""] * ns]
    head += b"".join(pad(v, w) for w, col in zip((16, 80, 8, 8, 8, 8, 8, 80, 8, 32), cols) for v in col)
    return head + b"".join(np.asarray(a, "<i2").tobytes() for r in records for a in r)


@pytest.fixture(autouse=True)
def formats(spark):
    files.register(spark)


def test_edf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 8)  # many partitions
    records = [[[k, k + 1], [10 * k]] for k in range(9)]
    (tmp_path / "a.edf").write_bytes(edf_bytes([("C3", -100, 100, -1000, 1000, 2), ("flat", 5, 9, 7, 7, 1)], records, reserved="EDF+D"))
    df = spark.read.format("edf").load(str(tmp_path / "a.edf"))
    got = {(r.channel, r.sample_idx): r.value for r in df.collect()}
    assert len(got) == 27 and all(got[0, 2 * k + j] == pytest.approx((k + j) / 10) for k in range(9) for j in (0, 1))
    assert all(got[1, k] == 5 for k in range(9))
    assert df.where(F.col("channel") == 1).count() == 9
    header = spark.read.format("edf").option("table", "header").load(str(tmp_path)).first()
    assert header.patient == "patient" and header.records == 9 and header.plus and header.discontinuous
    labels = spark.read.format("edf").option("table", "signals").load(str(tmp_path)).orderBy("channel").collect()
    assert [r.label for r in labels] == ["C3", "flat"] and labels[0].samples_per_record == 2


def test_bad_edf():
    good = edf_bytes([("a", 0, 1, 0, 1, 1)], [[[1]]])
    for bad in (b"", b"1" + good[1:], good[:252] + b"9   " + good[256:], good[:244] + b"1e3     " + good[252:]):
        with pytest.raises(ValueError):
            files.edf_header(bad)


def varlen(n):
    return b"\x01" + bytes([n]) if n < 256 else b"\x04" + struct.pack("<I", n)


def chunk(tag, body):
    return varlen(len(body) + 2) + struct.pack("<H", tag) + body


def xdf_bytes():
    info = lambda name, n, kind: f"<info><name>{name}</name><type>EEG</type><channel_count>{n}</channel_count><nominal_srate>100</nominal_srate><channel_format>{kind}</channel_format></info>".encode()
    one = varlen(2) + b"\x08" + struct.pack("<d2h", 1.5, 3, 4) + b"\x00" + struct.pack("<2h", 5, 6)
    two = varlen(1) + b"\x00" + struct.pack("<2h", 7, 8)
    text = varlen(1) + b"\x08" + struct.pack("<d", 2.0) + varlen(3) + "hé".encode()
    sid = lambda k: struct.pack("<I", k)
    parts = [chunk(1, b"<?xml?>"), chunk(2, sid(7) + info("eeg", 2, "int16")), chunk(2, sid(8) + info("marks", 1, "string")), chunk(3, sid(7) + one), chunk(3, sid(8) + text), chunk(4, sid(7) + struct.pack("<dd", 10.0, 0.25)), chunk(5, b"x" * 16), chunk(3, sid(7) + two), chunk(6, sid(7) + b"<info/>")]
    return b"XDF:" + b"".join(parts)


def test_xdf(spark, tmp_path):
    path = str(tmp_path / "a.xdf")
    (tmp_path / "a.xdf").write_bytes(xdf_bytes())
    read = lambda t, **o: spark.read.format("xdf").options(table=t, **o).load(path)
    got = [(r.stream_id, r.sample_idx, r.ts_sec, r.x) for r in read("samples").orderBy("sample_idx").collect()]
    assert got == [(7, 0, 1.5, [3.0, 4.0]), (7, 1, None, [5.0, 6.0]), (7, 2, None, [7.0, 8.0])]
    assert [(r.stream_id, r.s) for r in read("strings").collect()] == [(8, ["hé"])]
    assert [(r.name, r.channel_count, r.nominal_srate) for r in read("streams").orderBy("stream_id").collect()] == [("eeg", 2, 100.0), ("marks", 1, 100.0)]
    assert [(r.collection_time, r.offset) for r in read("clock_offsets").collect()] == [(10.0, 0.25)]
    assert read("samples", stream="marks").count() == 0 and read("samples").where("stream_id = 9").count() == 0
    with pytest.raises(ValueError):
        files.varlen(b"\x02\x00", 0)


@pytest.mark.parametrize("code, dtype", [(-2, "u1"), (-3, "<f4"), (-4, "<i2"), (-5, "<i4"), (-6, "<u2"), (-7, "<f8"), (-8, "<u4")])
@pytest.mark.parametrize("fields", ["two", "three", "wide"])
def test_mda(tmp_path, code, dtype, fields):
    data = np.arange(12).astype(dtype)
    width = np.dtype(dtype).itemsize
    head = {"two": struct.pack("<4i", code, 2, 3, 4), "three": struct.pack("<5i", code, width, 2, 3, 4), "wide": struct.pack("<3i2q", code, width, -2, 3, 4)}[fields]
    raw = head + data.tobytes()
    h = files.mda_header(raw, len(raw))
    assert h.dims == (3, 4) and h.elements == 12 and np.frombuffer(raw[h.offset :], h.dtype).tolist() == list(range(12))


def test_mda_table(spark, tmp_path):
    (tmp_path / "a.mda").write_bytes(struct.pack("<4i", -7, 2, 3, 4) + np.arange(12.0).tobytes())
    got = {(r.channel, r.sample_idx): r.value for r in spark.read.format("mda").load(str(tmp_path / "a.mda")).collect()}
    assert got == {(c, s): float(3 * s + c) for c in range(3) for s in range(4)}
    (tmp_path / "b.mda").write_bytes(struct.pack("<4i", -7, 2, 3, 4) + np.arange(5.0).tobytes())
    with pytest.raises(Exception, match="complete"):
        spark.read.format("mda").load(str(tmp_path / "b.mda")).count()


def test_generated_recordings_do_not_depend_on_blocks(spark):
    frames, truth = synthetic.recording(spark, channels=4, seconds=1.2, fs=30_000.0, units=2, rate=20.0)
    assert frames.count() == 36_000 and truth.count() > 10
    shapes, times = synthetic.templates(2, 4), synthetic.spike_times(2, 36_000, 30_000.0, 20.0)
    a = synthetic.frames(4, 0, 36_000, shapes, times, 1.0, 42)
    b = np.concatenate([synthetic.frames(4, s, s + 9000, shapes, times, 1.0, 42) for s in range(0, 36_000, 9000)])
    assert np.array_equal(a, b)
    row = frames.where("sample_idx = 31000").first()
    assert np.allclose(row.x, a[31000])
    assert all((np.diff(t) >= 30).all() for t in times)


def test_waves(spark):
    assert synthetic.impulses(spark, 100, 100.0, 10.0).where("value > 0").count() == 10
    assert synthetic.step(spark, 10, 5, 0, 2).agg(F.sum("value")).first()[0] == 10
    n = synthetic.white_noise(spark, 1000, 2.0, 1).agg(F.min("value"), F.max("value"), F.avg("value")).first()
    assert -2 <= n[0] < -1.8 and 1.8 < n[1] <= 2 and abs(n[2]) < 0.2
    assert synthetic.chirp(spark, 100, 100.0, 1, 10).count() == synthetic.composite(spark, 100, 100.0, [(5, 1)], 0.1).count() == 100


def test_packets(spark):
    raw = packets.spike_bytes(70_000, 3, 9, -0.5)
    assert packets.spike_of(raw)[:3] == (70_000, 3, 9) and abs(packets.spike_of(raw)[3] + 0.5) < 1e-4
    assert packets.config_of(packets.config_bytes(4.5, 8, 30_000)) == (4.5, 8, 30_000) and len(packets.config_bytes(1, 1, 1)) == 8
    assert len(packets.batch_bytes([(1, 2, 3, 0.1)] * 5, 3)) == 24 and len(packets.stats_bytes(1, 2, 3, 10**9, 5, 6)) == 16
    assert packets.command(packets.READ, 5) == 0xC500 and packets.command(packets.WRITE, 1, 2) == 0x8102
    df = spark.createDataFrame([(70_000, 3, 9, -0.5), (2**32 + 1, 255, 0, 7.0)], "sample long, channel int, cluster_id int, amplitude double")
    assert [bytes(r.packet) for r in packets.with_packets(df).collect()] == [raw, packets.spike_bytes(1, 255, 0, 7.0)]
    assert [r[0] for r in spark.createDataFrame([(0,), (32768,), (65535,)], "v int").select(packets.adc_signed("v")).collect()] == [-32768, 0, 32767]


def test_written_files_read_back(tmp_path):
    from sigloom.sources import writers

    signals = [files.EdfSignal("a", "t", "uV", -100.0, 100.0, -2048, 2047, "-", 3), files.EdfSignal("b", "t", "uV", 0.0, 1.0, 0, 1, "-", 2)]
    raw = writers.edf(signals, [np.array([-100.0, 0.0, 100.0, 500.0, -500.0, 1.0]), np.array([0.2, 0.8, 0.5, 0.4])], records=2, patient="p")
    h = files.edf_header(raw)
    assert (h.patient, h.records, [s.label for s in h.signals], h.record_bytes) == ("p", 2, ["a", "b"], 10)
    assert np.allclose(files.edf_records(raw[h.header_bytes :], h, 0), [-100, 0, 100, 100, -100, 1], atol=0.05)
    assert files.edf_records(raw[h.header_bytes :], h, 1).tolist() == [0, 1, 1, 0]
    for kind in files.MDA_TYPES.values():
        x = np.arange(12).astype(kind).reshape(3, 4)
        raw = writers.mda(x)
        h = files.mda_header(raw[:512], len(raw))
        assert h.dims == (3, 4) and np.frombuffer(raw[h.offset :], h.dtype).reshape(4, 3).T.tolist() == x.tolist()
    with pytest.raises(ValueError):
        writers.mda(np.zeros(2, "<i8"))
    writers.put(f"{tmp_path}/deep/folder/x.mda", raw)
    assert (tmp_path / "deep/folder/x.mda").read_bytes() == raw
