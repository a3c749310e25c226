"""Recordings written by many tasks and read back."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.sources import files, parts


@pytest.fixture
def source(spark):
    files.register(spark)
    rng = np.random.default_rng(4)
    grid = {"a": rng.normal(size=(500, 6)) * 50, "b": rng.normal(size=(3, 6)) * 50, "c": rng.normal(size=(40, 6)) * 50}
    rows = [(k, i + (100 if k == "c" and i >= 20 else 0), v.tolist()) for k, g in grid.items() for i, v in enumerate(g)]
    return grid, spark.createDataFrame(rows, "recording string, at long, x array<double>")


def read(spark, kind, folder):
    out = {}
    for r in spark.read.format(kind).load(str(folder)).collect():
        out[os.path.basename(r.recording), r.channel, r.sample_idx] = r.value
    return out


@pytest.mark.parametrize("tasks", [None, 7])
def test_edf_of_many_tasks(spark, source, tmp_path, tasks):
    """Three signals of two samples a record; whatever the tasks, the recording is one."""
    grid, df = source
    rows = df.repartition(tasks) if tasks else parts.ordered(df)
    rows.write.format("edf").options(part_bytes=12 * 30, samples=2, labels="x,y,z", phys_min=-400, phys_max=400).mode("append").save(str(tmp_path))
    names = sorted(os.listdir(tmp_path))
    assert len(names) > 17 and all(n.endswith(".edf") for n in names)
    got = read(spark, "edf", tmp_path)
    want = {}
    for k, g in grid.items():
        for i, v in enumerate(g):
            at = i + (100 if k == "c" and i >= 20 else 0)
            for c in range(3):
                for s in range(2):
                    want[f"{k}.edf", c, 2 * at + s] = v[2 * c + s]
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) <= 400 / 65535
    header = files.read_edf_header(f"{tmp_path}/{names[0]}")
    assert [s.label for s in header.signals] == ["x", "y", "z"] and header.records == 30 if tasks is None else header.records >= 1


def test_mda_frames_overwrite_and_append(spark, source, tmp_path):
    grid, df = source
    for mode in ("append", "overwrite"):
        parts.ordered(df).write.format("mda").mode(mode).save(str(tmp_path))
        got = read(spark, "mda", tmp_path)
        assert len(got) == 6 * 543 and got["a.mda", 2, 499] == grid["a"][499, 2]
    with pytest.raises(Exception, match="there already"):
        parts.ordered(df).write.format("mda").mode("append").save(str(tmp_path))
    assert len(read(spark, "mda", tmp_path)) == 6 * 543 and all(n.endswith(".mda") for n in os.listdir(tmp_path))
    df.where("recording = 'b'").write.format("mda").mode("overwrite").save(str(tmp_path))
    assert {k[0] for k in read(spark, "mda", tmp_path)} == {"b.mda"}


@pytest.mark.parametrize("bad", ["fails", "twice", "null", "width"])
def test_nothing_is_left_of_a_job_that_fails(spark, source, tmp_path, bad):
    _, df = source
    if bad == "fails":
        df = parts.ordered(df).withColumn("x", F.when((F.col("recording") == "c") & (F.col("at") > 110), F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("x")))
    elif bad == "twice":
        df = df.unionAll(df.where("at = 1")).repartition(5)
    elif bad == "null":
        df = df.withColumn("at", F.when(F.col("at") != 7, F.col("at")))
    else:
        df = df.withColumn("x", F.slice("x", 1, 5))
    with pytest.raises(Exception, match="lost|two rows|without|whole"):
        df.write.format("edf").option("samples", 2).mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_empty_tables(spark, source, tmp_path):
    source[1].where("false").write.format("edf").mode("append").save(str(tmp_path))
    assert read(spark, "edf", tmp_path) == {}
