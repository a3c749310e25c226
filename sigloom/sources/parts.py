"""Writing recordings from many tasks: ``df.write.format("edf" | "mda").mode(...).save(folder)`` for rows (recording, at, x).

``at`` numbers a recording's data records (EDF) or frames (MDA), ``x`` holds the record's values, signal by signal, or the frame's
channels. A task writes runs of successive rows as files of their own, each a whole EDF or MDA file whose name says
where in its recording it begins: ``<recording>-<first>.edf``. The readers put them together again: one recording, samples numbered
through. Files are written beside the folder's own and moved there when all tasks are done, those of the attempts that
count only; if the job fails, nothing is left. Rows need no order, but one by (recording, at) gives the fewest files
(``ordered``).

Options of EDF: ``samples`` of a signal in a record, ``duration`` of a record in seconds, ``phys_min``, ``phys_max``, ``unit``,
``labels`` (one for all signals, or a comma between them), ``patient``; of both: ``part_bytes``, the most of a file (32 MiB). Two rows of one place, a row without a recording, place or values, or
rows of another width are errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from sigloom.sources.files import EdfSignal, EdfSource, MdaSource
from sigloom.sources.writers import edf, mda, put

PART_BYTES = 32 << 20


def ordered(df: DataFrame) -> DataFrame:
    """Rows dealt out by (recording, at), so that a recording may be many tasks' work and a task writes long runs."""
    return df.select("recording", "at", "x").repartitionByRange("recording", "at").sortWithinPartitions("recording", "at")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name, recording, first row and the one behind the last."""

    parts: list = field(default_factory=list)


class PartWriter(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.folder = options["path"].rstrip("/")
        self.beside = f"{self.folder}/_writing-{uuid.uuid4().hex}"

    def content(self, rows: np.ndarray) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        held: list[np.ndarray] = []
        recording, first, upto, size = None, 0, 0, 0

        def give() -> None:
            nonlocal held, size
            if held:
                name = f"{recording}-{first:015d}{self.suffix}"
                unique = f"{uuid.uuid4().hex}-{name}"
                put(f"{self.beside}/{unique}", self.content(np.concatenate(held)))
                done.parts.append((unique, name, str(recording), first, upto))
            held, size = [], 0

        for batch in iterator:
            if any(batch.column(k).null_count for k in range(3)):
                raise ValueError("a row without a recording, place or values")
            n, x = batch.num_rows, batch.column(2)
            if not n:
                continue
            width = len(x[0])
            grid = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
            names, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            most = max(1, int(self.options.get("part_bytes", PART_BYTES)) // max(1, 2 * width))
            fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | np.array([a != b for a, b in zip(names[1:], names)], bool)])
            for s, e in zip(fresh.tolist(), [*fresh[1:].tolist(), n]):
                if held and (names[s] != recording or at[s] != upto or held[0].shape[1] != width):
                    give()
                for k in range(s, e, most):
                    if size and size + min(e, k + most) - k > most:
                        give()
                    if not held:
                        recording, first = names[k], int(at[k])
                    held.append(grid[k : min(e, k + most)])
                    upto, size = int(at[min(e, k + most) - 1]) + 1, size + min(e, k + most) - k
        give()
        return done

    def commit(self, messages: list) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p[2], p[3]))
        for a, b in zip(parts, parts[1:]):
            if a[2] == b[2] and b[3] < a[4]:
                self.abort(messages)
                raise ValueError(f"recording {a[2]} has two rows of place {b[3]}")
        system, inner = _of(self.folder)
        system.create_dir(inner, recursive=True)
        there = [f.path for f in system.get_file_info(pafs.FileSelector(inner)) if f.path.endswith(self.suffix)]
        taken = {path.rsplit("/", 1)[1] for path in there}
        if not self.overwrite and taken & {p[1] for p in parts}:
            self.abort(messages)
            raise ValueError("a part of this recording is there already")
        if self.overwrite:
            for path in there:
                system.delete_file(path)
        for unique, name, *_ in parts:
            system.move(f"{_of(self.beside)[1]}/{unique}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Takes away what lies beside the folder's own files, whoever wrote it."""
        system, inner = _of(self.beside)
        if system.get_file_info(inner).type == pafs.FileType.Directory:
            system.delete_dir(inner)


def _of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class EdfPartWriter(PartWriter):
    suffix = ".edf"

    def content(self, rows: np.ndarray) -> bytes:
        o = self.options
        samples = int(o.get("samples", 1))
        count = rows.shape[1] // samples
        if count * samples != rows.shape[1]:
            raise ValueError(f"{rows.shape[1]} values are no whole signals of {samples}")
        each = lambda name, other: v * count if len(v := str(o.get(name, other)).split(",")) == 1 else v
        signals = [
            EdfSignal(label, "none", unit, float(low), float(high), -32768, 32767, "none", samples)
            for label, unit, low, high in zip(each("labels", "signal"), each("unit", "uV"), each("phys_min", -3276.8), each("phys_max", 3276.7))
        ]
        if len(signals) != count:
            raise ValueError(f"options name {len(signals)} signals of {count}")
        values = rows.reshape(len(rows), count, samples)
        return edf(signals, [values[:, k].reshape(-1) for k in range(count)], len(rows), float(o.get("duration", 1.0)), o.get("patient", ""))


class MdaPartWriter(PartWriter):
    suffix = ".mda"

    def content(self, rows: np.ndarray) -> bytes:
        return mda(rows.T)


class EdfParts(EdfSource):
    def writer(self, schema, overwrite):
        return EdfPartWriter(dict(self.options), overwrite)


class MdaParts(MdaSource):
    def writer(self, schema, overwrite):
        return MdaPartWriter(dict(self.options), overwrite)
