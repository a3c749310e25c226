"""Operators that mark spans of a text: one row in, one row out, spans as an array of structs.

A span is (kind, start, end, base): code points, end exclusive; ``base`` is true for what the fixed patterns give
and false for what the method adds. Spans stand by start, then by the operator's order of kinds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow, with_fields

Span = tuple[str, int, int, bool]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


class Taken:
    """Places of a text that spans hold, as disjoint intervals; what overlaps one is told in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((s[1], s[2]) for s in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, start: int, end: int) -> bool:
        """Take a place if nothing overlaps it."""
        k = bisect_left(self.ends, start + 1)  # the first interval that ends after start
        if k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])) if len(spans) > 1 else spans


def mark_spans(df: DataFrame, find: Callable[[str], list[Span]], text: str, out: str, setup: Callable | None = None) -> DataFrame:
    """``df`` with ``out`` (replaced if there): the spans that ``find`` gives for each whole text; a null text is empty."""
    keep = [f for f in df.schema if f.name != out]

    def kernel(batch: pa.RecordBatch, finder: Callable[[str], list[Span]]):
        found, offsets = [], [0]
        for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
            if value:
                found += finder(value)
            offsets.append(len(found))
        kinds, starts, ends, base = zip(*found) if found else ((), (), (), ())
        flat = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(base, pa.bool_())], fields=list(_STRUCT))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), lists], names=[*(f.name for f in keep), out])

    return map_arrow(df.select(*(f"`{f.name}`" for f in keep)), kernel, with_fields(keep, f"`{out}` {SPANS}"), text, setup or (lambda: find))


def count_of(spans: str, kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def written(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(spans: str) -> Column:
    return F.sha2(written(F.filter(spans, lambda s: s["base"])), 256)
