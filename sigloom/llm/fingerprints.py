"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its lines (what stands between ``\\n``; an empty text is one empty line). Each line is hashed to a
wide vector, and the fingerprint is the sum of all vectors modulo powers of two: lines in any order give the same fingerprint,
a line is inserted by adding its vector and deleted by taking it away, and parts of a document that lie in many rows or tasks
are summed in any order. No fingerprint is ever made anew from a whole text for such a change.

The vector has two parts. ``EQUAL`` lanes modulo 2^64 are a digest of the line (BLAKE2b): unlike multisets of lines have
equal sums by a chance of 2^-512. ``LIKE`` lanes modulo 2^16 hold the line's runs of ``WIDTH`` words (fewer words: all of
them), each of which adds 1 or -1 to the lane that its hash names: the inner product of two fingerprints estimates that of
the two texts' counts of runs. ``likeness`` is twice that product by the sum of both squares, between 0 and 1, and 1 for
equal fingerprints; its error is about ``LIKE`` ** -0.5 for long texts, and less for short ones. It is an estimate of what two
texts share, not a threshold, so runs are short: a text of ten words of which half changed should not look like another.
Lanes count up to 32,767 and wrap around beyond, which leaves equality as it is.

Null texts count as empty. Texts are read whole; repeated rows get equal fingerprints each; empty tables give empty results;
other columns stay as they are, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow, shingles, text_bytes, with_fields, words

#: Lanes of both parts; the words of a run.
EQUAL, LIKE, WIDTH = 8, 256, 2
_BYTES = EQUAL * 8 + LIKE * 2


def vectors(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprint of each text of a column."""
    raw, offsets = text_bytes(array)
    n = len(offsets) - 1
    equal, like = np.zeros((n, EQUAL), np.uint64), np.zeros((n, LIKE), np.uint16)
    if not n:
        return equal, like
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.r_[offsets[:-1], breaks + 1], kind="stable")  # a text's first line, and one behind each break
    row = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, offsets)))
    ends = np.r_[starts[1:] - 1, 0]
    last = np.r_[row[1:] != row[:-1], True]
    ends[last] = offsets[1:]
    data = raw.tobytes()
    digests = b"".join([hashlib.blake2b(data[s:e], digest_size=EQUAL * 8).digest() for s, e in zip(starts.tolist(), ends.tolist())])
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    equal[:] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EQUAL), heads, axis=0, dtype=np.uint64)
    h, text, at, _ = words(array)
    if len(h):
        line = np.searchsorted(starts, at, side="right") - 1
        # of equal starts (an empty line at a text's end and the next text) the word's own is the last, as an empty line has no word
        runs, of = shingles(h, line, WIDTH)
        place = row[of] * LIKE + (runs % np.uint64(LIKE)).astype(np.int64)
        sign = ((runs >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
        ups, downs = np.bincount(place[sign > 0], minlength=n * LIKE), np.bincount(place[sign < 0], minlength=n * LIKE)
        like[:] = (ups - downs).astype(np.uint16).reshape(n, LIKE)
    return equal, like


def packed(equal: np.ndarray, like: np.ndarray) -> list[bytes]:
    return [a + b for a, b in zip((r.tobytes() for r in equal.astype("<u8")), (r.tobytes() for r in like.astype("<u2")))]


def unpacked(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of a column of fingerprints; nulls are those of nothing."""
    rows = np.frombuffer(b"".join([x or bytes(_BYTES) for x in array.to_pylist()]), np.uint8).reshape(-1, _BYTES)
    return rows[:, : EQUAL * 8].copy().view("<u8").astype(np.uint64), rows[:, EQUAL * 8 :].copy().view("<u2").astype(np.uint16)


def likeness_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of the fingerprints in rows of equal number."""
    x, y = a[1].astype(np.int16).astype(float), b[1].astype(np.int16).astype(float)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(2 * (x * y).sum(axis=1) / np.where(both > 0, both, 1), 0, 1)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, near)


def _added(df: DataFrame, out: str, kind: str, make, column: str | None = None) -> DataFrame:
    """``df`` with one more column, made from each batch."""
    keep = [f for f in df.schema if f.name != out]

    def kernel(batch: pa.RecordBatch):
        kept = [k for k, name in enumerate(batch.schema.names) if name != out]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), make(batch)], names=[*(batch.schema.names[k] for k in kept), out])

    return map_arrow(df, kernel, with_fields(keep, f"`{out}` {kind}"), column)


def _of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out`` binary."""
    return _added(df, out, "binary", lambda b: pa.array(packed(*vectors(_of(b, text))), pa.binary()), text)


def changed(df: DataFrame, fingerprint: str, inserted: str | None = None, deleted: str | None = None, out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out`` binary: ``fingerprint`` after lines (columns of text; null: none) were put in and taken away."""

    def make(batch: pa.RecordBatch) -> pa.Array:
        equal, like = unpacked(_of(batch, fingerprint))
        for name, sign in ((inserted, 1), (deleted, -1)):
            if name:
                lines = _of(batch, name)
                there = np.asarray(lines.is_valid())[:, None]
                for total, more in zip((equal, like), vectors(lines)):
                    more = np.where(there, more, 0).astype(more.dtype)
                    total += more if sign > 0 else -more  # unsigned: modulo the lane's power
        return pa.array(packed(equal, like), pa.binary())

    return _added(df, out, "binary", make, inserted or deleted)


def likeness(df: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """``df`` with ``out`` double, how alike two columns of fingerprints are (a null counts as that of nothing)."""
    return _added(df, out, "double", lambda batch: pa.array(likeness_of(unpacked(_of(batch, a)), unpacked(_of(batch, b)))))


def of_paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fingerprint binary) of documents whose lines lie in many rows: the sum of their rows' fingerprints.

    Rows of a key that stand together are summed before the exchange, and in a stream after it, so that a key may hold any
    number of rows. A null text is no line.
    """

    def summing(make):
        def kernel(batch: pa.RecordBatch, _=None):
            if not batch.num_rows:
                return
            equal, like = make(batch.column(1))
            codes = batch.column(0).dictionary_encode()
            index = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(index[order]) != 0])
            sums = packed(np.add.reduceat(equal[order], heads, axis=0, dtype=np.uint64), np.add.reduceat(like[order], heads, axis=0, dtype=np.uint16))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order[heads])), pa.array(sums, pa.binary())], names=[key, "fingerprint"])

        return kernel

    kinds = with_fields([df.schema[key]], "fingerprint binary")
    parts = map_arrow(df.where(F.col(text).isNotNull()).select(key, text), summing(vectors), kinds, text)
    for salts in (64, 1):  # a key's sums go to 64 tasks at most, then to one
        parts = map_arrow(parts.repartition(key, F.pmod(F.spark_partition_id(), F.lit(salts))).sortWithinPartitions(key), summing(unpacked), kinds)
    return parts.groupBy(key).agg(F.collect_list("fingerprint").alias("sums")).transform(lambda d: _added(d, "fingerprint", "binary", _total)).select(key, "fingerprint")


def _total(batch: pa.RecordBatch) -> pa.Array:
    sums = batch.column(batch.schema.get_field_index("sums"))
    heads = sums.offsets.to_numpy()[:-1] - sums.offsets[0].as_py()
    equal, like = unpacked(sums.flatten())
    return pa.array(packed(np.add.reduceat(equal, heads, axis=0, dtype=np.uint64), np.add.reduceat(like, heads, axis=0, dtype=np.uint16)) if len(sums) else [], pa.binary())


# The next document ----------------------------------------------------------------------------------


def _parts(df: DataFrame, key: str, parts: int):
    """A column that cuts the order of (key, hash) into about ``parts`` parts of like size; a key that fills several is cut by hash."""
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    bounds = sorted(found or [])  # as many as parts
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(r[0]).cast("long") for r in rows))
    table = F.array(*(F.array(*(F.lit(b).cast("long") for b in r)) for r in rows))

    def below(keep):
        """How many bounds hold ``keep``, which all those before one that does hold too."""
        row = F.size(F.filter(heads, keep))
        return F.when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.get(table, row - 1), keep)))

    value = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))  # nulls first
    low, high = below(lambda b: b < value), below(lambda b: b <= value)
    return (low + F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * (high - low + 1)).cast("int")).cast("int")


def with_next(df: DataFrame, kernel, schema, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``kernel`` makes of each document and the next one, by an ascending integer ``key``; after the last comes the first.

    Null keys come first, and rows of one key by a hash of their texts; equal rows are each other's next. ``kernel(keys,
    texts)`` gets columns of documents that follow each other and returns a batch with a row for each but the last.

    The order is cut into parts, several for each shuffle partition, and each part ends with a copy of the next part's first
    document (or rows equal to it); texts are exchanged once, and a task streams through its parts in order.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_h"))
    rows = rows.select(_parts(rows, "_key", 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).alias("_part"), "_key", "_h", "_text")
    first = sorted((r[0], r[1], r[2]) for r in rows.groupBy("_part").agg(F.min(F.struct("_key", "_h")).alias("m")).select("_part", "m._key", "m._h").collect())
    before = [first[k - 1][0] for k in range(len(first))]  # the part that ends where each one begins
    guests = pa.table({"to": pa.array(before, pa.int32()), "k": pa.array([f[1] for f in first], pa.int64()), "h": pa.array([f[2] for f in first], pa.int64())})
    again = rows.join(F.broadcast(spark.createDataFrame(guests)), F.col("_key").eqNullSafe(F.col("k")) & (F.col("_h") == F.col("h")))  # a row a part
    order = ["_part", "_guest", "_key", "_h"]
    every = rows.select("_part", F.lit(0).alias("_guest"), "_key", "_h", "_text").unionAll(again.select(F.col("to").alias("_part"), F.lit(1).alias("_guest"), "_key", "_h", "_text"))

    def step(batch: pa.RecordBatch, held: dict):
        """``held``: the last document, whose next one is not here yet."""
        part, guest, keys, _, texts = batch.columns
        part, guest = part.to_numpy(), guest.to_numpy()
        if "last" in held:
            p, k, t = held.pop("last")
            part, guest = np.r_[p, part], np.r_[0, guest]
            keys, texts = pa.concat_arrays([k, keys]), pa.concat_arrays([t, texts])
        n = len(part)
        if not n:
            return
        if not guest[-1]:
            held["last"] = part[-1:], keys.slice(n - 1), texts.slice(n - 1)
        begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for s, e in zip(begins.tolist(), [*begins[1:].tolist(), n]):
            own = int((guest[s:e] == 0).sum())
            e = min(e, s + own + 1)  # of several guests the first one
            if e - s > 1:
                yield kernel(keys.slice(s, e - s), texts.slice(s, e - s))

    return map_arrow(every.repartition("_part").sortWithinPartitions(*order), step, schema, "_text", setup=dict)


def edited_texts(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Code points of each text but the last, and its first half (the larger) with as many of the next text's as it lost."""
    raw, offsets = text_bytes(texts)
    leads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where code points begin, and the end
    at = np.searchsorted(leads, offsets)
    chars = np.diff(at)
    lost = chars[:-1] // 2
    kept = leads[at[:-2] + chars[:-1] - lost]
    more = leads[at[1:-1] + np.minimum(lost, chars[1:])]
    data = raw.tobytes()
    return chars[:-1], [data[a:b] + data[c:d] for a, b, c, d in zip(offsets[:-2].tolist(), kept.tolist(), offsets[1:-1].tolist(), more.tolist())]


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        chars, edited = edited_texts(texts)
        every, other = vectors(texts), vectors(pa.array(edited, pa.binary()).cast(pa.string()))
        own, after = tuple(x[:-1] for x in every), tuple(x[1:] for x in every)
        columns = {
            "doc_id": keys.slice(0, len(keys) - 1),
            "n_chars": pa.array(chars, pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            "fingerprint": pa.array([x.hex() for x in packed(*own)]),
            "edited_fingerprint": pa.array([x.hex() for x in packed(*other)]),
            "near_edited": pa.array(likeness_of(own, other), pa.float64()),
            "near_next": pa.array(likeness_of(own, after), pa.float64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), kernel, kinds)


#: BLAKE2b, and sums of vectors that wrap around, are beyond SQL; tests hold the query against plain dictionaries.
QUERIES = {"op13_fingerprints": op13_fingerprints}
ORACLE_SQL: dict[str, str] = {}
