"""Benchmark decontamination by SimHash windows, a multi-index over Hamming blocks and exact verification.

A document is read in windows of every item's size, at every start (a document shorter than that is one window). Shingles
of five words are numbered by their occurrence in the window, so that weights are counts and all elements differ, whatever
repeats. A window's fingerprint is the majority of its elements' 128-bit hashes, rolled on from start to start. The index
finds whichever item's fingerprint is within ``RADIUS`` bits: it differs in some of ``BLOCKS`` blocks by at most RADIUS //
BLOCKS bits, so that probing each block's table for these finds it. For every item found, the shared elements of all windows
are then counted exactly: it leaks where the weighted Jaccard similarity of a window and the item reaches ``THRESHOLD``, and
the most similar window is given.

Two sets of similarity 0.75 have a cosine of at least 6/7, so that a bit of their fingerprints differs with a probability of
0.172: of 128 bits, 22 with a deviation of 4.3. ``RADIUS`` lies six deviations beyond, so that a leak at the very threshold is
lost once in 10^8 windows. Windows in which less than ``THRESHOLD`` of the shingles stand in any item need no fingerprint: a
window of w shingles shares 3/7 of w + m with an item of m, and m is 3/4 of w at least, which makes 3/4 of w.

Items of fewer than five words are one shingle and match a window of as many words exactly; items without words match
nothing. Null and empty texts leak nothing. Equal rows leak each. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigloom.llm.common import map_arrow, mix, Sent, shingles, words

WIDTH, THRESHOLD = 5, 0.75
RADIUS, BLOCKS, BLOCK_BITS = 47, 8, 16
#: Bytes of benchmark text that are sent to every executor at once; more items take more passes.
PASS_BYTES = 32 << 20
#: Windows that are rolled and looked up in one go.
WINDOWS = 2048

_FLIPS = RADIUS // BLOCKS
_MASKS = np.array([sum(1 << b for b in c) for k in range(_FLIPS + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint16)
_SECOND = np.uint64(0xA0761D6478BD642F)
_NEXT = np.uint64(0x8EBC6AF09C88C6E3)


def bits_of(shingle: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The 128 bits of each element: a shingle and which of its equals it is, from 1."""
    first = mix(shingle + number.astype(np.uint64) * _NEXT)
    return np.unpackbits(np.stack([first, mix(first ^ _SECOND)], axis=1).view(np.uint8), axis=1)


def majority(sums: np.ndarray, size: int) -> np.ndarray:
    """Blocks of the fingerprints whose elements' bits sum to ``sums``."""
    return np.packbits(sums * 2 > size, axis=-1).view(np.uint16)


def numbered(values: np.ndarray) -> np.ndarray:
    """Which of its equals each value is, from 1."""
    order = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]][: len(values)])
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(heads, np.diff(np.r_[heads, len(values)])) + 1
    return out


def fingerprint(shingles_: np.ndarray) -> np.ndarray:
    """128 bits as eight blocks of 16."""
    return majority(bits_of(shingles_, numbered(shingles_)).sum(axis=0, dtype=np.int64), len(shingles_))


def rolled(shingles_: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles that start in low..high."""
    own = shingles_[low : high + size]
    n = len(own)
    _, code = np.unique(own, return_inverse=True)
    keys = np.sort(code * (n + 1) + np.arange(n))
    sums = bits_of(own[:size], numbered(own[:size])).sum(axis=0, dtype=np.int64)[None, :]
    if high > low:
        out = np.arange(high - low)  # leaves the window that starts there, as the last of its equals
        come = out + size  # enters the window that starts one later
        number = lambda at, first, stop: np.searchsorted(keys, code[at] * (n + 1) + stop) - np.searchsorted(keys, code[at] * (n + 1) + first)
        change = bits_of(own[come], number(come, out + 1, come + 1)).astype(np.int64) - bits_of(own[out], number(out, out, out + size))
        sums = np.concatenate([sums, sums + np.cumsum(change, axis=0)])
    return majority(sums, size)


def runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[g], first[g] + 1, ... of each run g, ``count[g]`` of them, and each one's g."""
    group = np.repeat(np.arange(len(first)), count)
    return group, np.arange(len(group)) + (first - np.cumsum(count) + count)[group]


class Items:
    """Fingerprints of the items, indexed by block, and postings of their shingles."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, row, _, _ = words(pa.array(texts, pa.string()))
        self.ids = ids
        self.short: dict[int, dict[int, list[int]]] = {}
        self.size = np.bincount(row, minlength=len(ids)).astype(np.int64)
        s, at = shingles(h, row, WIDTH)
        heads = np.searchsorted(at, np.arange(len(ids) + 1))
        for k in np.flatnonzero((self.size > 0) & (self.size < WIDTH)).tolist():
            self.short.setdefault(int(self.size[k]), {}).setdefault(int(s[heads[k]]), []).append(k)
        self.shingles = [s[a:b] for a, b in zip(heads, heads[1:])]
        long = self.size[at] >= WIDTH
        self.known, code = np.unique(s[long], return_inverse=True)
        #: One entry for each item and distinct shingle of it, by item.
        order = np.lexsort((code, at[long]))
        code, at = code[order], at[long][order]
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])][: len(code)])
        self.code, self.item, self.times = code[new], at[new], np.diff(np.r_[new, len(code)])
        self.first = np.searchsorted(self.item, np.arange(len(ids) + 1))
        self.windows = np.unique(self.size[self.size >= WIDTH]) - WIDTH + 1
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.known & np.uint64((1 << 20) - 1)] = True

    @cached_property
    def prints(self) -> np.ndarray:
        return np.array([fingerprint(s) if len(s) else np.zeros(BLOCKS, np.uint16) for s in self.shingles], np.uint16).reshape(-1, BLOCKS)

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block, its values (ascending), where the items of each begin, and the items."""
        long = np.flatnonzero(self.size >= WIDTH)
        out = []
        for b in range(BLOCKS):
            order = long[np.argsort(self.prints[long, b], kind="stable")]
            values, first = np.unique(self.prints[order, b], return_index=True)
            out.append((values, np.r_[first, len(order)], order))
        return out

    def within(self, prints: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """All items whose fingerprints differ by at most RADIUS bits from one of ``prints`` (with ``sizes`` in shingles: that can be similar)."""
        prints = np.atleast_2d(prints)
        near = np.zeros(len(self.ids), bool)
        for b, (values, first, items) in enumerate(self.tables):
            asked = np.unique(prints[:, b])
            if len(values) <= len(_MASKS):  # which values are near, or which near values are there: whichever is less
                there = np.flatnonzero((np.bitwise_count(asked[:, None] ^ values) <= _FLIPS).any(axis=0))
            else:
                probe = np.zeros(1 << BLOCK_BITS, bool)
                for a in asked:
                    probe[_MASKS ^ a] = True
                there = np.flatnonzero(probe[values])
            near[items[runs(first[there], first[there + 1] - first[there])[1]]] = True
        near = np.flatnonzero(near)
        whole = np.ascontiguousarray(prints).view(np.uint64)
        found = [np.zeros(0, np.int64)]
        for part in np.split(near, np.arange(1024, len(near), 1024)):
            close = np.bitwise_count(whole[:, None, :] ^ self.prints[part].view(np.uint64)[None]).sum(axis=2) <= RADIUS
            if sizes is not None:
                m = self.size[part] - WIDTH + 1
                close &= (sizes[:, None] >= THRESHOLD * m) & (sizes[:, None] * THRESHOLD <= m)
            found.append(part[close.any(axis=0)])
        return np.concatenate(found)

    def proposed(self, shingles_: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Items that some window of a document may be similar to; ``at``: where its known shingles stand."""
        n = len(shingles_)
        known = np.zeros(n + 1, np.int64)
        known[at + 1] = 1
        known = np.cumsum(known)
        found, waiting = np.zeros(len(self.ids), bool), []

        def look_up():
            prints, sizes = zip(*waiting)
            found[self.within(np.concatenate(prints), np.concatenate(sizes))] = True
            waiting.clear()

        for w in np.unique(np.minimum(self.windows, n)).tolist():
            starts = np.flatnonzero(known[w:] - known[:-w] >= THRESHOLD * w)
            cuts = np.flatnonzero(np.diff(starts) > 1) + 1
            for run in np.split(starts, cuts) if len(starts) else []:
                for low in range(int(run[0]), int(run[-1]) + 1, WINDOWS):
                    high = min(low + WINDOWS - 1, int(run[-1]))
                    prints = rolled(shingles_, w, low, high)
                    waiting.append((prints, np.full(len(prints), w)))
                    if sum(len(p) for p, _ in waiting) >= WINDOWS:
                        look_up()
        if waiting:
            look_up()
        return np.flatnonzero(found)

    def similar(self, items: np.ndarray, code: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of each size's most similar window to each of ``items``, from the known shingles of a document with ``n`` shingles.

        A shingle that an item holds c times counts in a window if fewer than c equal ones stand before it there, so that each
        place counts for one run of starts, and the sums of these runs are the shared shingles.
        """
        order = np.argsort(code, kind="stable")
        at = at[order]
        own, first, count = np.unique(code[order], return_index=True, return_counts=True)
        for k in items.tolist():
            m = int(self.size[k]) - WIDTH + 1
            mine = slice(self.first[k], self.first[k + 1])
            g = np.minimum(np.searchsorted(own, self.code[mine]), len(own) - 1)
            there = own[g] == self.code[mine]
            g = g[there]
            group, j = runs(first[g], count[g])
            place, times = at[j], self.times[mine][there][group]
            before = np.arange(len(j)) - times  # the equal shingle that must be out of the window for this one to count
            after = np.where(j - first[g][group] >= times, place[np.maximum(before, 0)] + 1, 0)
            fit = self.windows[(self.windows >= THRESHOLD * m) & (self.windows * THRESHOLD <= m) | (self.windows > n)]
            for w in np.unique(np.minimum(fit, n)).tolist():
                low, high = np.maximum(after, place - w + 1), np.minimum(place, n - w) + 1
                low, high = low[low < high], high[low < high]
                starts, which = np.unique(np.r_[low, high], return_inverse=True)
                if not len(starts):
                    continue
                held = np.cumsum(np.bincount(which, np.r_[np.ones(len(low)), -np.ones(len(high))]))
                best = int(np.argmax(held))
                similarity = float(held[best] / (w + m - held[best]))
                if similarity >= THRESHOLD:
                    yield k, similarity, int(starts[best]), w + WIDTH - 1

    def leaks(self, array: pa.Array) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> (similarity, first word, words) of the most similar window, the first of equals."""
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        h, row, _, _ = words(array)
        n = len(h)
        if not n:
            return out
        heads = np.searchsorted(row, np.arange(len(array) + 1))

        def put(r: int, k: int, similarity: float, start: int, size: int) -> None:
            start -= int(heads[r])
            old = out.get((r, k))
            if old is None or (similarity, -start) > (old[0], -old[1]):
                out[r, k] = (similarity, start, size)

        for size, table in self.short.items():
            if n < size:
                continue
            s = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : n - size + 1 + k]
            s = mix(s ^ (np.uint64(size) << np.uint64(56)) ^ np.uint64(0xD6E8FEB86659FD93))
            for p in np.flatnonzero(np.isin(s, np.array(list(table), np.uint64)) & (row[: len(s)] == row[size - 1 :])).tolist():
                for k in table[int(s[p])]:
                    put(int(row[p]), k, 1.0, p, size)
        if n < WIDTH or not len(self.known):
            return out
        s = np.zeros(n - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : n - WIDTH + 1 + k]
        s = mix(s)
        hits = np.flatnonzero(self.sieve[s & np.uint64((1 << 20) - 1)] & (row[: len(s)] == row[WIDTH - 1 :]))
        code = np.minimum(np.searchsorted(self.known, s[hits]), len(self.known) - 1)
        same = self.known[code] == s[hits]
        hits, code = hits[same], code[same]
        for own in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(row[hits])) + 1) if len(hits) else []:
            r = int(row[hits[own[0]]])
            low = int(heads[r])
            end = int(heads[r + 1]) - WIDTH + 1
            if len(own) < THRESHOLD * min(self.windows[0], end - low):
                continue
            at = hits[own] - low
            for k, similarity, start, size in self.similar(self.proposed(s[low:end], at), code[own], at, end - low):
                put(r, k, similarity, low + start, size)
        return out


def passes(items: DataFrame, key: str, text: str) -> list[Items]:
    """The benchmark in parts of bounded size, each small enough to be sent to every executor."""
    rows = items.select(key, text, F.octet_length(F.coalesce(text, F.lit(""))).alias("_n")).dropDuplicates([key, text])
    total = rows.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-total // PASS_BYTES))
    out = []
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(key, text), F.lit(parts)) == k)
        got = part.orderBy(key).collect()
        out.append(Items([r[key] for r in got], [r[text] for r in got]))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and item that it holds: key, item key, similarity, first word and words of the window."""
    kinds = docs.schema[key].dataType, items.schema[item_key].dataType
    out = None
    for part in passes(items, item_key, item_text):
        sent = Sent(docs.sparkSession, part)

        def kernel(batch: pa.RecordBatch, sent=sent):
            found = sent.value.leaks(batch.column(1))
            at = pa.array([r for r, _ in found], pa.int64())
            ids = [sent.value.ids[k] for _, k in found]
            similarity, start, size = zip(*found.values()) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(ids, to_arrow_type(kinds[1])), pa.array(similarity, pa.float64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=[key, item_key, "similarity", "first_word", "n_words"])

        got = map_arrow(docs.select(key, text), kernel, f"`{key}` {kinds[0].simpleString()}, `{item_key}` {kinds[1].simpleString()}, similarity double, first_word int, n_words int", text)
        out = got if out is None else out.unionAll(got)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for part in passes(items, item_key, item_text):
        sent = Sent(docs.sparkSession, part)

        def kernel(batch: pa.RecordBatch, sent=sent):
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in sent.value.leaks(batch.column(batch.schema.get_field_index(text)))]] = False
            yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, kernel, docs.schema, text)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows: a document, an item that it holds, their similarity and the window."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL: dict[str, str] = {}
