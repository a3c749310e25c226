"""Byte-level BPE by replaying merges over a slab of text.

Each slab (a slice of an Arrow batch) is split by the tokenizer's pattern; its distinct words that are new to the
task form one corpus. An inverted index leads from a token pair's merged rank to the positions where the pair stands.
Ranks are taken in rising order, every merge is applied at all its positions, and only the touched neighbours enter
the index anew. A merge that creates a pair of lower rank inside a word puts the rest of this word back, so that the
result of every word is that of merging its lowest, leftmost pair again and again.

Null texts count as empty; an empty text has no tokens; very long words cost n log n. A worker keeps encoded words from slab
to slab and from task to task, up to a bounded number; the older half of them makes room. The result does not depend on it.
Repeated rows get equal ids each; an empty table gives an empty result; other columns but the text stay as they are, and those of
the result's names are replaced.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import sys
from hashlib import sha256
from itertools import islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow, with_fields

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encoded words that a worker remembers, and the longest of them.
KEPT_WORDS, KEPT_BYTES = 700_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """All pairs of tokens that merge, by both ids in one integer, and the ranks of pairs of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                if (rank := ranks.get(bytes([a, b]))) is not None:
                    self.first[a, b] = rank


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    gaps = np.r_[0, np.cumsum(sizes + 1)]
    ids = merges.byte[raw]
    ids[gaps] = -1  # between words
    rank = np.full(len(raw), -1, np.int64)
    rank[:-1] = merges.first[raw[:-1], raw[1:]]
    rank[gaps] = -1
    rank[gaps[1:] - 1] = -1
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    heads = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if len(order) else order
    index = {int(rank[g[0]]): g.tolist() for g in np.split(order, heads[1:])} if len(order) else {}
    heap = sorted(index)
    token, current = ids.tolist(), rank.tolist()
    after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
    ends = gaps.tolist()
    get, pop, push = merges.pairs.get, heapq.heappop, heapq.heappush
    while heap:
        now = pop(heap)
        places = index.pop(now)
        if len(places) > 1:
            places = sorted(set(places))
        here = now << 32
        held = -1  # positions below this wait: their word has a pair of lower rank now
        for i in places:
            if current[i] != now:
                continue
            if i < held:
                if now in index:
                    index[now].append(i)
                else:
                    index[now] = [i]
                    push(heap, now)
                continue
            j, h = after[i], before[i]
            k = after[j]
            token[i], token[j], current[j] = now, -2, -1
            after[i], before[k] = k, i
            right, left = token[k], token[h]
            new = get(here | right) if right >= 0 else None
            if new is None:
                current[i] = -1
            else:
                current[i] = new
                if new in index:
                    index[new].append(i)
                else:
                    index[new] = [i]
                    push(heap, new)
                if new < now:
                    held = ends[bisect.bisect_left(ends, i)]
            if left >= 0:
                new = get(left << 32 | now)
                if new is None:
                    current[h] = -1
                else:
                    current[h] = new
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        push(heap, new)
                    if new < now:
                        held = ends[bisect.bisect_left(ends, i)]
    final = np.array(token, np.int64)
    alive = final >= 0
    flat, count = final[alive].astype("<u4").tobytes(), np.r_[0, np.cumsum(alive)]
    cut = (4 * count[gaps]).tolist()
    return [flat[a:b] for a, b in zip(cut, cut[1:])]


class Coder:
    """Encodes and decodes by ranks and a pattern; remembers a bounded number of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.merges = ranks, regex.compile(pattern).findall, Merges(ranks)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers."""
        split = [self.find(t) if t else [] for t in texts]
        known = self.known
        new = {w for words in split for w in words if w not in known}
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                for w in list(islice(known, len(known) // 2)):
                    del known[w]
                new = {w for words in split for w in words if w not in known}
            raw = {w: w.encode() for w in new}
            whole = {w: np.array([self.ranks[b]], "<u4").tobytes() for w, b in raw.items() if b in self.ranks}
            rest = [w for w in new if w not in whole]
            known |= whole | dict(zip(rest, replay([raw[w] for w in rest], self.merges)))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in [w for w in new if len(w) > KEPT_BYTES]:
            del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder_of(name: str, ranks: dict[bytes, int], pattern: str) -> Coder:
    """The worker's coder of a vocabulary. Code travels by value, so that what outlives a task has its home among the modules."""
    home = sys.modules.setdefault("sigloom_kept_coders", ModuleType("sigloom_kept_coders"))
    if name not in home.__dict__:
        home.__dict__[name] = Coder(ranks, pattern)
    return home.__dict__[name]


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without ``text`` (and with these replaced): ``ids`` binary (little-endian unsigned 32-bit), ``n_tokens`` long, ``decoded`` binary."""
    ranks = read_ranks(path)
    name = sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: bounded
    keep = [f for f in df.schema if f.name not in (text, "ids", "n_tokens", "decoded")]

    def kernel(batch: pa.RecordBatch, coder: Coder):
        ids = coder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([coder.decode(x) for x in ids], pa.binary())],
            names=[*(f.name for f in keep), "ids", "n_tokens", "decoded"],
        )

    more = "ids binary, n_tokens long, decoded binary"
    return map_arrow(df.select(*(f"`{f.name}`" for f in keep), text), kernel, with_fields(keep, more), text, lambda: coder_of(name, sent.value, pattern))


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_decode(docs, *public_vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
