"""Exact self-join of documents on the Jaccard similarity of their word shingles, by signature trees.

1. ``shingle_sets``: each document's distinct five-word shingles, as a size and a 64-bit class (equal sets, equal class).
   Equal sets are linked; everything below handles one set for each class.
2. ``candidates``: shingles are dealt out by hash, packed in binary blobs, and counted over classes. Rarest first (by
   count, then hash) a set of n shingles can only link to another if both hold a shared one among their first
   n - ceil(0.75 n) + 1. Most sets have so many shingles of their own that they fall out here. Shingles that a share of
   1 / HOT of all documents holds are known beforehand (a set of bounded size) and stand last without being dealt out.
3. Sets that share such a shingle form candidate groups (connected components); every link is inside a group.
4. Each group is joined by a signature tree: sets ordered by size stand in leaves, nodes hold the OR of token bitmaps,
   size ranges and slack; a dual traversal drops node pairs whose largest possible overlap is too small or whose sets are
   linked already, and the rest is verified exactly. Groups above ``BLOCK`` sets are cut into blocks: blocks are joined
   in themselves, one set of each result stands for it in the next round, and at last all sets outside a group's main
   result are joined, block by block, with those that share a shingle of their first. No link between different results is
   lost.

Null and empty texts have empty sets, which link to nothing. Repeated rows and equal texts share a component. Shingles
are compared by 64-bit hashes. An empty table gives an empty result; columns beyond id and text are not looked at, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sigloom.llm.common import discard, distinct_pairs, durable, map_arrow, mix, pieces, shingles, small_batches, tidy, words
from sigloom.llm.components import connected_components

WIDTH = 5
#: 100 * overlap >= 75 * union, as 7 * overlap >= 3 * (size + size).
OVERLAP, SIZES = 7, 3
#: A shingle is hot from this share of all documents on. Shingles of one counting part; of one blob's chunk.
HOT, TASK_TOKENS, CHUNK_TOKENS, CHUNK_DOCS = 256, 1_000_000, 1_000_000, 60_000
#: Partitions of an exchange at most; beyond it, a task takes several parts one after the other.
TASKS = 16_384
#: Sets of a block, of a leaf, and nodes of a node.
BLOCK, LEAF, FANOUT = 512, 16, 8


def read_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their rows, and each row's size and class, of a batch (key, text)."""
    h, row, _, _ = words(batch.column(1))
    s, r = distinct_pairs(*shingles(h, row, WIDTH))
    n = np.bincount(r, minlength=batch.num_rows)
    heads = np.r_[0, np.cumsum(n)][:-1]
    cls = np.zeros(batch.num_rows, np.uint64)
    some = n > 0
    if some.any():
        cls[some] = mix(np.add.reduceat(mix(s), heads[some]) ^ n[some].astype(np.uint64))
    return s, r, n, cls


class Frequent:
    """Lossy counting over all documents of a task: a count falls short of the true one by at most ``loss`` of the documents.

    A shingle that a share s of all documents holds keeps a summed count of s - 2 * loss of them at least, however it is spread.
    """

    def __init__(self, loss: float):
        self.loss, self.docs = loss, 0
        self.token, self.count, self.since = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.waiting, self.before = [], 0, 0

    def add(self, token: np.ndarray, docs: int) -> None:
        """The shingles of ``docs`` sets, once for each set that holds them."""
        self.new.append(token)
        self.waiting += len(token)
        self.docs += docs
        if self.waiting >= CHUNK_TOKENS:
            self._count()

    def _count(self) -> None:
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.new]), return_counts=True)
        self.token, first, which = np.unique(np.r_[self.token, token], return_index=True, return_inverse=True)
        since = np.r_[self.since, np.full(len(token), self.loss * self.before)][first]
        count = np.bincount(which, np.r_[self.count, count], len(self.token)).astype(np.int64)
        stay = count + since > self.loss * self.docs
        self.token, self.count, self.since = self.token[stay], count[stay], since[stay]
        self.new, self.waiting, self.before = [], 0, self.docs

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and counts, those of a share above ``loss``; what a task holds back is at most twice that share."""
        self._count()
        some = self.count >= max(2, self.loss * self.docs)
        return self.token[some], self.count[some]


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, cls) of each row, and rows (token, count) of shingles that are frequent in a task's documents."""
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[key]
    small_batches(docs.sparkSession)

    def run(batches):
        frequent, none = Frequent(0.25 / HOT), None
        for batch in batches:
            none = batch.column(0).type
            for part in pieces(batch, text):
                s, _, n, cls = read_sets(part)
                frequent.add(s, part.num_rows)
                blank = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cls.view(np.int64), mask=n == 0), blank, blank], names=[key, "n_shingles", "cls", "token", "count"])
        token, count = frequent.often()
        if len(token):
            blank = pa.nulls(len(token), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(token), none), blank, blank, pa.array(token.view(np.int64)), pa.array(count)], names=[key, "n_shingles", "cls", "token", "count"])
        tidy()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, cls long, token long, count long")


def with_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, cls): each row of ``docs`` as one struct, and the class of its set (null where it is empty)."""

    def kernel(batch: pa.RecordBatch):
        _, _, n, cls = read_sets(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls.view(np.int64), mask=n == 0)], names=["row", "cls"])

    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    return map_arrow(whole, kernel, StructType([StructField("row", whole.schema["row"].dataType), StructField("cls", LongType())]), "text")


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)]


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


_DEALT = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])
_DEALT_SQL = "part int, side int, ids binary, sizes binary, tokens binary, counts binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)


def candidates(docs: DataFrame, hot: np.ndarray, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sets that may link: (cls, n, tokens binary, prefix array): their shared shingles, and those of the prefix."""
    spark = docs.sparkSession
    small_batches(spark)
    k = max(7, (max(1, total) // TASK_TOKENS).bit_length())
    parts, sides = 1 << k, max(16, 1 << (k - 1))
    part_bits, side_bits = np.uint64(64 - k), np.uint64(64 - (sides.bit_length() - 1))
    width = 8 - k // 8 if k < 16 else 6  # bytes of a shingle's hash that its part does not tell
    low_bits, known = np.uint64(8 * width), k - 64 + 8 * width
    sent = spark.sparkContext.broadcast(np.unique(hot))  # at most 2 * HOT * mean set size entries

    def by_side(cls: np.ndarray, own: np.ndarray, token: np.ndarray, count: np.ndarray, sizes: np.ndarray | None):
        """Rows for the second exchange; ``own`` (ascending) points into ``cls`` (ascending, distinct)."""
        held = np.bincount(own, minlength=len(cls)).astype(np.uint32)
        at = np.r_[0, np.cumsum(held)]
        side = (cls >> side_bits).astype(np.int64)
        cut = _groups(side)
        for a, b in zip(cut, cut[1:]):
            x, y = at[a], at[b]
            size = sizes[a:b].astype(np.uint32).tobytes() if sizes is not None else None
            yield int(side[a]), cls[a:b].tobytes() + held[a:b].tobytes(), size, token[x:y].tobytes(), count[x:y].astype(np.uint32).tobytes()

    def deal(batches):
        tokens, owners, ids, sizes = [], [], [], []

        def flush():
            if not ids:
                return
            cls, first, inverse = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
            size = np.concatenate(sizes)[first]
            token, own = np.concatenate(tokens), np.concatenate(owners)
            fresh = first[inverse[own]] == own  # of equal sets in the chunk, the first
            token, own = token[fresh], inverse[own[fresh]]
            is_hot = np.isin(token, sent.value)
            h_own, h_token = own[is_hot], token[is_hot]
            order = np.lexsort((h_token, h_own))
            out, volume = [], 0
            for side, a, b, c, d in by_side(cls, h_own[order], h_token[order], np.full(len(order), 2**32 - 1), size):
                out.append((side % parts, side, a, b, c, d))
            yield _rows(out)
            token, own = token[~is_hot], own[~is_hot]
            part = (token >> part_bits).astype(np.int64)
            order = np.lexsort((own, part))
            token, own, part = token[order], own[order], part[order]
            cut, out = _groups(part), []
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                g = _groups(own[a:b])
                who = cls[own[a:b][g[:-1]]]
                blob = np.ascontiguousarray(token[a:b].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
                out.append((int(part[a]), -1, who.tobytes(), None, blob, np.diff(g).astype(np.uint16 if len(g) < 2 or np.diff(g).max() < 65536 else np.uint32).tobytes()))
                volume += len(blob)
                if volume > 4 << 20:
                    yield _rows(out)
                    out, volume = [], 0
            if out:
                yield _rows(out)
            for x in (tokens, owners, ids, sizes):
                x.clear()

        held, docs_held = 0, 0
        for batch in batches:
            for part in pieces(batch, text):
                s, r, n, cls = read_sets(part)
                some = np.flatnonzero(n > 0)
                place = np.cumsum(n > 0) - 1
                tokens.append(s)
                owners.append(place[r] + docs_held)
                ids.append(cls[some])
                sizes.append(n[some])
                held, docs_held = held + len(s), docs_held + len(some)
                if held > CHUNK_TOKENS or docs_held > CHUNK_DOCS:
                    yield from flush()
                    held = docs_held = 0
        if docs_held:
            yield from flush()
        tidy()

    def one_by_one(batches, column):
        """(number, rows) of each part or side of a task, whose rows stand together; rows that only pass have None."""
        now, held = None, []
        for batch in batches:
            through = []
            for row in batch.to_pylist():
                if column == "part" and row["side"] >= 0:
                    through.append(tuple(row.values()))
                    continue
                if row[column] != now:
                    if held:
                        yield now, held
                    now, held = row[column], []
                held.append(row)
            if through:
                yield None, through
        if held:
            yield now, held

    def count(batches):
        for part, rows in one_by_one(batches, "part"):
            if part is None:
                yield _rows(rows)
                continue
            tokens, ids = [], []
            for row in rows:
                who = np.frombuffer(row["ids"], np.uint64)
                kind = np.uint16 if len(row["counts"]) == 2 * len(who) else np.uint32
                low = np.zeros((len(row["tokens"]) // width, 8), np.uint8)
                low[:, :width] = np.frombuffer(row["tokens"], np.uint8).reshape(-1, width)
                tokens.append(low.view(np.uint64).reshape(-1))
                ids.append(np.repeat(who, np.frombuffer(row["counts"], kind)))
            rows.clear()
            token, who = np.concatenate(tokens), np.concatenate(ids)
            del tokens, ids
            order = np.lexsort((who, token))
            token, who = token[order], who[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
            token, who = token[fresh], who[fresh]
            g = np.diff(_groups(token))
            times = np.repeat(g, g)
            shared = times > 1
            token, who, times = token[shared] | (np.uint64(part >> known) << low_bits if width < 8 else np.uint64(0)), who[shared], times[shared]
            order = np.argsort(who, kind="stable")
            cls, own = np.unique(who[order], return_inverse=True)
            out = [(side % parts, side, a, b, c, d) for side, a, b, c, d in by_side(cls, own, token[order], times[order], None)]
            if out:
                yield _rows(out)
        tidy()

    def gather(batches):
        for _, found in one_by_one(batches, "side"):
            rows = []
            for row in found:
                both = np.frombuffer(row["ids"], np.uint8)
                m = len(both) // 12
                rows.append((both[: 8 * m].view(np.uint64), both[8 * m :].view(np.uint32), None if row["sizes"] is None else np.frombuffer(row["sizes"], np.uint32), np.frombuffer(row["tokens"], np.uint64), np.frombuffer(row["counts"], np.uint32)))
            sized = [r for r in rows if r[2] is not None]
            cls, first = np.unique(np.concatenate([r[0] for r in sized]), return_index=True)
            n = np.concatenate([r[2] for r in sized])[first].astype(np.int64)
            who = np.searchsorted(cls, np.concatenate([np.repeat(r[0], r[1]) for r in rows]))
            token, times = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
            order = np.lexsort((token, times, who))
            who, token = who[order], token[order]
            fresh = np.ones(len(who), bool)
            fresh[1:] = (who[1:] != who[:-1]) | (token[1:] != token[:-1])
            who, token = who[fresh], token[fresh]
            shared = np.bincount(who, minlength=len(cls))
            heads = np.r_[0, np.cumsum(shared)]
            need = _prefix(n) - (n - shared)
            picked = np.flatnonzero((need > 0) & (shared > 0))
            for a in range(0, len(picked), 200):
                own = picked[a : a + 200]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[own].view(np.int64)), pa.array(n[own], pa.int64()), pa.array([np.sort(token[heads[i] : heads[i + 1]]).tobytes() for i in own.tolist()], pa.binary()), pa.array([token[heads[i] : heads[i] + need[i]].view(np.int64) for i in own.tolist()], pa.list_(pa.int64()))],
                    names=["cls", "n", "tokens", "prefix"],
                )

    def exchanged(rows: DataFrame, column: str, most: int) -> DataFrame:
        """Rows by part or side; where a task has many, they stand one after the other (sorted outside of Python's memory)."""
        there = rows.repartitionById(min(most, TASKS), F.col(column) % min(most, TASKS))
        return there if most <= TASKS else there.sortWithinPartitions(column)

    dealt = docs.select(key, text).mapInArrow(deal, _DEALT_SQL)
    counted = exchanged(dealt, "part", parts).mapInArrow(count, _DEALT_SQL)
    return exchanged(counted, "side", sides).mapInArrow(gather, "cls long, n long, tokens binary, prefix array<long>")


class Tree:
    """A signature tree over sets (sorted token arrays and full sizes)."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, order: np.ndarray, bits: int):
        self.sets, self.size = sets, sizes
        self.bitmap = np.zeros((len(sets), bits // 64), np.uint64)
        slack = np.zeros(len(sets), np.int64)
        for k, s in enumerate(sets):
            at = np.unique((mix(s) & np.uint64(bits - 1)).astype(np.int64))
            np.bitwise_or.at(self.bitmap[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            slack[k] = len(s) - len(at)
        self.slack = slack
        #: Levels from the leaves up: (bitmap, least size, largest size, slack, members or children).
        level = [self._node(order[a : a + LEAF]) + (order[a : a + LEAF],) for a in range(0, len(order), LEAF)]
        self.levels = [level]
        while len(level) > 1:
            level = [self._join(level[a : a + FANOUT]) + (np.arange(a, min(a + FANOUT, len(level))),) for a in range(0, len(level), FANOUT)]
            self.levels.append(level)

    def _node(self, own: np.ndarray) -> tuple:
        return np.bitwise_or.reduce(self.bitmap[own]), self.size[own].min(), self.size[own].max(), self.slack[own].max()

    @staticmethod
    def _join(nodes: list[tuple]) -> tuple:
        return np.bitwise_or.reduce([x[0] for x in nodes]), min(x[1] for x in nodes), max(x[2] for x in nodes), max(x[3] for x in nodes)


def _possible(a: tuple, b: tuple) -> bool:
    """Whether any two sets of both nodes can link."""
    if 4 * a[2] < 3 * b[1] or 4 * b[2] < 3 * a[1]:
        return False
    most = int(np.bitwise_count(a[0] & b[0]).sum()) + min(a[3], b[3])
    return OVERLAP * most >= SIZES * (a[1] + b[1])


def tree_components(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """The least index that each set is linked to, directly or not. With ``sides``, only links across sides count.

    Sets of one label are linked already.
    """
    n = len(sets)
    root = np.arange(n)
    if labels is not None:
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        root = first[inverse]
    if n < 2:
        return root
    bits = 1 << max(9, min(16, int(4 * np.median([len(s) for s in sets]) + 1).bit_length()))
    groups = [np.arange(n)] if sides is None else [np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)]
    if not all(len(g) for g in groups):
        return root
    least = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
    trees = [Tree(sets, sizes, g[np.lexsort((least[g], sizes[g]))], bits) for g in groups]
    a, b = trees[0], trees[-1]
    same = sides is None

    def link(x: np.ndarray, y: np.ndarray) -> None:
        pairs = 4 * np.minimum.outer(sizes[x], sizes[y]) >= 3 * np.maximum.outer(sizes[x], sizes[y])
        most = np.bitwise_count(a.bitmap[x][:, None, :] & a.bitmap[y][None, :, :] if same else a.bitmap[x][:, None, :] & b.bitmap[y][None, :, :]).sum(axis=2) + np.minimum.outer(a.slack[x], b.slack[y])
        pairs &= OVERLAP * most >= SIZES * np.add.outer(sizes[x], sizes[y])
        for i, j in zip(*np.nonzero(pairs)):
            p, q = x[i], y[j]
            r, t = root[p], root[q]
            if r == t:
                continue
            overlap = int(np.isin(sets[p], sets[q], assume_unique=True).sum())
            if OVERLAP * overlap >= SIZES * (sizes[p] + sizes[q]):
                root[root == max(r, t)] = min(r, t)

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, ia, lb, ib = stack.pop()
        x, y = a.levels[la][ia], b.levels[lb][ib]
        if not _possible(x, y):
            continue
        if la == 0 and lb == 0:
            if same and ia > ib:
                continue
            both = np.r_[root[x[4]], root[y[4]]]
            if (both != both[0]).any():
                link(x[4], y[4])
        elif la >= lb:
            stack += [(la - 1, k, lb, ib) for k in reversed(x[4].tolist())]
        else:
            stack += [(la, ia, lb - 1, k) for k in reversed(y[4].tolist())]
    return root


def _join_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) edges of each group's tree join: cls to the least linked cls. ``rows``: keys, cls, n, tokens[, side]."""
    sided = "side" in rows.columns

    def join(table: pa.Table) -> pa.Table:
        cls = table["cls"].to_numpy()
        order = np.argsort(cls, kind="stable")
        tokens = table["tokens"].to_pylist()
        sets = [np.frombuffer(tokens[k], np.uint64) for k in order.tolist()]
        root = tree_components(sets, table["n"].to_numpy()[order], *([table["side"].to_numpy()[order], table["label"].to_numpy()[order]] if sided else []))
        linked = root != np.arange(len(root))
        return pa.table({"a": pa.array(cls[order][linked]), "b": pa.array(cls[order][root[linked]])})

    return rows.select(*keys, "cls", "n", "tokens", *["side", "label"] * sided).groupBy(*keys).applyInArrow(join, "a long, b long")


def link_classes(found: DataFrame) -> DataFrame:
    """(node, component) of the classes that link to a lesser one, from the durable table of ``candidates``."""
    pairs = durable(found.select("cls", F.explode("prefix").alias("token")))
    least = pairs.groupBy("token").agg(F.min("cls").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = connected_components(pairs.join(least, "token").select(F.col("cls").alias("a"), "b").distinct())
    sized = grouped.groupBy("component").agg(F.count("*").alias("members"))
    rows = durable(found.drop("prefix").join(grouped, F.col("cls") == F.col("node")).drop("node").join(sized, "component").where("members > 1"))
    named = _join_groups(rows.where(F.col("members") <= BLOCK), ["component"]).select(F.col("a").alias("node"), F.col("b").alias("component"))
    large = rows.where(F.col("members") > BLOCK)
    return named.unionAll(_across_blocks(large, pairs)) if large.select("component").limit(1).count() else named


def _across_blocks(large: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same for groups of many blocks: (node, component) of all of their classes. ``prefixes``: (cls, token)."""
    blocks = F.ceil(F.col("members") / (BLOCK // 2))
    large = large.withColumn("block", F.pmod(F.xxhash64("cls"), blocks))
    inside = _join_groups(large, ["component", "block"]).select(F.col("a").alias("cls"), F.col("b").alias("label"))
    labelled = durable(large.join(inside, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    while True:  # the first of each label stands for it, until no two of them link
        stands = labelled.where("cls = label").drop("block")
        count = stands.groupBy("component").agg(F.count("*").alias("labels")).where("labels > 1")
        dealt = stands.join(count, "component").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.ceil(F.col("labels") / BLOCK)))
        more = durable(_join_groups(dealt, ["component", "block"]))
        if not more.limit(1).count():
            break
        renamed = labelled.join(more.select(F.col("a").alias("label"), F.col("b").alias("_to")), "label", "left")
        labelled = durable(renamed.withColumn("label", F.coalesce("_to", "label")).drop("_to"))
    main = labelled.groupBy("component", "label").agg(F.count("*").alias("held")).groupBy("component").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    judged = labelled.join(main, "component")
    # What is outside a group's main result meets the sets that share a shingle of its prefix. Shingles of the same sets are one.
    told = durable(prefixes.join(judged.select("component", "cls", (F.col("label") != F.col("main")).alias("rest")), "cls"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), F.col("cls"))) for k in (1, 2)]
    lists = told.groupBy("component", "token").agg(F.count("*").alias("sets"), F.count_if("rest").alias("few"), F.struct(*marks).alias("mark")).where("few > 0 and sets > 1")
    buckets = durable(lists.groupBy("component", "sets", "few", "mark").agg(F.min("token").alias("token")).select("component", "token", F.ceil(F.col("sets") / BLOCK).alias("blocks"), F.ceil(F.col("few") / BLOCK).alias("parts")))
    if not buckets.limit(1).count():
        return labelled.select(F.col("cls").alias("node"), F.col("label").alias("component"))
    members = told.join(buckets, ["component", "token"])
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block, part = F.pmod(F.xxhash64("cls"), F.col("blocks")), F.pmod(F.xxhash64("cls", F.lit(11)), F.col("parts"))
    own = members.select("component", "token", "cls", block.alias("block"), upto("parts").alias("part"), F.lit(0).alias("side"))
    cross = members.where("rest").select("component", "token", "cls", upto("blocks").alias("block"), part.alias("part"), F.lit(1).alias("side"))
    meeting = own.unionAll(cross).join(judged.select("cls", "n", "tokens", "label"), "cls")
    links = _join_groups(meeting, ["component", "token", "block", "part"])
    names = labelled.select("cls", "label")
    ends = links.join(names.withColumnsRenamed({"cls": "a", "label": "x"}), "a").join(names.withColumnsRenamed({"cls": "b", "label": "y"}), "b")
    joined = connected_components(ends.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    final = names.join(joined.select(F.col("node").alias("label"), F.col("component").alias("_to")), "label", "left")
    return final.select(F.col("cls").alias("node"), F.coalesce("_to", "label").alias("component"))


def linked_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, cls, root) of each row; equal ``root``: linked, directly or not; null: an empty set, or no key."""
    table = durable(shingle_sets(docs, key, text))
    sets = table.where("n_shingles is not null").select(key, "n_shingles", "cls")
    size = sets.agg(F.count("*"), F.sum("n_shingles")).first()
    often = table.where("token is not null").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= max(64, size[0] // (2 * HOT)))
    hot = np.array([r[0] for r in often.select("token").collect()], np.int64).view(np.uint64)  # at most 2 * HOT * mean set size
    found = durable(candidates(docs.where(F.col(key).isNotNull()), hot, size[1] or 0, key, text))
    linked = link_classes(found)
    named = sets.join(linked.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("root", F.when(F.col(key).isNotNull(), F.coalesce("component", "cls")))
    named = durable(named.select(key, "n_shingles", "cls", "root"))
    discard(found)
    discard(table)
    return named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): each row's set size and the least key that it is linked to, directly or not.

    Rows without a key have no name for a link to lead to: they link with nothing, and their component is null.
    """
    named = linked_sets(docs, key, text)
    least = durable(named.where("root is not null").groupBy("root").agg(F.min(key).alias("component_id")))  # written, so that the join can be split
    return named.join(least, "root", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component one row of the least key stays.

    A row is known by its key and its set, so that rows of one key and unlike texts are judged each, and of equal keys in a
    component the least set stands for it. Rows without a key or with an empty set are copies of nothing and stay.
    """
    named = linked_sets(docs, key, text).where("root is not null")
    first = durable(named.groupBy("root").agg(F.min(F.struct(F.col(key).alias("id"), F.col("cls").alias("of"))).alias("f")).select("f.*"))
    classed = with_classes(docs.where(F.col(key).isNotNull()), text)
    kept = classed.join(first, (F.col("cls") == F.col("of")) & (F.col(f"row.`{key}`") == F.col("id")))
    if named.groupBy(key, "cls").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # repeated rows: one of them
        kept = kept.groupBy("id", "of").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select("row.*").unionAll(classed.where("cls is null").select("row.*")).unionAll(docs.where(F.col(key).isNull()))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL: dict[str, str] = {}
