"""Source divergence audit: which sources of a language write unlike each other, and by which terms they stand out.

A term is a run of letters of ASCII (A-Z as a-z) or of any characters beyond it. A language keeps the terms that at least
``LEAST`` of its documents hold. Each group (language and source) and each language gives a kept term the probability
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with N its occurrences of kept terms and V the language's kept terms; f is the
difference of two p. All arithmetic is on integers, a division by steps of 1,000 that fit a long up to 9 * 10^15 occurrences.

``term``: the terms of a group with the highest f against the language. The terms of a group lie in buckets of about equal
count; the highest p of a bucket less the lowest p that its terms have in the language bounds f for all of them. All groups
take their buckets best bound first, some more in each round, and a group stops once its next bound is strictly below the
last of its best ``TOP``.

``pair``: the sum of f over all kept terms for each two sources of a language. A term that neither holds adds the same to the
sum of a pair, so only postings (which sources hold a term, and how often) are summed: each posting against the others'
p of a term that they do not hold, and sources that hold a term together. Postings go to cells of two blocks of ``BLOCK`` sources
and a part of the terms; a task adds a batch's postings to a matrix of the cell's pairs and gives each pair once.

Null text, language and source count as empty. A group without kept terms, or of a language without any, has its pairs (0
without kept terms) and no terms. Repeated rows count again; texts are read whole; a table without rows gives an empty result;
other columns are not looked at. Ties are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import discard, durable, small_batches, tidy

#: Documents of a language that hold a kept term, at least; ranks of the terms.
LEAST, TOP = 30, 50
#: Terms and bytes of text after which a task gives what it has counted.
HELD_TERMS, HELD_BYTES = 1 << 18, 64 << 20
#: Sources of a block, and parts that the terms of a language are dealt out to.
BLOCK, PARTS = 256, 64
#: Buckets for each doubling of a count.
FINE = 4

#: Bytes of terms as they are counted, all others as spaces.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


def counted(df: DataFrame) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n, docs): a task's occurrences of a term and its documents, in one row or a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), count in n.items():
                words = list(count)
                for k in range(0, len(words), 1 << 14):
                    part = words[k : k + (1 << 14)]
                    columns = [pa.array([v] * len(part), pa.string()) for v in (lang, source)]
                    held = docs[lang, source]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(part, pa.binary()).cast(pa.string()), pa.array([count[w] for w in part], pa.int64()), pa.array([held[w] for w in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            n.clear()
            docs.clear()

        size = held_terms = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = terms(text.as_py())
                if words:
                    group = lang, source
                    if group not in n:
                        n[group], docs[group] = Counter(), Counter()
                    held_terms -= len(n[group])
                    n[group].update(words)
                    held_terms += len(n[group])
                    docs[group].update(set(words))
                    size += sum(map(len, words))
                    if size > HELD_BYTES or held_terms > HELD_TERMS:
                        size = held_terms = 0
                        yield from give()
        yield from give()
        tidy()

    small_batches(df.sparkSession)
    return df.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def p_of(count: str, n: str, v: str) -> str:
    """SQL of p; 10^9 times a fraction below one, by three steps of 1,000."""
    whole, rest, out = f"({n} + 5 * {v})", f"({count} + 5)", "0"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest} * 1000) div {whole})", f"(({rest} * 1000) % {whole})"
    return f"(1 + {out})"


class Audit:
    """Postings of kept terms (lang, source, term, n, total, bucket) and groups (lang, source, own, v, every, rare, place, blocks) of a table.

    ``total``: occurrences in the language; ``own``, ``every``: N of the group and of the language; ``v``: kept terms of the
    language; ``rare``: the group's p of a term that it does not hold; ``place``: the source's number in the language.
    """

    def __init__(self, df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST):
        named = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
        counts = counted(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")  # one row for each source
        every = counts.withColumns({"total": F.sum("n").over(term), "held": F.sum("docs").over(term), "first": F.min("source").over(term)})
        bucket = F.floor(F.log2("n") * FINE).cast("int")
        self.postings = durable(every.where(F.col("held") >= least).select("lang", "source", "term", "n", "total", bucket.alias("bucket"), (F.col("first") == F.col("source")).alias("first")))
        own = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if("first").alias("v"))
        groups = named.select("lang", "source").distinct().join(own, ["lang", "source"], "left").fillna(0, ["own", "v"])
        lang = Window.partitionBy("lang")
        groups = groups.select("lang", "source", "own", F.sum("v").over(lang).alias("v"), F.sum("own").over(lang).alias("every"), (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.count("*").over(lang).alias("sources"))
        rare = F.when(F.col("v") > 0, F.expr(p_of("0L", "own", "v"))).otherwise(0)
        self.groups = durable(groups.select("lang", "source", "own", "v", "every", rare.alias("rare"), "place", F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks")))

    def discard(self) -> None:
        discard(self.postings)
        discard(self.groups)

    def buckets(self) -> DataFrame:
        """(lang, source, bucket, bound, at, before): a group's buckets best bound first, with the terms of those before."""
        found = self.postings.groupBy("lang", "source", "bucket").agg(F.count("*").alias("terms"), F.max("n").alias("most"), F.min("total").alias("least"))
        bound = F.expr(f"{p_of('most', 'own', 'v')} - {p_of('least', 'every', 'v')}")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
        ranked = found.join(self.groups, ["lang", "source"]).withColumn("bound", bound).withColumn("at", F.row_number().over(order))
        return ranked.select("lang", "source", "bucket", "bound", "at", (F.sum("terms").over(order) - F.col("terms")).alias("before"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms with the highest f above 0."""
        buckets = durable(self.buckets())
        key = ["lang", "source"]
        value = F.expr(f"{p_of('n', 'own', 'v')} - {p_of('total', 'every', 'v')}").alias("value")
        order = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
        best = kth = None
        taken, room = self.groups.select(*key, F.lit(0).alias("taken"), F.lit(1).cast("long").alias("kth")), top
        while True:
            unseen = buckets.join(taken, key).where((F.col("at") > F.col("taken")) & (F.col("bound") >= F.col("kth")))
            ahead = F.col("before") - F.min("before").over(Window.partitionBy(*key))
            chosen = durable(unseen.withColumn("ahead", ahead).where(F.col("ahead") < room).select(*key, "bucket", "at"))
            if chosen.isEmpty():
                discard(chosen)
                discard(buckets)
                break
            more = self.postings.join(chosen, [*key, "bucket"]).join(self.groups, key).select(*key, F.col("term").alias("item"), value).where("value > 0")
            before, best = best, durable((more if best is None else more.unionAll(best)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*key, "item", "value"))
            kth = best.groupBy(*key).agg(F.when(F.count("*") == top, F.min("value")).alias("kth"))
            seen = chosen.groupBy(*key).agg(F.max("at").alias("now"))
            after = durable(
                taken.join(seen, key, "left").drop("kth").join(kth, key, "left").select(*key, F.coalesce("now", "taken").alias("taken"), F.coalesce("kth", F.lit(1)).cast("long").alias("kth"))
            )
            for old in (before, taken, chosen):
                if old is not None:
                    discard(old)
            taken, room = after, 4 * room
        if best is None:
            best = self.groups.where("false").select(*key, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"))
        return best.withColumn("rank", F.row_number().over(order))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of the language."""
        block, parts = F.floor(F.col("place") / BLOCK).cast("int"), F.greatest(F.lit(1), F.floor(F.lit(2 * PARTS) / (F.col("blocks") * (F.col("blocks") + 1))).cast("int"))
        spots = self.groups.withColumns({"block": block, "parts": parts, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
        low, high = F.least("block", "other"), F.greatest("block", "other")
        spot = (F.col("place") % BLOCK + F.when((F.col("block") == high) & (low != high), BLOCK).otherwise(0)).cast("int")
        spots = spots.select("lang", "source", "own", "v", "rare", "parts", low.alias("low"), high.alias("high"), spot.alias("spot"))
        part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
        cell = ["lang", "low", "high"]
        held = self.postings.join(spots, ["lang", "source"]).select(*cell, part.alias("part"), "term", "spot", F.expr(p_of("n", "own", "v")).alias("p"))
        heads = spots.select(*cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("term"), "spot", F.col("rare").alias("p"))
        rows = held.unionAll(heads).repartition(*cell, "part").sortWithinPartitions(*cell, "part", "term")  # what stands for a source without the term comes first
        small_batches(rows.sparkSession)
        found = rows.mapInArrow(_cells, "lang string, low int, high int, a int, b int, more long")
        left, right = F.col("low") * BLOCK + F.col("a"), F.when(F.col("low") == F.col("high"), F.col("low") * BLOCK + F.col("b")).otherwise(F.col("high") * BLOCK + F.col("b") - BLOCK)
        more = found.select("lang", left.alias("x"), right.alias("y"), "more").groupBy("lang", "x", "y").agg(F.sum("more").alias("more"))
        g, h = (self.groups.select("lang", *(F.col(c).alias(n + c) for c in ("source", "v", "rare", "place"))) for n in ("g_", "h_"))
        both = g.join(h, "lang").where("g_place != h_place").withColumns({"x": F.least("g_place", "h_place"), "y": F.greatest("g_place", "h_place")})  # the result's own rows
        value = F.col("g_v") * F.abs(F.col("g_rare") - F.col("h_rare")) + F.coalesce("more", F.lit(0))
        out = both.join(more, ["lang", "x", "y"], "left").select("lang", F.col("g_source").alias("source"), F.col("h_source").alias("item"), value.alias("value"))
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


class _Cell:
    """The pairs of one cell: p of terms that sources do not hold, and what each pair's postings add to the sum of those."""

    def __init__(self, key: tuple, width: int):
        self.key, self.rare = key, np.zeros(width, np.int64)
        self.single, self.both = np.zeros((width, width), np.int64), np.zeros((width, width), np.int64)

    def add(self, run: np.ndarray, spot: np.ndarray, p: np.ndarray) -> None:
        """Postings by ascending number of their terms, those of one term whole."""
        rare = self.rare
        np.add.at(self.single, spot, np.abs(p[:, None] - rare) - np.abs(rare[spot][:, None] - rare))
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        size = np.diff(np.r_[heads, len(run)])
        of = np.repeat(np.arange(len(heads)), size)  # the term of each posting
        left = np.repeat(np.arange(len(run)), size[of])
        right = np.arange(len(left)) - np.repeat(np.cumsum(size[of]) - size[of], size[of]) + heads[of[left]]
        a, b = spot[left], spot[right]
        x, y = p[left], p[right]
        np.add.at(self.both, (a, b), np.abs(x - y) - np.abs(x - rare[b]) - np.abs(rare[a] - y) + np.abs(rare[a] - rare[b]))

    def rows(self) -> pa.RecordBatch | None:
        """(cell, a, b, sum) of the pairs that some posting adds to."""
        lang, low, high, _ = self.key
        total = self.single + self.single.T + self.both
        there = self.rare > 0  # the block's sources
        a, b = np.nonzero(np.triu(total, 1) * np.outer(there, there))
        if low != high:
            cross = (a < BLOCK) & (b >= BLOCK)
            a, b = a[cross], b[cross]
        if not len(a):
            return None
        columns = [pa.array([lang] * len(a), pa.string()), *(pa.array(np.full(len(a), v, np.int32)) for v in (low, high)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "low", "high", "a", "b", "more"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in the order of cells, parts and terms -> sums of pairs. Holds one cell's matrices and the postings of a batch and a term."""
    cell: _Cell | None = None
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(rest.columns, batch.columns)], names=batch.schema.names)
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)  # where another cell, part or term begins
        new[0] = True
        other = np.zeros(n, bool)  # where another cell or part begins
        other[0] = True
        for k in range(5):
            column = batch.column(k)
            differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            if k == 4:
                null = column.is_null().to_numpy(zero_copy_only=False)
                differs = differs | (null[1:] != null[:-1])
            new[1:] |= differs
            if k < 4:
                other[1:] |= differs
        end = int(np.flatnonzero(new)[-1])  # the last term may go on in the next batch
        rest = batch.slice(end)
        if end:
            done, cell = _taken(batch.slice(0, end), new[:end], other[:end], cell)
            yield from done
    if rest is not None and rest.num_rows:
        first = np.zeros(rest.num_rows, bool)
        first[0] = True
        done, cell = _taken(rest, first, first, cell)
        yield from done
    if cell is not None and (last := cell.rows()) is not None:
        yield last
    tidy()


def _taken(batch: pa.RecordBatch, new: np.ndarray, other: np.ndarray, cell: _Cell | None) -> tuple[list[pa.RecordBatch], _Cell]:
    """Adds whole terms to their cells; what cells that are over give, and the one that is not."""
    out: list[pa.RecordBatch] = []
    term, spot, p = np.cumsum(new), batch.column(5).to_numpy(), batch.column(6).to_numpy()
    head = batch.column(4).is_null().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(other)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(term)]):
        key = tuple(batch.column(k)[s].as_py() for k in range(4))
        if cell is None or cell.key != key:
            if cell is not None and (rows := cell.rows()) is not None:
                out.append(rows)
            cell = _Cell(key, BLOCK if key[1] == key[2] else 2 * BLOCK)
        own = np.arange(s, e)
        cell.rare[spot[own[head[own]]]] = p[own[head[own]]]
        own = own[~head[own]]
        if len(own):
            cell.add(term[own], spot[own], p[own])
    return out, cell


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = Audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    out = durable(columns(audit.pairs(), "pair").unionAll(columns(audit.terms(), "term")))
    audit.discard()
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(total) AS every FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(own, 0) AS own, coalesce(v, 0) AS v, every FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (own + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (every + 5 * v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op11_divergence": op11_divergence}
ORACLE_SQL = {"op11_divergence": _SQL}
