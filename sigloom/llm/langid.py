"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton. A document is parsed greedily into
the longest phrases that occur in the language's sample; the number of phrases times the bits that a pointer into the
sample takes, per letter, estimates the cross-entropy. The language with the least wins (ties: the name that sorts
first). All letters of the samples are told apart; letters beyond them are phrases of their own.

Texts are parsed whole. A task steps through thousands of pieces at once, every step moving all of them one letter on: long
texts are cut into pieces of ``PIECE`` letters, and where the phrase that runs across a piece's start ends elsewhere than was
taken for granted, the piece is parsed anew from there, until all phrases meet. The result does not depend on ``PIECE``.

Null texts, and texts without any letter, are ``und`` with score 0. Without labelled rows every text is ``und``. Rows
and repeats are judged by their text alone; other columns stay as they are.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow, Sent, text_bytes, with_fields

#: Letters of labelled text that make up a language's automaton, and the rows that they are taken from; these bound
#: the model, whatever the size of the corpus.
SAMPLE_LETTERS, SAMPLE_ROWS = 20_000, 64
#: Letters that are stepped through in one piece.
PIECE = 1024
UNKNOWN = "und"


def _lower() -> np.ndarray:
    """The first code point of each letter in lower case, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            out[code] = ord(c.lower()[0])
    return out


class Alphabet:
    """Classes of code points: 0 for what is no letter, 1 for letters outside the samples, then letters in lower case."""

    def __init__(self, letters: list[int]):
        self.size = len(letters) + 2
        known = np.ones(sys.maxunicode + 1, np.min_scalar_type(self.size))
        known[letters] = np.arange(2, self.size)
        known[0] = 0
        self.table = known[_lower()]

    def read(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts of a column with runs of no letters as one, and where each text starts."""
        raw, offsets = text_bytes(array)
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
        out = self.table[codes]
        keep = out > 0
        keep[1:] |= out[:-1] > 0
        keep[at[:-1][at[:-1] < len(out)]] = True
        return out[keep], np.r_[0, np.cumsum(keep)][at]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Steps by letter of each state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automata:
    """Several automata in one table of cells; a state is the place that its letters' cells are counted from.

    The cell at state + letter holds its owner and the next state; where another state owns it, no phrase goes on there.
    """

    def __init__(self, automata: list[list[dict[int, int]]], letters: int):
        self.letters = letters
        owner, target = [], []
        self.roots = np.zeros(len(automata), np.int64)
        self.first = np.zeros((len(automata), letters), np.int64)
        used, places, low = set(), set(), 0
        for k, steps in enumerate(automata):
            place, free = [0] * len(steps), low
            for s in sorted(range(len(steps)), key=lambda s: -len(steps[s]) if s else 0):
                own = list(steps[s]) if s else []  # from the root, every letter begins a phrase
                if len(own) > 1:
                    at = low
                    while at in places or any(at + c in used for c in own):
                        at += 1
                    low = max(low, at - 64)
                else:  # the next free cell
                    at = free
                    while at in places or at < 0 or own and at + own[0] in used:
                        free += 1
                        at = free - own[0] if own else free
                place[s] = at
                places.add(at)
                used.update(at + c for c in own)
            low = max(low, free)
            for s in range(1, len(steps)):
                for c, q in steps[s].items():
                    owner.append((place[s] + c, place[s]))
                    target.append(place[q])
            self.roots[k] = place[0]
            self.first[k] = place[0]
            for c, q in steps[0].items():
                self.first[k, c] = place[q]
        self.cells = np.full((max(places, default=0) + letters + 1, 2), -1, np.int32)
        if owner:
            at, own = np.array(owner).T
            self.cells[at, 0], self.cells[at, 1] = target, own
        self.cells = self.cells.view(np.int64).reshape(-1)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where no phrase goes on."""
        found = self.cells[state + letter].view(np.int32).reshape(-1, 2)
        return found[:, 0], np.flatnonzero(found[:, 1] != state)

    def parse(self, classes: np.ndarray, which: np.ndarray, start: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in start..stop, and where the first after these begins, for the automaton ``which`` of each piece."""
        width = stop - start
        order = np.argsort(-width, kind="stable")
        width, which, start = width[order], which[order], start[order]
        state = self.roots[which]
        phrases = np.zeros(len(order), np.int64)
        first = self.first.reshape(-1)
        offset = which * self.letters
        active = np.searchsorted(-width, -np.arange(max(0, width[0]) if len(width) else 0), side="left")
        for t, m in enumerate(active.tolist()):
            letter = classes[start[:m] + t]
            following, new = self.step(state[:m], letter)
            state[:m] = following
            state[new] = first[offset[new] + letter[new]]
            phrases[new] += 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        phrases, state = phrases[back], state[back]
        now = np.maximum(stop, start[back])
        on = np.flatnonzero((now == stop) & (stop < end) & (width[back] > 0))
        while len(on):
            following, new = self.step(state[on], classes[now[on]])
            going = np.ones(len(on), bool)
            going[new] = False
            on = on[going]
            state[on] = following[going]
            now[on] += 1
            on = on[now[on] < end[on]]
        return phrases, now


class Model:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, list[str]]):
        joined = {name: "\n".join(texts[name]) for name in sorted(texts)}
        seen = np.unique(np.concatenate([_lower()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")] for t in joined.values()] or [np.zeros(0, np.int32)]))
        self.alphabet = Alphabet(seen[seen > 0].tolist())
        samples = {}
        for name, text in joined.items():
            classes = self.alphabet.read(pa.array([text], pa.string()))[0].tolist()[:SAMPLE_LETTERS]
            if any(classes):
                samples[name] = classes
        self.names = list(samples)
        self.bits = np.log2([max(2, len(s)) for s in samples.values()])
        self.automata = Automata([suffix_automaton(s) for s in samples.values()], self.alphabet.size)

    def phrases(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each whole text under each language, its letters, and whether there is one."""
        classes, at = self.alphabet.read(array)
        classes = classes.astype(np.int64)
        n, k = len(array), len(self.names)
        size = np.diff(at)
        lettered = np.zeros(n, bool)
        row = np.repeat(np.arange(n), size)
        lettered[row[classes > 0]] = True
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        start = at[:-1][owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop, end = np.minimum(start + PIECE, at[1:][owner]), at[1:][owner]
        count = np.zeros((len(owner), k), np.int64)
        begin = np.repeat(start[:, None], k, axis=1)
        after = begin.copy()
        piece, which = np.indices((len(owner), k)).reshape(2, -1)
        while len(piece):
            count[piece, which], after[piece, which] = self.automata.parse(classes, which, begin[piece, which], stop[piece], end[piece])
            later = piece + 1
            some = (stop[piece] < end[piece]) & (begin[np.minimum(later, len(owner) - 1), which] != after[piece, which])
            begin[later[some], which[some]] = after[piece[some], which[some]]
            piece, which = later[some], which[some]
        total = np.zeros((n, k))
        np.add.at(total, owner, count)
        return total, size, lettered

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, how far ahead of the second it is (0 to 1), and its bits a letter but for the last phrase, which the text's end cuts off."""
        if not self.names:
            return [UNKNOWN] * len(array), np.zeros(len(array)), np.zeros(len(array))
        total, size, lettered = self.phrases(array)
        cost = total * self.bits / np.maximum(size, 1)[:, None]
        best = cost.argmin(axis=1)
        every = np.arange(len(cost))
        least = cost[every, best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.names) > 1 else least
        score = np.where(lettered, 1 - least / np.where(second > 0, second, 1), 0.0)
        bits = np.where(lettered, np.maximum(total[every, best] - 1, 0) * self.bits[best] / np.maximum(size, 1), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], np.clip(score, 0, 1), bits


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``rows`` rows of each language, those whose keys hash lowest."""
    named = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(key), key))
    picked = named.select(key, lang).withColumn("_n", rank).where(F.col("_n") <= rows).select(key, lang)
    chosen = named.select(key, lang, text).join(F.broadcast(picked.distinct()), [key, lang])  # at most rows x languages
    texts: dict[str, list[str]] = {}
    for r in chosen.groupBy(key, lang).agg(F.min(text).alias(text)).orderBy(F.xxhash64(key), key, lang).collect():
        texts.setdefault(r[lang], []).append(r[text])
    return Model(texts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` string, ``score`` double and ``bits`` double, those a letter of whole phrases (replaced if there)."""
    keep = [f for f in df.schema if f.name not in ("lang_pred", "score", "bits")]
    sent = Sent(df.sparkSession, model)  # bounded by the sample

    def kernel(batch: pa.RecordBatch):
        names, score, bits = sent.value.predict(batch.column(batch.schema.get_field_index(text)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "bits"])

    return map_arrow(df.select(*(f"`{f.name}`" for f in keep)), kernel, with_fields(keep, "lang_pred string, score double, bits double"), text)


def in_a_language(identified: DataFrame, letters: int, text: str = "text") -> DataFrame:
    """Rows of an identified table whose text is in a learned language.

    Out go texts without letters, and texts that the best language's whole phrases describe no better than guessing each of
    its ``letters`` would.
    """
    return identified.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits") < math.log2(max(2, letters))))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_langid": op2_langid}
ORACLE_SQL: dict[str, str] = {}
