"""Secret scan: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax around each ``=``, ``:``, ``:=`` and ``=>``: the target's name to the
left; to the right a sum of literals and names, quoted once or three times or bare, or the lines of a YAML block. Names that
were bound to a literal before are constants and hand their literal on, by name (``k = "..."; password = k``), in a sum, or in a
literal (``"$k"``, ``${k}``, f-strings). Where an assignment gives a name and the next one its value (``key="token" value="..."``), that name
is the target. A literal is scored by how sensitive its target's name is and by how random it looks; what reaches ``LEAST_SCORE`` is a
span of kind ``literal``, one for each part that stands in the text. Constants of more than ``MOST_PARTS`` parts or ``MOST_VALUE``
characters are not handed on, so that a name that is bound to itself again and again costs linear time.

Null and empty texts have no spans, and an empty table gives an empty result; very long texts take time in proportion. Repeated rows get
the same spans each; other columns stay as they are, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow
from sigloom.llm.spans import Span, Taken, base_digest, count_of, in_order, mark_spans, written

#: Base kinds as listed, then that which the method adds.
KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 1.0
#: How much a part of a target's name tells that its value is secret.
SENSITIVE = {"password": 0.8, "passwd": 0.8, "passphrase": 0.8, "pwd": 0.7, "pass": 0.6, "secret": 0.8, "token": 0.7, "credential": 0.7, "credentials": 0.7, "apikey": 0.8, "auth": 0.5, "bearer": 0.6, "private": 0.4, "key": 0.4, "api": 0.2, "access": 0.3, "client": 0.1, "signature": 0.4, "salt": 0.4, "cookie": 0.3, "session": 0.3}
#: Values that stand for no secret.
PLACEHOLDERS = ("example", "changeme", "change_me", "placeholder", "your", "xxxx", "dummy", "redacted", "undefined", "localhost", "insert")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_OPERATOR = re.compile(r":=|=>|[=:]")
_LITERAL = re.compile(r"""[ \t]*[bBrRuUfF]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
_PLUS = re.compile(r"[ \t]*[+][ \t]*(?=[\"'`A-Za-z_$])")
_TRIPLE = re.compile(r"""[ \t]*[bBrRuUfF]{0,2}(\"{3}|'{3})""")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_INSERTED = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?")
_FORMATTED = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")
#: Names whose value is the name of a value, and those of that value.
NAMING, VALUING = frozenset("name key id property field attribute".split()), frozenset("value val content default".split())
#: What a constant may be made of to be handed on.
MOST_PARTS, MOST_VALUE = 16, 4096
_BARE = re.compile(r"""[ \t]*([^\s"'`,;&(){}\[\]<>#]+)""")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")


def name_score(name: str) -> float:
    """1 at most: the sum of what the parts of the name (camelCase, snake_case, dotted) tell."""
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in _PARTS.findall(name)))


def literal_score(value: str) -> float:
    """0 for short, spaced or placeholder values; else by entropy of characters and mixture of classes."""
    n = len(value)
    low = value.lower()
    if n < 8 or any(c.isspace() for c in value) or value[:1] in "$<%{" or any(p in low for p in PLACEHOLDERS):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * entropy + 0.12 * classes)


class Lexer:
    """Reads what stands to the right of an operator."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, tuple[list[tuple[int, int]], str]] = {}
        self.closed = {'"' * 3: True, "'" * 3: True}  # whether another end of such a literal may follow

    def filled(self, start: int, end: int, names: re.Pattern) -> tuple[list[tuple[int, int]], str]:
        """A literal with the constants that it names put in; what it adds itself, and they, are parts."""
        parts, value, at = [], [], start
        for m in names.finditer(self.text, start, end):
            if m[1] in self.known:
                held, said = self.known[m[1]]
                parts += ([(at, m.start())] if m.start() > at else []) + held
                value += [self.text[at : m.start()], said]
                at = m.end()
        if at < end:
            parts.append((at, end))
            value.append(self.text[at:end])
        return parts, "".join(value)

    def term(self, at: int) -> tuple[list[tuple[int, int]], str, int] | None:
        """(parts, value, end) of a literal or constant; None where neither stands."""
        text = self.text
        if (m := _TRIPLE.match(text, at)) and self.closed[m[1]]:
            end = text.find(m[1], m.end())
            if end < 0:
                self.closed[m[1]] = False
            else:
                inner = text[m.end() : end]
                start = m.end() + len(inner) - len(inner.lstrip())
                return [(start, start + len(inner.strip()))], inner.strip(), end + 3
        if m := _LITERAL.match(text, at):
            start, end = m.span(m.lastindex)
            formatted = "f" in text[at:start].lower() and m.lastindex < 3
            if m.lastindex != 2 or formatted:
                return *self.filled(start, end, _FORMATTED if formatted else _INSERTED), m.end()
            return [(start, end)], text[start:end], m.end()
        if (m := _NAME.match(text, at + len(text[at : at + 8]) - len(text[at : at + 8].lstrip(" \t")))) and (word := m[0].rstrip(".-").removeprefix("$")) in self.known and text[m.end() : m.end() + 1] != "(":
            return *self.known[word], m.end()
        return None

    def block(self, at: int, key: int) -> tuple[list[tuple[int, int]], str, int] | None:
        """The lines of a YAML block, which stand deeper than the line of their key."""
        text = self.text
        if not (m := _BLOCK.match(text, at)):
            return None
        line = text.rfind("\n", 0, key) + 1
        depth = len(text[line:key]) - len(text[line:key].lstrip(" -"))
        parts, end = [], m.end()
        while end < len(text):
            row = _LINE.match(text, end)
            if len(row[1]) <= depth or not row[2]:
                break
            parts.append((row.start(2), row.start(2) + len(row[2].rstrip())))
            end = row.end()
        return (parts, "".join(text[s:e] for s, e in parts), end) if parts else None

    def value(self, at: int, key: int, operator: str) -> tuple[list[tuple[int, int]], str, int]:
        """(parts, value, end) of what is assigned; no parts where it is no literal."""
        if operator == ":" and (found := self.block(at, key)):
            return found
        parts, value, end = [], "", at
        while found := self.term(end):
            parts, value, end = parts + found[0], value + found[1], found[2]
            if not (plus := _PLUS.match(self.text, end)) or len(parts) > MOST_PARTS:
                break
            end = plus.end()
        if not parts and (m := _BARE.match(self.text, at)):
            end = m.end()
            word = m[1].rstrip(".:")
            if word[:1] == "$" and (inner := _INSERTED.match(self.text, m.start(1))):
                # a name in braces ends where the bare word does
                if inner[1] in self.known:
                    return *self.known[inner[1]], max(end, inner.end())
            elif not _NAME.fullmatch(word) or any(c.isdigit() for c in word):
                parts, value = self.filled(m.start(1), m.start(1) + len(word), _INSERTED)
        return parts, value, end


def assignments(text: str):
    """(name, [(start, end)] of the literal's parts, value) of each assignment that binds a literal, constants resolved."""
    lexer = Lexer(text)
    floor, naming = 0, ("", -1)
    for op in _OPERATOR.finditer(text):
        a, b = op.span()
        if a < floor or text[b : b + 1] in ("=", ":", "~") or text[a - 1 : a] in ("=", "!", "<", ">", ":") or text.startswith("//", b):
            continue
        end = a
        while end > floor and text[end - 1] in " \t":
            end -= 1
        if end > floor and text[end - 1] in "\"'`]":
            end -= 1
            if end > floor and text[end - 1] in "\"'`":
                end -= 1
        start = end
        while start > floor and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:end].strip("-.")
        if not name or name[0].isdigit():
            continue
        parts, value, at = lexer.value(b, start, op[0])
        if parts:
            if name.lower() in VALUING and 0 <= naming[1] <= start and start - naming[1] < 64 and not text[naming[1] : start].strip(" \t\r\n,\"'"):
                name = naming[0]
            if name.lower() in NAMING and len(value) <= 64:
                naming = value, at
            if len(parts) <= MOST_PARTS and len(value) <= MOST_VALUE:
                lexer.known[name] = parts, value
            yield name, parts, value
            floor = at  # what was read as a literal is not read again
        else:
            lexer.known.pop(name, None)  # bound to something else


def find(text: str) -> list[Span]:
    out: list[Span] = []
    pairs = "=" in text or ":" in text
    if pairs:
        out += [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    if pairs:
        taken = Taken(out)
        for name, parts, value in assignments(text):
            if (told := name_score(name)) and (random := literal_score(value)) and told + random >= LEAST_SCORE:
                for s, e in parts:
                    if s < e and taken.add(s, e):
                        out.append(("literal", s, e, False))
    return in_order(out, KINDS)


def secrets(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the spans of secrets of each text."""
    return mark_spans(df, find, text, out)


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret of each text replaced by ``mark``; overlapping spans are replaced as one."""
    def clean(value: str | None) -> str | None:
        if not value or not (spans := find(value)):
            return value
        out, at = [], 0
        for _, start, end, _ in spans:
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join(out) + value[at:]

    def kernel(batch: pa.RecordBatch):
        k = batch.schema.get_field_index(text)
        yield batch.set_column(k, text, pa.array(map(clean, batch.column(k).to_pylist()), pa.string()))

    return map_arrow(df, kernel, df.schema, text)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets(docs).drop("text")
    return found.select("doc_id", *(count_of("spans", k).alias(f"n_{k}") for k in KINDS[:3]), base_digest("spans").alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}
