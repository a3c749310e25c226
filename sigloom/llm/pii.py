"""Personal data by anchor expansion.

One Aho-Corasick pass finds all anchors: at-signs, plus signs before a digit, schemes, dots between digits, digits that follow
each other at once or behind one separator, and identifier cues. A local parser expands each anchor to both sides and
validates what it finds: addresses of mail and network, phone numbers, payment cards (Luhn) and accounts (IBAN by its check
digits, or a number that follows a cue). An anchor inside what the one before was expanded to is passed over, so that each
parser looks at every character a bounded number of times, and long junk costs linear time.

Null and empty texts have no spans, and an empty table gives an empty result; repeated rows get the same spans each; other
columns stay as they are, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.spans import Span, Taken, base_digest, count_of, in_order, mark_spans, written

#: Base kinds as listed, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Cues of identifiers, in lower case.
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "kontonummer", "compte", "cuenta")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"']+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_AFTER_CUE = re.compile(r"[ \t]*(?:number|nummer|no\.?|nr\.?|num\.?)?[ \t]*[:#=]?[ \t]*([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){4,33})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban(value: str) -> bool:
    """Two letters, two check digits, and the remainder that ISO 13616 asks for."""
    v = re.sub("[ -]", "", value)
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    """(kind, length) of each anchor; one of each kind at most ends at a place."""
    found = ahocorasick.Automaton()
    digits = "0123456789"
    words = [("@", "at"), ("://", "scheme"), *((f"+{d}", "plus") for d in digits)]
    for a in digits:
        for b in digits:
            words += [(f"{a}.{b}", "dot"), *((f"{a}{sep}{b}", "pair") for sep in ("", " ", "-"))]
    for word, kind in [*words, *((c, "cue") for c in CUES), *((c.upper(), "cue") for c in CUES), *((c.title(), "cue") for c in CUES)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def mail_at(text: str, at: int, floor: int) -> Span | None:
    """The address around an at-sign, its name from ``floor`` on."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return ("email", start, m.end(), True) if m else None


def addresses_at(text: str, dot: int, out: list[Span]) -> int:
    """Adds the addresses of the row of dotted numbers around a dot, by fours from its start; gives the row's end."""
    start = dot
    while text[start - 1 : start] in _DIGITS:
        start -= 1
    m = _DOTTED.match(text, start)
    parts, at = m[0].split("."), start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in four):
            out.append(("ip", at, end, True))
        at = end + 1
    return m.end()


def finder(automaton: ahocorasick.Automaton | None = None):
    automaton = automaton or anchors()

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        mail_end = dots_end = card_end = phone_end = 0
        extra = []
        for at, (kind, size) in automaton.iter(text):
            start = at - size + 1
            if kind == "pair":
                if start >= card_end:
                    m = _CARD.match(text, start)  # the first pair of its row: no digit before it is near
                    card_end = m.end()
                    if card_end - start >= 12:
                        number = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(number) <= 19 and luhn(number):
                            out.append(("card", start, card_end, True))
            elif kind == "dot":
                if at >= dots_end:
                    dots_end = addresses_at(text, at - 1, out)
            elif kind == "plus":
                if start >= phone_end and (m := _PHONE.match(text, start)):
                    phone_end = m.end()
                    if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        out.append(("phone", start, phone_end, True))
            elif kind == "at":
                if found := mail_at(text, at, mail_end):
                    mail_end = found[2]
                    out.append(found)
            else:
                extra.append((kind, at))
        if extra:
            out += added(text, extra, out)
        return in_order(out, KINDS)

    return find


def added(text: str, cues: list[tuple[str, int]], base: list[Span]) -> list[Span]:
    """Addresses of the web that name a user, and accounts after a cue; nothing that overlaps a base span or an earlier one."""
    out: list[Span] = []
    last = 0
    for kind, at in cues:
        if kind == "scheme":
            start = at - 2
            while start > last and text[start - 1] in _SCHEME:
                start -= 1
            if start < at - 2 and at >= last and (m := _URL.match(text, at - 2)):
                last = m.end()
                host = re.split("[/?#]", m[0][3:], maxsplit=1)[0]
                if "@" in host:
                    out.append(("url", start, m.end(), False))
        elif m := _AFTER_CUE.match(text, at + 1):
            value = m[1]
            if iban(value) or not value[:2].isalpha() and 6 <= sum(c.isdigit() for c in value) <= 20:
                out.append(("account", m.start(1), m.end(1), False))
    taken = Taken(base)
    return [s for s in sorted(out, key=lambda s: (s[1], s[2])) if taken.add(s[1], s[2])]


def personal_data(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the spans of personal data of each text."""
    return mark_spans(df, None, text, out, setup=finder)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs).drop("text")
    return found.select("doc_id", *(count_of("spans", k).alias(f"n_{k}") for k in KINDS[:4]), base_digest("spans").alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
