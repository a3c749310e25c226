"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a row of tokens. A word scores between -1 and 1 by what it stands in: the elements around it, or their
classes and ids, whether it is a link, and whether it stands in the page's article or beside it. A tag scores below
zero, by how seldom it stands in articles. All weights come from labelled pages, those with an ``article`` or ``main``
element, whose words and tags count as content or not. One linear scan finds the contiguous region of the highest score,
and that alone decides where the text begins and ends, with or without an article.

What is left out of a region is what HTML itself sets apart (menus, headers, footers, sidebars, forms, scripts, styles, by
element, role or hidden) and elements whose class or id names nothing but what is no main text, a notice, an advert, reader
comments (the words are given here) or what the labelled pages show beside articles only. These score nothing, so that they
break no region.

The text is cut at block elements, references are decoded, white space becomes one space, and blocks are joined in page
order. A form around a whole page (an article, a main element or an ``h1``) is none of those left out. Weights are fitted on at most ``SAMPLE_PAGES`` pages of ``SAMPLE_BYTES`` at most (those whose keys hash lowest). Null
or empty html gives an empty text, and so do pages without a region of positive score. Repeated rows give equal texts; very
long pages take linear time; an empty table gives an empty result; other columns stay as they are, but for one of the
result's name, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import map_arrow, with_fields

#: Pages that weights are fitted on at most, and the longest of them in bytes.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 1 << 16
#: The most that one sign tells, as log odds.
LIMIT = 3.0

#: Elements whose content is no markup or no text; ``svg`` may close itself and is a plain tag then.
_RAW = "script|style|textarea|title|noscript|template|iframe|svg|select|canvas|object"
_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?!svg(?=[\s/]){_ATTRIBUTES}/>)({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|</?[a-zA-Z!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_LEFT_OUT = frozenset(_RAW.split("|"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms mtext mspace msub msup msubsup mfrac msqrt mroot mover munder semantics".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu fieldset label input datalist audio video figure-menu annotation annotation-xml".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that articles may have, however few the labelled pages show: no evidence against words in them, little against their tags.
_TEXTUAL = frozenset("article main section div p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr img picture source address details summary header span math html body".split())
#: Parts of a class or id that name what is no main text, and parts that only name its form.
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies pagination pager toolbar skip masthead topbar".split()
)
_FORMS = frozenset("post posts article articles page site main link links box bar block blocks wrapper wrap container section list item items area inner outer body content top bottom left right small large unit slot button buttons media icons icon form list message text js the my".split())
_PLACES = frozenset("article main body html".split())
#: One attribute: its whole name and what it is set to, quoted or not, so that no value is read for names.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?|\"[^\"]*\"|'[^']*'")
#: What a form may be around; a form around none of these is left out.
_PAGE = re.compile(r"<(?:(article|main|h1)(?=[\s/>])|/form(?=[\s/>]))", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def attributes_of(said: str) -> list[tuple[str, str]]:
    """Names (in lower case) and values of a tag's attributes in their order."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(said) if m[1]]


def names_of(attributes: list[tuple[str, str]]) -> list[str]:
    """The names in class and id."""
    return [part for name, value in attributes if name in ("class", "id") for part in value.split()]


def set_apart(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether HTML says that an element is no main text; ``inside``: it stands in an article, which may have a header.

    ``aria-hidden`` says nothing: it hides from screen readers what others see.
    """
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    for name, value in attributes:
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
        if name == "role" and tag not in _PLACES and value.lower() in _ROLES:
            return True
    return False


def around_page(html: str) -> set[int]:
    """Where those forms end their opening tags that are around an article, a main element or the page's title."""
    if not re.search("<form", html, re.I):
        return set()
    marks = [(m.start(), bool(m[1])) for m in _PAGE.finditer(html)]
    at, out = 0, set()
    for m in re.finditer(rf"<form(?=[\s/>]){_ATTRIBUTES}>", html, re.I):
        while at < len(marks) and marks[at][0] < m.end():
            at += 1
        if at < len(marks) and marks[at][1]:
            out.add(m.end())
    return out


def holder_of(html: str) -> str:
    """What holds a page's text: ``article``, or ``main`` where no article is opened, or nothing."""
    if not re.search("<(?:article|main)", html, re.I):
        return ""
    opened = {m[3].lower() for m in _TOKEN.finditer(html) if m[3] and not m[2] and not m[4].endswith("/")}
    return "article" if "article" in opened else "main" if "main" in opened else ""


class Weights:
    """Evidence (log odds of content) of what words stand in, and scores of tags; what was never seen says nothing."""

    def __init__(self, pages: list[str]):
        self.place: dict[str, float] = {}
        self.tag: dict[str, float] = {}
        words: dict[bool, Counter] = {True: Counter(), False: Counter()}
        tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for html in pages:
            if holder_of(html):
                for kind, value, features, inside, said in tokens(html, self):
                    if kind == "tag" or kind == "skip" and not inside:
                        tags[inside][value] += 1
                    elif value.strip() and (kind == "text" or kind == "drop" and not inside):
                        # beside articles, the outermost element explains its words, and a link is one anywhere
                        told = features if inside else [*features[: said + 1], *[f for f in features if f == "a"]]
                        for f in set(told):
                            words[inside][f] += len(value.split())
        for f in words[True] | words[False]:
            odds = math.log((words[True][f] + 0.5) / (words[False][f] + 0.5))
            self.place[f] = min(max(odds, 0.0 if f in _TEXTUAL else -LIMIT), LIMIT)
        self.place |= {"in": LIMIT + 2, "beside": -LIMIT - 2}  # what labels say is beyond doubt
        for f in tags[True] | tags[False]:
            self.tag[f] = -0.05 - 2 * (tags[False][f] + 1) / (tags[True][f] + tags[False][f] + 2)
        for f in _TEXTUAL | _INLINE:
            self.tag[f] = max(self.tag.get(f, -0.1), -0.1)

    def left_out(self, tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
        """Whether an element and all in it is no main text."""
        if set_apart(tag, attributes, inside):
            return True
        if not attributes or tag in _PLACES and tag != "article":
            return False
        for name in names_of(attributes):
            parts = {p.lower() for p in _NAMES.findall(name)} - _FORMS
            if parts and all(p in _CUES or p == "header" and not inside and tag[:1] != "h" for p in parts) or self.place.get("." + name.lower(), 0.0) <= -LIMIT:
                return True
        return False

    def word(self, features: list[str]) -> float:
        """-1 to 1: the strongest evidence for and against, in favour where there is none."""
        told = [self.place.get(f, 0.0) for f in features] or [0.0]
        return math.tanh(1 + max(0.0, *told) + min(0.0, *told))


def tokens(html: str, weights: Weights) -> list[tuple[str, str, list[str], bool, int]]:
    """(kind, value, features, inside, last feature of the outermost element) of each token.

    Kinds: ``tag``; ``skip``, a tag of what is left out; ``text``; ``drop``, a text that is left out. Features: names of the
    elements around a text, or ``.name`` of their classes and ids, ``a`` in a link, ``in`` or ``beside`` the page's article.
    """
    holder, whole = holder_of(html), around_page(html)
    stack: list[tuple[str, bool, int]] = []  # (tag, left out, features that it added)
    features: list[str] = []
    held: Counter = Counter()
    dropped = holders = said = 0
    out: list[tuple[str, str, list[str], bool, int]] = []
    for m in _TOKEN.finditer(html):
        inside = holders > 0
        if m[5] is not None:
            place = [("in" if inside else "beside")] if holder else []
            out.append(("drop" if dropped else "text", m[5], [*features, *place], inside, said))
            continue
        if m[3] is None:
            if m[1]:
                out.append(("skip", m[1].lower(), [], inside, 0))
            continue
        tag = m[3].lower()
        opens = not m[2] and tag not in _VOID and not m[4].endswith("/")
        attributes = attributes_of(m[4]) if opens and m[4] else []
        drop = opens and not (tag == "form" and m.end() in whole) and weights.left_out(tag, attributes, inside)
        out.append(("skip" if dropped or drop else "tag", tag, [], inside, 0))
        if m[2]:
            while held[tag]:  # everything that was opened since is closed too
                name, was_left_out, own = stack.pop()
                held[name] -= 1
                dropped -= was_left_out
                holders -= name == holder
                del features[len(features) - own :]
                if name == tag:
                    break
        elif opens:
            named = sorted({"." + n.lower() for n in names_of(attributes)}) if tag not in _PLACES else []
            own = named or [tag] if tag not in ("html", "body") else []
            if not features:
                said = len(own) - 1
            features += own
            stack.append((tag, drop, len(own)))
            held[tag] += 1
            dropped += drop
            holders += tag == holder
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum, the first and longest of equals; empty where none is positive."""
    best, at = 0.0, (0, 0)
    now, start = 0.0, 0
    for k, s in enumerate(scores):
        if now < 0:
            now, start = 0.0, k
        now += s
        if now > best:
            best, at = now, (start, k + 1)
    return at


def scores(row: list[tuple], weights: Weights) -> list[float]:
    """The score of each token."""
    return [weights.tag.get(value, -0.3) if kind == "tag" else len(value.split()) * weights.word(features) if kind == "text" else 0.0 for kind, value, features, _, _ in row]


def main_text(html: str, weights: Weights) -> str:
    row = tokens(html, weights)
    start, end = region(scores(row, weights))
    blocks, block = [], []
    for kind, value, *_ in row[start:end]:
        if kind == "text":
            block.append(value)
        elif kind in ("tag", "skip") and value not in _INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(w for b in blocks for w in unescape(b).split())


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> Weights:
    """Weights of a bounded sample of labelled pages."""
    labelled = pages.where(F.lower(html).rlike("<(article|main)") & (F.octet_length(html) <= SAMPLE_BYTES))
    picked = labelled.select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE_PAGES).distinct()
    return Weights([r[0] for r in labelled.join(F.broadcast(picked), key).orderBy(F.xxhash64(key), key).select(html).limit(SAMPLE_PAGES).collect()])


def extract(pages: DataFrame, weights: Weights, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out`` string (replaced if there): each page's main text."""
    keep = [f for f in pages.schema if f.name != out]

    def kernel(batch: pa.RecordBatch):
        texts = [main_text(h, weights) if h else "" for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return map_arrow(pages.select(*(f"`{f.name}`" for f in keep)), kernel, with_fields(keep, f"`{out}` string"), html)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html": op9_html}
ORACLE_SQL: dict[str, str] = {}
