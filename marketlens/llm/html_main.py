"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by the element they stand
in, tags by their name; the weights are log odds of lying within or outside
the main content, counted on labelled pages (pages that mark it up themselves
with ``article`` or ``main``). Elements that by their name, or by a word of
their class, id or role (``NEVER``, ``MEDIA``, ``NOT_CONTENT``: fixed lists), are
never content are taken out before anything is scored. One linear scan finds the contiguous run of
tokens with the highest sum: the content region. Its blocks, without the parts
that are never content, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted

SAMPLE_PAGES = 400  # labelled pages the weights are learned from, and
SAMPLE_CHARS = 100_000  # their size at most: the bound of the sample
SMOOTH = 1.0
MAX_WEIGHT = 6.0

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe textarea".split()
# never content either, but with tags inside, and no end of a paragraph
MEDIA = frozenset("svg canvas object audio video select datalist option optgroup annotation annotation-xml".split())
NEVER = frozenset("nav header footer aside form button dialog menu head title".split()) | frozenset(RAW)
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
                  "h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | NEVER
LABEL = ("article", "main")  # elements that mark up the content
# Words in class, id and role that name parts which are never content.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                        "disqus footer header hidden menu modal nav navbar navigation newsletter notice overlay pagination popup "
                        "promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored "
                        "subscribe toolbar widget complementary contentinfo search".split())

# Attributes up to the tag's end: a quoted value, which may hold one, begins
# after "=". A quote without its partner is an ordinary character.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?![\w:-])" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)("
    + _ATTRIBUTES + r")(?:>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile("[-_]+")
DEFAULT = {"w:p": 1.0, "w:h1": 1.0, "w:h2": 1.0, "w:article": 1.0, "w:main": 1.0, "t:p": -0.1}
TAG_DEFAULT, INLINE_DEFAULT, WORD_DEFAULT = -0.5, -0.05, 0.2


def _not_content(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes hide the element, and whether a name in its class,
    id or role says, in all its parts, that it is never content."""
    hidden = named = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name in ("class", "id", "role") and any(NOT_CONTENT.issuperset(_PARTS.split(x)) for x in value.split()):
            named = True
    return hidden, named


def tokens(page: str, spared: frozenset[int] = frozenset()) -> list[tuple[str, str, int, bool, bool]]:
    """(feature, text, words, never, inside) in page order. Tags have an empty text;
    ``never`` marks what stands in a part that is no content, ``inside`` what
    stands in ``article`` or ``main`` (their outermost tags do not). Elements left
    open are closed as HTML does for paragraphs, list items and options; media
    left open end where ``article`` or ``main`` begins. A class, id or role does
    not take away an element that holds the page's first ``article`` or ``main``,
    unless that lies in the other one: such elements (their places are
    ``spared``) are read again."""
    out: list[tuple[str, str, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each begins or lies in a never part
    never, depth = False, 0
    named: list[tuple[int, int]] = []  # place in the stack and the page of elements named as no content
    seen: set[str] = set()
    for m in _TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            n = len(text.split())
            if n:
                inner = "a" if any(x == "a" for x, _ in stack) else next((x for x, _ in reversed(stack) if x in BLOCK), "")
                out.append(("w:" + inner, text, n, never, depth > 0))
            elif out and out[-1][0] != "s:":
                out.append(("s:", text, 0, never, depth > 0))  # white space between inline elements
            continue
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        apart, above = never, depth
        if name in MEDIA:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None and (m[2] or name == "option"):
                del stack[at:]
                named = [x for x in named if x[0] < at]
            if not m[2] and not m[4].endswith("/"):
                stack.append((name, True))
            never = bool(stack) and stack[-1][1]
            continue
        media = next((i for i, (x, _) in enumerate(stack) if x in MEDIA), None) if never else None
        if media is not None and name not in LABEL:
            at = next((i for i in range(len(stack) - 1, media, -1) if stack[i][0] == name), None)
            if m[2] and at is not None:
                del stack[at:]
                continue
            if m[2] and not any(x == name for x, _ in stack):
                continue
            if not m[2] and not (name in BLOCK and stack[-1][0] == "option"):
                if name not in VOID and not m[4].endswith("/"):
                    stack.append((name, True))
                continue
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                depth -= sum(x in LABEL for x, _ in stack[at:])
                del stack[at:]
                named = [x for x in named if x[0] < at]
                never = bool(stack) and stack[-1][1]
        else:
            if name in LABEL:
                at = next((i for i, (x, _) in enumerate(stack) if x in MEDIA), None)
            else:  # no block stands in an option
                at = len(stack) - 1 if name in BLOCK and stack and stack[-1][0] == "option" else None
            if at is not None:
                del stack[at:]
                named = [x for x in named if x[0] < at]
                never = apart = bool(stack) and stack[-1][1]
            if name in BLOCK or name == "li":
                # a block closes an open paragraph, an item an open item, with what is open in them
                ends = ("p", "li") if name == "li" else ("p",)
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends), None)
                between = [x for x, _ in stack[at + 1:]] if at is not None else []
                if at is not None and not any(x in BLOCK for x in between):
                    del stack[at:]
                    named = [x for x in named if x[0] < at]
                    never = bool(stack) and stack[-1][1]
            if name not in VOID and not m[4].endswith("/"):
                if name in LABEL and name not in seen:
                    seen.add(name)
                    holders = {at for i, at in named if i < len(stack)}
                    if holders and not depth:
                        return tokens(page, spared | holders)
                apart = never or (name in NEVER and not (name == "header" and any(x in ("article", "main") for x, _ in stack)))
                if m[4] and name not in ("html", "body", "article", "main"):
                    hidden, by_name = _not_content(m[4])
                    by_name = by_name and m.start() not in spared
                    apart = apart or hidden or by_name
                    if by_name:
                        named.append((len(stack), m.start()))
                stack.append((name, apart))
                never = apart
                depth += name in LABEL
        out.append(("t:" + name, "", 0, apart, min(above, depth) > 0))
    return out


def learn(pages: list[str]) -> dict[str, float]:
    """Weights from labelled pages: log odds, per token, of the two sides."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in pages:
        for feature, _, n, never, within in tokens(page):
            if not never or feature in ("t:article", "t:main"):
                (inside if within else outside)[feature] += n or 1
    if not inside or not outside:
        return dict(DEFAULT)
    a, b = sum(inside.values()), sum(outside.values())
    out = {}
    for f in inside.keys() | outside.keys():
        w = math.log((inside[f] + SMOOTH) / (a + SMOOTH)) - math.log((outside[f] + SMOOTH) / (b + SMOOTH))
        w = max(-MAX_WEIGHT, min(MAX_WEIGHT, w))
        # words speak for a region or against it, tags only against it
        if f[0] == "w":
            out[f] = max(w, 0.1) if inside[f] > outside[f] else min(w, -0.1)
        else:
            out[f] = -0.05 if inside[f] > outside[f] else min(w, -0.05)
    return out


def region(found: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous token range of the highest score; of equal ones the
    first. Parts that are never content neither add nor end a region: they are
    left out of its text."""
    best, best_at, score, begin = 0.0, (0, 0), 0.0, 0
    for i, (feature, _, n, never, *_) in enumerate(found):
        if never or feature[0] == "s":
            continue
        w = weights.get(feature)
        if w is None:
            w = WORD_DEFAULT if n else TAG_DEFAULT if feature[2:] in BLOCK else INLINE_DEFAULT
        if score <= 0:
            score, begin = 0.0, i
        score += w * (n or 1)
        if score > best:
            best, best_at = score, (begin, i + 1)
    return best_at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the content region, character references decoded, white space
    within a block made single spaces, joined by an empty line."""
    if not page:
        return ""
    found = tokens(page)
    begin, end = region(found, weights)
    blocks, now = [], []
    for feature, text, _, never, _ in found[begin:end]:
        if text:
            if not never:
                now.append(text)
        elif feature[2:] in BLOCK:
            blocks.append(now)
            now = []
        elif feature == "t:br":
            now.append("\n")
    blocks.append(now)
    whole = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in whole if b)


def sample_pages(pages: DataFrame, html_col: str) -> list[str]:
    labelled = pages.select(quoted(html_col).alias("h")).where(F.col("h").rlike(r"(?i)<(article|main)\b") & (F.length("h") <= SAMPLE_CHARS))
    n = labelled.count()
    if not n:
        return []
    pick = F.shiftrightunsigned(F.xxhash64("h"), 33) / float(1 << 31)
    got = labelled.where(pick <= min(1.0, 1.5 * SAMPLE_PAGES / n)).groupBy("h").agg(F.min(pick).alias("pick"))
    return [r["h"] for r in got.orderBy("pick", "h").limit(SAMPLE_PAGES).collect()]


def fit_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    return learn(sample_pages(pages, html_col))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 weights: dict[str, float] | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page: the main text of the whole html.

    Null html and pages without content give the empty text; repeated rows are
    each read; an empty table gives an empty result; other columns are
    ignored. Without labelled pages fixed weights are used. No shuffle of the
    pages.
    """
    weights = fit_weights(pages, html_col) if weights is None else weights

    def compute(texts: list) -> dict:
        out = [main_text(t, weights) for t in texts]
        return {"main": pa.array(out, pa.string()), "n_chars": pa.array(list(map(len, out)), pa.int64())}

    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("text"))
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType),
                           T.StructField("main", T.StringType()), T.StructField("n_chars", T.LongType())])
    return (map_texts(rows, ["id", "url"], compute, schema)
            .withColumnRenamed("main", "text"))
