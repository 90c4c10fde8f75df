"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element.  A line weighs as many characters as it has
outside links; a line that is a link for the greater part weighs nothing.  The weights are summed
over windows of ``WINDOW`` lines.  Text begins where the sums surge past the threshold, goes on
while they don't vanish, and ends where they dive to zero; the lines between such points are the
text.  That decides on every page.  Declarations only shape the lines:

* What an element's name, or a whole token of its class, id or role, declares to be no article
  (menus, page headers and footers, asides, forms, adverts, notices, comments, what is hidden) is
  blanked; a part of a token counts where the element weighs less than the threshold.  Between lines of one section the blanked element leaves no gap, so an advert doesn't
  end the text around it; elsewhere it leaves a window of empty lines.  An element that holds more
  than half of the page's text is no such thing: it is kept if it has an article element or a main
  heading in it, or if nothing would surge without it.  Menus, footers and headers by
  an element's name, and what is hidden, never are.
* An article element begins and ends at such a gap too.  Runs in article elements are preferred:
  others stay out, unless they weigh ``TEASER`` times as much and more than ``TEASER`` thresholds.

At the end of a run outside article elements short lines that are no sentences are left out.

Scripts, styles and markup never become lines; what is no text only where it is closed (vector
graphics, buttons, lists of options, a page's head) never takes the rest of a page along.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, fresh_names
from loomwork.llm.tokens import trimmed

WINDOW = 3
THRESHOLD = 80
TEASER = 4

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>script|style|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"""|<[!?/a-z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
#: Elements whose content is no text, if they end at all; unclosed ones are read on after their tag.
_OPAQUE = {n: re.compile(rf"</{n}\s*>", re.I) for n in "noscript template svg math iframe object select option button head".split()}
_BODY = re.compile(r"<body\b", re.I)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Parts of a class, id or role token that say that an element is no article.
_NOISE_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup pagination pager toolbar "
    "banner popup modal notice notices alert alerts".split()
)
#: Tokens that say so only as a whole, or after one of the words of ``_OF_PAGE``.
_NOISE_TOKENS = frozenset(
    "header foot side aside rail widget widgets search searchbox login legal copyright disclaimer overlay respond reply replies "
    "skip contentinfo complementary".split()
)
_OF_PAGE = frozenset("site page global top main left right".split())
#: First parts that deny what follows, and last parts that tell of a state or a layout.
#: What may stand beside such parts in a token that as a whole says so.
_BESIDE = frozenset(
    "list section area box block container item items inner bar panel link links button buttons slot unit row group zone wrap thread count icon icons "
    "form message overlay top bottom left right main sticky fixed mobile desktop primary secondary article post posts page site user reader entry blog".split()
)
_DENYING = frozenset("no not non without has have with is hide show".split())
_STATES = frozenset("open closed enabled disabled on off active layout single wrapper page".split())
_TOKEN_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav footer menu dialog".split())
_DROPPED = frozenset("aside form fieldset".split())
_ARTICLES = frozenset(("article", "main"))
#: Elements that another block's start ends, so that their own end tag may be absent.
_SELF_ENDING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th"))
#: Elements whose lines make up one section.
_SECTIONS = frozenset("article body center dialog div footer form header main section td".split())


def noise_token(token: str) -> int:
    """Whether one token of a class, id or role value says that an element is no article: 2 as a whole, 1 in a part, else 0."""
    parts = [p.lower() for p in _TOKEN_PART.findall(token)]
    if not parts or parts[-1] in _STATES or any(p in _DENYING for p in parts[:-1]):
        return 0
    whole = parts[1:] if len(parts) > 1 and parts[0] in _OF_PAGE else parts
    if len(whole) == 1 and whole[0] in _NOISE_TOKENS:
        return 2
    if not any(p in _NOISE_PARTS for p in parts):
        return 0
    return 2 if all(p in _NOISE_PARTS or p in _NOISE_TOKENS or p in _BESIDE or p.isdigit() for p in parts) else 1


def _declared(name: str, rest: str, in_article: bool) -> int:
    """How an element is declared to be no article: 3 whatever it holds, 2 as a whole, 1 in a part of a token, else 0."""
    if name in _NEVER or (name == "header" and not in_article):
        return 3
    noise = 2 if name in _DROPPED else 0
    if name in ("html", "body") or ("=" not in rest and "hidden" not in rest):
        return noise
    for key, *values in _ATTRIBUTE.findall(rest):
        value, key = "".join(values), key.lower()
        if key in ("class", "id", "role"):
            noise = max([noise, *map(noise_token, value.split())])
        elif _HIDDEN.search(value) if key == "style" else key == "hidden" or value.lower() == "true":
            return 3
    return noise


@dataclass
class Line:
    text: str
    weight: int
    article: int  # the outermost article element around, 0 for none
    section: int  # the nearest section element around
    noise: int  # the nearest element around that is declared to be no article, 0 for none
    item: bool  # of a list or a table


@dataclass
class Noise:
    """An element that is declared to be no article; outer is the one around it."""

    outer: int
    declared: int = 2  # as in ``_declared``
    weight: int = 0
    main: bool = False  # an article element or a main heading in it


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    noise: list[Noise] = field(default_factory=lambda: [Noise(0)])


def parse(page: str) -> Page:
    """All lines with text, and the elements that are declared to be no article; linear in the page."""
    out = Page()
    parts: list[str] = []
    linked = links = heading = 0
    article, articles, sections = 0, 0, 0  # the open article element, how deep, and how many sections there were
    open_sections: list[tuple[str, int]] = [("", 0)]
    open_noise: list[list] = []  # name, how many of its name are open, its number
    item = False
    ends: dict[str, re.Match | None] = {}  # the next end of each opaque element's name

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                free = max(0, len(text) - linked)
                weight = len(text) if heading else free if 2 * free >= len(text) else 0
                noise = open_noise[-1][2] if open_noise else 0
                out.lines.append(Line(text, weight, article, open_sections[-1][1], noise, item))
                while noise:
                    out.noise[noise].weight += weight
                    noise = out.noise[noise].outer
            parts.clear()
            linked = 0

    def text_to(stop: int) -> None:
        nonlocal linked
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if links:
                linked += len(piece)

    def close_noise(name: str, closing: bool, empty: bool) -> None:
        if name in _ARTICLES and not closing and page.find(f"</{open_noise[-1][0]}", at) < 0:
            open_noise.clear()  # what was dropped never ends, and here begins an article
        while open_noise and (top := open_noise[-1][0]) in _SELF_ENDING and (name in _BLOCKS and name != top or name == top and not closing):
            open_noise.pop()
        if closing:
            for k in range(len(open_noise) - 1, -1, -1):
                if open_noise[k][0] == name:
                    del open_noise[k + 1 :]
                    open_noise[k][1] -= 1
                    if not open_noise[k][1]:
                        del open_noise[k]
                    break
        elif open_noise and open_noise[-1][0] == name and not empty:
            open_noise[-1][1] += 1

    def end_of(name: str) -> int:
        """Where an opaque element that begins here is over; -1 if it never ends.  Each name is looked for once in all."""
        if name not in ends or (ends[name] and ends[name].start() < at):
            ends[name] = _OPAQUE[name].search(page, at)
        found = ends[name]
        if not found or name == "head" and _BODY.search(page, at, found.start()):
            return -1
        return found.end()

    at = 0
    while m := _TOKEN.search(page, at):
        text_to(m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"])
        empty = name in _VOID or m["rest"].endswith("/")
        if name in _OPAQUE and not closing and not empty and (end := end_of(name)) >= 0:
            at = end
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = max(0, links - 1) if closing else 1
        if name in _BLOCKS:
            end_line()
            item = not closing and name in ("li", "td", "dd")
        if open_noise:
            close_noise(name, closing, empty)
        if name == "h1":
            heading = not closing
        if name in _SECTIONS and not empty:
            if not closing:
                sections += 1
                open_sections.append((name, sections))
            else:
                for k in range(len(open_sections) - 1, 0, -1):
                    if open_sections[k][0] == name:
                        del open_sections[k:]
                        break
        noise = 0 if closing or empty else _declared(name, m["rest"], articles > 0)
        if noise:
            end_line()
            out.noise.append(Noise(open_noise[-1][2] if open_noise else 0, noise))
            open_noise.append([name, 1, len(out.noise) - 1])
        elif name in _ARTICLES:
            articles = max(0, articles + (-1 if closing else 1))
            article = 0 if not articles else article or sections
        if not closing and (name == "h1" or (name in _ARTICLES and open_noise and open_noise[-1][0] != name)):
            k = open_noise[-1][2] if open_noise else 0
            while k:
                out.noise[k].main = True
                k = out.noise[k].outer
    text_to(len(page))
    end_line()
    return out


def surges(weights: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> bool:
    return bool(weights) and int(_sums(weights, window).max()) >= threshold


def _sums(weights: list[int], window: int) -> np.ndarray:
    """The weight of each line and the ``window - 1`` after it."""
    return np.convolve(np.array(weights, np.int64), np.ones(window, np.int64))[window - 1 :]


def text_ranges(weights: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """The runs of lines between a surge and the dive that follows.

    A run begins at the first line with weight of a window that reaches the threshold (if none does,
    the largest sum), or at the lines with weight right before it.  It ends where a whole window is
    empty.
    """
    n = len(weights)
    if not n or max(weights) == 0:
        return []
    sums = _sums(weights, window)
    least = min(threshold, int(sums.max()))
    out, k = [], 0
    while k < n:
        if sums[k] < least:
            k += 1
            continue
        first = k
        while weights[first] == 0:
            first += 1
        while first > 0 and weights[first - 1] > 0 and (not out or first > out[-1][1]):
            first -= 1
        last = k
        while last < n and sums[last] > 0:
            last += 1
        out.append((first, last))
        k = last + 1
    return out


def _blanked(page: Page) -> set[int]:
    """The declared elements that are blanked."""
    everything = sum(x.weight for x in page.lines)
    rest = [0 if x.noise else x.weight for x in page.lines]
    bare = not surges(rest)
    gone: set[int] = set()
    for k, e in enumerate(page.noise[1:], 1):  # outer elements come first
        wrapper = 2 * e.weight > everything and (e.main or bare) and e.declared < 3
        told = e.declared > 1 or e.weight < THRESHOLD  # a part of a name counts where there is little text
        if e.outer in gone or (told and not wrapper):
            gone.add(k)
    return gone


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of one page; empty for null and for pages without text."""
    found = parse(page or "")
    gone = _blanked(found)
    kept: list[Line | None] = []  # None is an empty line
    last: Line | None = None
    cut = False
    for x in found.lines:
        n = x.noise
        while n and n not in gone:
            n = found.noise[n].outer
        if n:
            cut = True
            continue
        if last is not None and (x.article != last.article or (cut and x.section != last.section)):
            kept += [None] * window
        kept.append(x)
        last, cut = x, False

    runs = text_ranges([x.weight if x else 0 for x in kept], window, threshold)
    inside = [any(x and x.article for x in kept[a:b]) for a, b in runs]
    mass = [sum(x.weight for x in kept[a:b] if x) for a, b in runs]
    own = sum(m for m, i in zip(mass, inside, strict=True) if i)
    if not any(inside):
        # a short article beside longer lines: its own windows tell where it is
        alone = text_ranges([x.weight if x and x.article else 0 for x in kept], window, threshold)
        own = sum(x.weight for a, b in alone for x in kept[a:b] if x)
        runs, inside, mass = runs + alone, inside + [True] * len(alone), mass + [0] * len(alone)
    beside = sum(m for m, i in zip(mass, inside, strict=True) if not i)
    alone = any(inside) and not (beside > TEASER * own and beside > TEASER * threshold)
    chosen = sorted((a, b if i else _dive(kept, a, b, threshold)) for (a, b), i in zip(runs, inside, strict=True) if i or not alone)
    return "\n".join(x.text for a, b in chosen for x in kept[a:b] if x)


_SENTENCE_END = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f:;]["'\u201d\u2019\u00bb)\]]*$""")


def _dive(lines: list[Line | None], first: int, last: int, threshold: int) -> int:
    """Where a run outside article elements is over: before its last lines, if they are short and no sentences.

    "About us" and "Copyright 2020" stand close to a page's last paragraph.  Each is below
    the threshold by itself, doesn't end as a sentence and is no item of a list.
    """
    while last - first > 1:
        x = lines[last - 1]
        if x is not None and x.weight and (x.weight >= threshold or x.item or _SENTENCE_END.search(x.text)):
            break
        last -= 1
    return last


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All other columns of pages, and the main text of each page with its number of code points.

    Null and empty pages have an empty text.  A column of a result's name is replaced.  Repeated
    rows and ids are pages of their own.  One pass without a shuffle; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*kept, text_col, chars_col])

    bounded_batches(pages.sparkSession)
    whole = pages.select(*(F.col(f"`{c}`") for c in kept))
    source = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html_col).alias(fresh_names(whole, "page_html")[0]))
    schema = whole.schema.add(text_col, "string").add(chars_col, "long")
    return source.mapInArrow(trimmed(run), schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
