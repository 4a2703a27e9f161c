"""Main text of web pages by tag-path ratios.

Every piece of text has a root-to-leaf tag path. Per page and path: characters, punctuation and number of
pieces. Long, punctuated text under few pieces marks content paths; menus and link lists score low. The two
ratios are smoothed over the page's order, fused by multiplication and cut at a threshold. The paths that pass name
the content's container; inside it, paths that fail go where they are lists of links or lie bare at its edges.
Class words and forms only mark a part: it goes if it is not what holds the page's content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names whose content is never main text.
SKIPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video map nav "
                    "aside footer button select textarea input label fieldset dialog menu".split())
#: Their content is raw text up to the end tag.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
#: Elements that can be the container of a main text.
HOLDERS = frozenset("html body article main section div table tbody tr td center".split())
#: Elements that name the content themselves.
NAMED = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class and id names that mark parts beside the main text.
BESIDE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                   "cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter "
                   "notice notices pagination popup promo promoted recommended related replies respond share sharing "
                   "sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements a start tag ends if they are open (innermost scope only).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section div main td th blockquote".split())

#: Smoothing reaches this many pieces to either side; a path passes with this share of the page's mean ratio.
REACH, THRESHOLD = 2, 0.5
#: A marked part is a wrapper of the content, and stays, if it holds this share of the page's text: with the page's first
#: article (or, without one, first heading) in it; with a longer class name that holds a mark; with the very word.
WITH_CONTENT, LOOSE, EXACT = 0.3, 0.5, 0.95
#: A path is a list of links if it has two blocks or more that are links throughout.
LINKED = 2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


class Piece:
    __slots__ = ("text", "path", "chain", "block", "heading", "marks", "link")

    def __init__(self, text, path, chain, block, heading, marks, link):
        self.text, self.path, self.chain, self.block = text, path, chain, block
        self.heading, self.marks, self.link = heading, marks, link


def _beside(name: str, attributes: str, inside_content: bool) -> tuple[bool, float]:
    """Does this start tag open a part that is never content; and, if only marked as beside the content, the share of
    the page's text above which it must be a wrapper (0: no mark)?"""
    if name in SKIPPED or name == "header" and not inside_content:
        return True, 0.0
    mark = LOOSE if name == "form" else 0.0
    if not attributes or name in ("html", "body", "main"):
        return False, mark
    for found in ATTRIBUTE.finditer(attributes):
        key, value = found.group(1).lower(), (found.group(2) or found.group(3) or found.group(4) or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, 0.0
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0.0
        if key == "role" and value in ROLES:
            mark = EXACT
        elif key in ("class", "id"):
            if not BESIDE.isdisjoint(value.split()):
                mark = EXACT
            elif name != "article" and not BESIDE.isdisjoint(re.split(r"[^a-z]+", value)):
                mark = mark or LOOSE
    return False, mark


def pieces(page: str) -> list[Piece]:
    """Text pieces outside skipped parts, in order, each with its path of elements, the block it lies in and the marked
    parts around it (serial number and limit, outermost first)."""
    stack: list[tuple[str, int, bool, float]] = []  # name, serial number, opens a part that is skipped, mark
    out: list[Piece] = []
    beside = serial = block = at = 0
    size = len(page)

    def text(raw):
        if raw and not beside:
            # an article that is marked itself, such as one of the readers' comments, names no content
            chain = tuple((s[1], "div" if s[3] and s[0] == "article" else s[0]) for s in stack if s[0] in HOLDERS)
            path = "/".join(s[0] for s in stack if s[0] in BLOCKS or s[0] == "a")
            out.append(Piece(html.unescape(raw), path, chain, block, any(s[0] in HEADINGS for s in stack),
                             tuple((s[1], s[3]) for s in stack if s[3]), any(s[0] == "a" for s in stack)))

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at, name = found.end(), found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None and not (name == "p" and any(s[0] in SCOPES for s in stack[depth:])):
                for closed in stack[depth:]:
                    beside -= closed[2]
                    block += closed[0] in BLOCKS
                del stack[depth:]
            elif name in BLOCKS:
                block += 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCKS:
            block += 1
            # a block start ends an open paragraph, with what was left open in it
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    for closed in stack[d:]:
                        beside -= closed[2]
                    del stack[d:]
                    break
                if stack[d][0] in SCOPES:
                    break
        for d in range(len(stack) - 1, -1, -1):
            if name not in CLOSES or stack[d][0] in SCOPES and stack[d][0] not in CLOSES[name]:
                break
            if stack[d][0] in CLOSES[name]:
                for closed in stack[d:]:
                    beside -= closed[2]
                del stack[d:]
                break
        if name in VOID:
            continue
        attributes = found.group(3)
        if attributes.endswith("/") and name in ("svg", "math"):
            continue
        part, mark = _beside(name, attributes, any(s[0] in NAMED for s in stack))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if name == "textarea" or part or name == "title":
                at = size if end is None else end.end()
                continue
        serial += 1
        stack.append((name, serial, part, 0.0 if beside else mark))
        beside += part
    return out


def _smooth(values: list[float]) -> list[float]:
    """Gaussian mean over neighbours in page order."""
    kernel = [math.exp(-d * d / (2.0 * max(1, REACH) ** 2 / 4)) for d in range(REACH + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - REACH), min(len(values), i + REACH + 1)):
            total += kernel[abs(i - j)] * values[j]
            weight += kernel[abs(i - j)]
        out.append(total / weight)
    return out


def _without_marked(found: list[Piece]) -> list[Piece]:
    """Drop the pieces of marked parts, but not of those that wrap the content."""
    size: dict[int, int] = {}
    total, first = 0, None
    for p in found:
        n = len(p.text.strip())
        total += n
        for serial, _ in p.marks:
            size[serial] = size.get(serial, 0) + n
    for holds in (lambda p: any(e[1] in NAMED for e in p.chain), lambda p: p.heading):
        first = first or next((p for p in found if p.text.strip() and holds(p)), None)
    around = frozenset(serial for serial, _ in first.marks) if first else frozenset()
    goes = {}
    for p in found:
        for serial, limit in p.marks:
            if serial not in goes:
                goes[serial] = size[serial] < (WITH_CONTENT if serial in around else limit) * total
    kept = [p for p in found if not any(goes[serial] for serial, _ in p.marks)]
    if any(p.text.strip() for p in kept) or not around:
        return kept
    return [p for p in found if all(serial in around for serial, _ in p.marks)]  # a page with little besides its heading


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by two line ends; empty if there is none."""
    found = _without_marked([p for p in pieces(page or "") if p.text])
    solid = [p for p in found if p.text.strip()]
    if not solid:
        return ""
    per: dict[str, list[float]] = {}
    for p in solid:
        count = per.setdefault(p.path, [0.0, 0.0, 0.0])
        words = SPACE.sub(" ", p.text).strip()
        count[0] += len(words)
        count[1] += len(PUNCTUATION.findall(words))
        count[2] += 1
    length = {k: v[0] / v[2] for k, v in per.items()}
    points = {k: (1.0 + v[1]) / v[2] for k, v in per.items()}
    fused = [a * b for a, b in zip(_smooth([length[p.path] for p in solid]), _smooth([points[p.path] for p in solid]))]
    cut = THRESHOLD * sum(fused) / len(fused)
    chosen = {p.path for p, f in zip(solid, fused) if f >= cut}
    strong = {k for k in per if length[k] * points[k] >= cut}  # without what neighbours lend
    picked = [p for p in solid if p.path in chosen]
    # the container: what the weight of the picked pieces has in common
    weight: dict[tuple, float] = {}
    total = 0.0
    for p in picked:
        score = length[p.path] * points[p.path] * len(p.text)
        total += score
        for element in p.chain:
            weight[element] = weight.get(element, 0.0) + score
    best = max(picked, key=lambda p: length[p.path] * points[p.path])
    holding = [e for e in best.chain if weight[e] >= 0.9 * total]  # root first
    container = holding[-1] if holding else None
    named = [e for e in holding if e[1] in NAMED]
    if named:
        container = named[-1]
    elif container is not None:
        # headings and strong paths right outside belong to it
        for wider in holding[-2::-1]:
            if not all(p.heading or p.path in strong for p in solid if wider in p.chain and container not in p.chain):
                break
            container = wider
    inside = [p for p in found if container is None or container in p.chain]
    blocks: dict[int, list[Piece]] = {}
    for p in inside:
        blocks.setdefault(p.block, []).append(p)
    linked: dict[str, list[int]] = {}
    for number, parts in blocks.items():
        text = [p for p in parts if p.text.strip()]
        if text and all(p.link and p.path not in strong for p in text):
            linked.setdefault(text[0].path, []).append(number)
    gone = {number for numbers in linked.values() if len(numbers) >= LINKED for number in numbers}
    if not named:
        # bare text of weak paths before the first and after the last strong one
        bare = lambda p: p.path not in strong and not p.heading and not p.link and p.path.rpartition("/")[2] in HOLDERS
        held = [p for p in inside if p.text.strip() and p.block not in gone]
        for order in (held, held[::-1]):
            for p in order:
                if not bare(p):
                    break
                gone.add(p.block)
    texts = (SPACE.sub(" ", "".join(p.text for p in parts)).strip() for number, parts in sorted(blocks.items()) if number not in gone)
    return "\n\n".join(t for t in texts if t)


def extracted(pages: DataFrame, page: str = "html", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The `carry` columns (default: all but the page) and `text`, the main text of each page.

    Null and empty pages give an empty text; broken markup is read as far as it goes, unclosed elements end with
    the page; a page of any length is read whole; repeated rows stay. Row-local: no shuffle.
    """
    carry = [c for c in pages.columns if c not in (page, "text")] if carry is None else list(carry)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in carry], text_of(F.col(f"`{page}`")).alias("text"))
