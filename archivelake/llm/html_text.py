"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing and threshold clustering.

The standard library's parser streams events. Each run of text between block-level tags is one line; a line knows its text, the
tags seen before and in it, the region that holds it and the marked element around it. Elements are marked that can't be
content: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers. Tag names and roles mark for good;
class and id names that consist of nothing but such words set the ratio of their lines to 0. Inside article and main elements only names that are plain about
it count, and names of lists (menus, sharing and the like) don't count where the element as a whole holds ``dense`` characters a tag or more, as prose does.
An element that is never closed marks nothing, since it is unknown how far it was meant to reach.

The ratios decide: text-to-tag ratios of the lines are smoothed with a Gaussian kernel; lines of which both the ratio and the smoothed ratio reach a threshold are
content, where the threshold is a share of the standard deviation, at most ``dense`` characters a tag. Neighbours above the threshold after
smoothing make clusters with them. If article or main elements hold half or more of the content's ratios, they are the region, all of them; an article that only
teases beside a denser part of the page isn't. Otherwise the region is the smallest element around all content lines; if that is the whole page, it reaches
from the first such cluster to the last. All lines of the region that aren't marked are returned, so short lines between dense ones stay.

The work is linear in the length of a page, however deep its elements nest.

Defined cases: null or empty html gives an empty text and 0; html without markup is its own text; unclosed and stray tags are
tolerated; repeated rows give repeated results; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, prepared

# Element names of HTML by role, and words of class and id names.
BLOCK = set("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav footer aside form script style noscript template head title iframe object svg canvas button select textarea menu dialog audio video math".split())
IN_HEAD = set("base link meta noscript script style template title".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
PLAIN = set("ad ads advert adverts advertisement advertisements sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup modal newsletter subscribe subscription signup share sharing social comment comments disqus replies pagination pager toolbar login".split())
LISTS = set("nav navbar navigation menu breadcrumb breadcrumbs share sharing social pagination pager toolbar".split())
OTHER = set("banner copyright disclaimer footer form header legal masthead notice notices related reply search side sponsor widget".split())
FILLER = set("area bar block bottom box button buttons container content global group inner item items left link links list main outer page panel post primary right row secondary section site slot top unit wrap wrapper".split())
IMPLIED = set("dd dt head li option p tbody td tfoot th thead tr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead")}
#: Elements whose inside is closed to the end of such an element outside.
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ("td", "th", "caption", "table", "button", "object")}
SCOPES |= dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",))
REGIONS = ("article", "main", "div", "section", "body", "td", "center")
SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


#: How an element is marked: not at all, as a list by its names, by its names, by what it is.
OPEN, LIST, NAMED, HARD = range(4)


def marking(names: str, plainly: bool) -> int:
    """How class or id names mark that consist of marking words, with filler and numbers; ``plainly``: of those that are plain about it."""
    out = OPEN
    for name in names.split():
        words = {w.lower() for w in SPLIT.split(name)} - {""}
        found = words & PLAIN or (not plainly and words & OTHER)
        if found and all(w in PLAIN or w in OTHER or w in FILLER or w.isdigit() for w in words):
            out = max(out, LIST if found <= LISTS else NAMED)
    return out


class Lines(HTMLParser):
    """Collects (text, tags, mark, region) per line; per region its parent and the outermost article or main around it; per mark
    the mark around it, its kind, whether it lies in an article or main, and whether its element was closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, mark and region inside it, whether the mark is its own
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.outer = [-1], [-1]
        self.around, self.closed, self.kinds, self.within = [-1], [False], [OPEN], [False]
        self.body = 0  # region of the body element
        self.hidden = 0  # marked inline elements that are open

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, *(self.stack[-1][1:3] if self.stack else (0, 0))))
            self.tags = 0
        self.parts = []

    def last(self, *tags: str) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def cut(self, at: int, ended: bool) -> None:
        """Take the elements from this place on off the stack; ``ended``: the lowest of them by its own end tag."""
        while len(self.stack) > at:
            tag, mark, _, own = self.stack.pop()
            self.places[tag].pop()
            if own:
                self.closed[mark] = ended and len(self.stack) == at or tag in IMPLIED or tag not in BLOCK
                self.hidden -= tag not in BLOCK

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag not in IN_HEAD and (at := self.last("head")) >= 0 and tag != "head":
                self.cut(at, True)
            if tag != "br" and (at := self.last("p")) > self.last(*SCOPES["p"]):
                self.cut(at, True)
            while tag in CLOSES and (at := self.last(*CLOSES[tag])) > self.last(*SCOPES[tag]):
                self.cut(at, True)
            if tag in ("article", "main") and (at := min((own[0] for t in ("nav", "header", "footer") if (own := self.places.get(t))), default=-1)) >= 0:
                self.cut(at, False)
        self.tags += 1
        if tag in VOID:
            return
        own = dict(attrs)
        inside = self.last("article", "main") >= 0
        marked = HARD * (tag in NEVER or (own.get("role") or "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or tag == "header" and not inside)
        if not marked and tag not in ("main", "body", "html"):
            names = f"{own.get('class') or ''} {own.get('id') or ''}"
            marked = marking(names, inside or tag in ("p", "article") or tag not in BLOCK) if len(names) > 1 else OPEN
        if tag not in BLOCK and not marked:
            return  # inline elements change nothing
        _, mark, region, _ = self.stack[-1] if self.stack else ("", 0, 0, False)
        if marked:
            self.around.append(mark)
            self.closed.append(False)
            self.kinds.append(marked)
            self.within.append(inside)
            mark = len(self.closed) - 1
            self.hidden += tag not in BLOCK
        if tag in REGIONS:
            self.parents.append(region)
            self.outer.append(len(self.outer) if self.outer[region] == -1 and tag in ("article", "main") else self.outer[region])
            region = len(self.outer) - 1
            self.body = region if tag == "body" and not self.body else self.body
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, mark, region, marked > OPEN))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if (at := self.last(tag)) > self.last(*SCOPES.get(tag, ())):
            self.cut(at, True)

    def handle_data(self, data):
        if not self.hidden and not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.parts.append(data)

    def finished(self, dense: float = 20.0) -> list[tuple[str, int, int, int]]:
        """(text, tags, how marked, region) of all lines."""
        self.close()
        self.flush()
        self.cut(0, False)
        chars, tags = [0] * len(self.kinds), [1] * len(self.kinds)
        for text, n, m, _ in self.lines:
            chars[m], tags[m] = chars[m] + len(text), tags[m] + n
        for m in range(len(self.kinds) - 1, 0, -1):  # marks come before those inside them
            chars[self.around[m]] += chars[m]
            tags[self.around[m]] += tags[m] - 1
        marked = [OPEN]
        for m in range(1, len(self.kinds)):
            prose = self.kinds[m] == LIST and self.within[m] and chars[m] >= dense * tags[m]
            marked.append(max(marked[self.around[m]], self.kinds[m] if self.closed[m] and not prose else OPEN))
        return [(text, n, marked[m], r) for text, n, m, r in self.lines]


def ratios_of(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Characters a tag of each line; 0 for marked ones."""
    return np.array([0.0 if marked else len(text) / (1 + tags) for text, tags, marked, _ in lines])


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolution with a Gaussian kernel of radius 3 sigma; ends are padded with their own value."""
    radius = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_lines(ratios: np.ndarray, sigma: float, share: float, dense: float) -> tuple[list[int], list[int], float]:
    """Numbers of the content lines, of all lines of the clusters around them, and the threshold."""
    soft = smoothed(ratios, sigma)
    least = min(share * float(soft.std()), dense)
    high = soft >= least
    core = np.flatnonzero(high & (ratios >= least) & (ratios > 0))
    if not len(core):
        core = np.flatnonzero(ratios > 0)
    high[core] = True
    cluster = np.cumsum(np.concatenate([[0], high[1:] != high[:-1]]))
    return core.tolist(), np.flatnonzero(high & np.isin(cluster, cluster[core])).tolist(), least


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, dense: float = 20.0) -> str:
    parser = Lines()
    parser.feed(html or "")
    lines = parser.finished(dense)
    ratios = ratios_of(lines) if lines else np.zeros(0)
    if not ratios.any():
        return ""
    core, clustered, least = content_lines(ratios, sigma, share, dense)
    outer = parser.outer
    named = [outer[r] != -1 for *_, r in lines]
    first, last = 0, len(lines)
    if 2 * sum(ratios[i] for i in core if named[i]) >= sum(ratios[i] for i in core):
        within = named
    else:
        held = [0] * len(parser.parents)
        for i in core:
            held[lines[i][3]] += 1
        for r in range(len(held) - 1, 0, -1):  # parents come before their children
            held[parser.parents[r]] += held[r]
        best = max(r for r, n in enumerate(held) if n == len(core))
        inside = [best == 0]
        for r, parent in enumerate(parser.parents[1:], 1):
            inside.append(r == best or inside[parent])
        within = [inside[r] for *_, r in lines]
        if best in (0, parser.body):
            first, last = clustered[0], clustered[-1]
    shown = lambda i: within[i] and first <= i <= last and (not lines[i][2] or lines[i][2] < HARD and ratios[i] >= max(least, 1e-9))
    return " ".join(line[0] for i, line in enumerate(lines) if shown(i))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every whole page."""
    def run(cols):
        texts = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(prepared(pages, "page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
