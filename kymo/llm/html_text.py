"""Main text of web pages by text-to-tag ratio.

A page is read once by the standard library's event parser. Its events are cut into lines, one for each
block of running text, with the tags met in it and the element that holds it. Each line's ratio of
text to tags, up to SATURATION, is weighed by what the elements around it are: text of menus, headers, footers, sidebars,
adverts, notices, forms and reader comments, told by element, role and class, weighs nothing. The ratios are smoothed by a Gaussian over
neighbours, and two-means clustering puts a threshold between the low and the high ones. The lowest common
ancestor of all lines above it, or the article around that, is the content region. All its lines are the text, short ones
too, but for those of suspect elements most of whose text lies below the threshold. Suspect are the elements whose text weighs nothing and
those with a word in class or id that articles may have as well (NAMES without SURE). Only what is no running text (scripts, styles,
hidden elements, controls) is left out beforehand.

Defined cases: a null or empty html has an empty text, as has a page whose text weighs nothing; text outside any element counts as the
body's; unclosed elements end with the element around them; an element that is left open or is a form, and holds an article, is not suspect;
repeated rows are read each; the other
columns of the input stay as they are; very long pages are parsed in one pass in memory of their own size.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reach and width of the smoothing, in lines; characters a tag from which a line is text and no more so, however long it is.
REACH, SIGMA, SATURATION = 2, 1.0, 200.0

# Element and attribute names of HTML, and words that sites use in class, id and role.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = frozenset("button canvas datalist head iframe input label map math meter noframes noscript object optgroup option output progress script select style svg template textarea title".split())
AROUND = frozenset("aside dialog footer form header menu nav".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre search section summary table tbody tfoot thead tr ul head iframe noframes noscript script style template textarea title".split()) | AROUND
HOLDERS = frozenset("article blockquote body center dd details div dl figure html li main ol section table tbody td th tr ul".split()) | AROUND
ENDS_P = BLOCKS - frozenset("script style noscript template iframe title head".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
NAMES = frozenset(
    "ad ads adv adbox adunit advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments commentlist cookie cookiebar cookies consent copyright disclaimer disqus footer gdpr "
    "header masthead menu menus modal nav navbar navigation newsletter newsletters notice notices notification overlay pager pagination paywall popup promo promos promotion recommended related replies respond responses "
    "search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar trending widget widgets".split()
)
#: Those that name what is never part of an article, whatever its ratio.
SURE = frozenset(
    "ad ads adv adbox adunit advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookiebar cookies disqus footer gdpr nav navbar navigation pager pagination replies respond "
    "sidebar sidebars skyscraper".split()
)
#: Words of names that articles use for their own parts, and that tell of a layout around the text.
OF_ARTICLES, LAYOUT = frozenset("header masthead".split()), frozenset("has no with without".split())
#: Elements that are parts of a text: a region does not end with one of them.
PARTS = frozenset("blockquote dd details dl figure li ol section ul".split())
#: What an element's text is: as any other, of a suspect name, of no weight, no running text at all.
KEPT, NAMED, WEIGHTLESS, OUT = range(4)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL, _APART = re.compile(r"([a-z])([A-Z])"), re.compile(r"[^a-z]+")


def _kind(tag: str, attrs: list, inside_article: bool) -> int:
    """What the text of an element is: KEPT, NAMED, WEIGHTLESS or OUT."""
    if tag in SKIPPED:
        return OUT
    found = WEIGHTLESS if tag in AROUND and not (tag == "header" and inside_article) else KEPT
    whole = tag in ("html", "body", "main", "article")
    for key, value in attrs:
        low = (value or "").lower()
        if tag not in ("html", "body") and (key == "hidden" and low != "false" or not whole and (key == "aria-hidden" and low == "true" or key == "style" and HIDDEN_STYLE.search(low))):
            return OUT
        if whole:
            continue
        if key == "role" and low in ROLES:
            found = WEIGHTLESS
        if key in ("class", "id"):
            words = _APART.split(_CAMEL.sub(r"\1 \2", value or "").lower())
            named = [w for w in words if w in NAMES and not (inside_article and w in OF_ARTICLES)] if LAYOUT.isdisjoint(words) else []
            found = max(found, KEPT if not named else NAMED if SURE.isdisjoint(named) else WEIGHTLESS)
    return found


class Lines(HTMLParser):
    """Collects lines: text, tags met, the element that holds it, and the suspect element around it; the elements know their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds = [-1], ["body"]
        # of each suspect element the suspect one around it, and whether its text weighs nothing; 0 is none
        self.around, self.weightless = [0], [False]
        # tag, no running text, holder, inside an article, suspect element
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, 0)]
        self.lines: list[tuple[str, int, int, int]] = []
        self.with_article: set[int] = set()
        self.parts: list[str] = []
        self.tags = 0
        self.paragraphs = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, out, holder, _, suspect = self.open[-1]
                if not out:
                    self.lines.append((text, self.tags, holder, suspect))
                self.tags = 0
            self.parts = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if self.paragraphs and tag in ENDS_P:
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] == "p":
                        self._close(k)
                        break
                    if self.open[k][0] in HOLDERS:
                        break
        elif tag in ("td", "th", "br"):
            self.parts.append(" ")
        if tag in VOID:
            return
        _, out, holder, article, suspect = self.open[-1]
        if not out:
            kind = _kind(tag, attrs, article)
            if kind:
                self.flush()
            if kind == OUT:
                out = True
            elif kind:
                self.around.append(suspect)
                self.weightless.append(kind == WEIGHTLESS)
                suspect = len(self.around) - 1
            elif tag in ("article", "main"):
                e = suspect
                while e:
                    self.with_article.add(e)
                    e = self.around[e]
            if not out and tag in HOLDERS:
                self.parents.append(holder)
                self.kinds.append(tag)
                holder = len(self.parents) - 1
        self.paragraphs += tag == "p"
        self.open.append((tag, out, holder, article or tag in ("article", "main"), suspect))

    def _close(self, k: int) -> None:
        if self.open[-1][1] and not self.open[k - 1][1] or self.open[-1][4] != self.open[k - 1][4]:
            self.flush()
        self.paragraphs -= sum(x[0] == "p" for x in self.open[k:])
        del self.open[k:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag != "form" and self.open[k][4] != self.open[k - 1][4]:  # closed by its own end: what it holds is its own
                    self.with_article.discard(self.open[k][4])
                self._close(k)
                return

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.parts.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of each value and its neighbours."""
    weights = np.array([math.exp(-(k**2) / (2 * SIGMA**2)) for k in range(-REACH, REACH + 1)])
    total = np.convolve(ratios, weights)[REACH : REACH + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[REACH : REACH + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The midpoint between the means of two clusters of values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        at = (low + high) / 2
        below, above = values[values <= at], values[values > at]
        if not len(above) or not len(below):
            break
        if (float(below.mean()), float(above.mean())) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def _dropped(lines: list, high: list[bool], around: list[int], suspect: list[bool]) -> list[bool]:
    """Of each element whether it, or a suspect one around it, is suspect and has most of its text in lines below the threshold."""
    size, text = [0] * len(around), [0] * len(around)
    for (words, _, _, e), above in zip(lines, high, strict=True):
        size[e] += len(words)
        text[e] += len(words) * above
    for e in range(len(around) - 1, 0, -1):  # inner ones come after those around them
        size[around[e]] += size[e]
        text[around[e]] += text[e]
    out = [False] * len(around)
    for e in range(1, len(around)):
        out[e] = out[around[e]] or suspect[e] and 2 * text[e] < size[e]
    return out


def main_text(html: str | None) -> str:
    """The blocks of the content region, joined by empty lines."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents, kinds, around = parser.lines, parser.parents, parser.kinds, parser.around
    if not lines:
        return ""
    suspect = [e not in parser.with_article for e in range(len(around))]
    weightless = [False] * len(around)
    for e in range(1, len(around)):
        weightless[e] = weightless[around[e]] or suspect[e] and parser.weightless[e]
    own = np.minimum(np.array([0.0 if weightless[x[3]] else len(x[0]) / max(1, x[1]) for x in lines]), SATURATION)
    ratios = smoothed(own)
    at = threshold(ratios)
    dropped = _dropped(lines, (own > at).tolist(), around, suspect)
    wanted = [k for k, x in enumerate(lines) if not dropped[x[3]]] or [k for k, x in enumerate(lines) if not weightless[x[3]]]
    if not wanted:
        return ""
    # a short line between long ones has a high mean, but does not tell where the region ends
    chosen = [k for k in wanted if own[k] > at and ratios[k] > at] or [k for k in wanted if ratios[k] > at] or wanted
    below = [0] * len(parents)
    for k in chosen:
        below[lines[k][2]] += 1
    for holder in range(len(parents) - 1, 0, -1):  # children come after their parents
        below[parents[holder]] += below[holder]
    region = max(holder for holder, n in enumerate(below) if n == len(chosen))
    while kinds[region] in PARTS and kinds[parents[region]] not in ("html", "body"):
        region = parents[region]
    outer = region
    while outer > 0:
        if kinds[outer] in ("article", "main"):
            region = outer
            if kinds[outer] == "article":
                break
        outer = parents[outer]
    inside = [False] * len(parents)
    inside[region] = True
    for holder in range(region + 1, len(parents)):
        inside[holder] = inside[parents[holder]]
    return "\n\n".join(lines[k][0] for k in wanted if inside[lines[k][2]])


def _extract_all(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def extracted(html: Column | str) -> Column:
    """main_text() of each page."""
    return F.arrow_udf(_extract_all, "string")(html)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A struct column row with the columns of pages, and text."""
    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")).select("row", extracted(F.col(f"row.{html_col}").cast("string")).alias("text"))
