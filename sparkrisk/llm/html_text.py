"""HTML extraction by the line-block distribution.

Markup is stripped and every block element becomes a line. Text inside containers that are
not the article (menus, footers, sidebars, notices, adverts, forms, comments: by element, or
by a name in their class, id or role) and lines that are mostly links count as length zero.
Text lengths are summed over sliding windows of lines. The distribution surges where a window
sum reaches a share of the page's own largest one and dives where it falls under it; lines
from the first surge to the last dive are kept, short ones between long ones too. A line of
links counts as zero beside another one or at an end of the page: a linked paragraph among
others stays, a menu does not. Where
the page marks its article, lines outside it count as zero and any text makes a surge, so short
paragraphs at its ends stay. A class, id or itemprop marks the article on pages without an
article or main element, if it holds at least half of the other text.

Pages are read by one scan forward, in time linear in their length however broken they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 0.1
LINK_SHARE = 0.6

# fixed values: elements and the words that mark a container as not the article
RAW = set("script style noscript template textarea title iframe noembed noframes svg annotation "
          "annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map "
             "mark nobr object q ruby rb rt rp s samp small span strike strong sub sup time tt u "
             "var wbr "
             # formulas
             "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
             "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd "
             "mtext mtr munder munderover none semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROP = set("nav footer aside form menu dialog button select datalist fieldset head audio video "
           "canvas".split())
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs "
            "comment comments cookie cookies consent disqus footer header masthead menu modal nav "
            "navbar navigation newsletter notice notices pagination paywall popup promo promoted "
            "related reply replies respond share sharing sidebar sidebars social sponsor "
            "sponsored subscribe subscription toolbar widget complementary contentinfo "
            "search".split())
#: inside the article: what is named as a menu, header, footer, sidebar, notice, advert, form or
#: comments; related work, widgets and the like are subjects there
INNER_MARKS = MARKS - set("complementary modal popup related widget".split())
#: beside a mark in one compound name; any other word gives the name another meaning
BESIDE = set("area bar body block box bottom btn button buttons container desktop div email fixed "
             "form global icon icons id inner item items left link links list main mobile outer "
             "page posts articles primary right secondary section signup site slot sticky thread "
             "title top unit wrap wrapper x zone".split())
ARTICLE_MARKS = set("articlebody article entry content".split())
ARTICLE_BESIDE = set("body main page post single story text".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# end of fixed values

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_UP_TO = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z]+")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


class _Line:
    __slots__ = ("parts", "linked", "inside", "dropped", "named")

    def __init__(self, inside: bool, dropped: bool, named: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.inside = inside
        self.dropped = dropped
        self.named = named

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _read(attributes: str) -> dict[str, str]:
    """Values by name, the first of equal names."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(attributes):
        found.setdefault(match[1].lower(), next((g for g in match.groups()[1:] if g is not None), ""))
    return found


def _tokens(value: str) -> list[set[str]]:
    """The words of each name in a value."""
    return [set(_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
            for token in value.split()]


def _marks(values: dict[str, str], ids: bool) -> set[str]:
    """Marks among whole names: a mark alone, several, or one with words of its place."""
    found = set(values.get("role", "").lower().split()) & MARKS
    for name in ("class", "id") if ids else ("class",):
        for words in _tokens(values.get(name, "")):
            if words <= MARKS | BESIDE:
                found |= words & MARKS
    return found


def _article_named(values: dict[str, str]) -> bool:
    return any(words & ARTICLE_MARKS and words <= ARTICLE_MARKS | ARTICLE_BESIDE
               for name in ("class", "id", "itemprop") for words in _tokens(values.get(name, "")))


def _hidden(values: dict[str, str]) -> bool:
    """Whether an element is marked as not shown, not whether the word stands in some value."""
    return (values.get("hidden", "false").strip().lower() != "false"
            or values.get("aria-hidden", "").strip().lower() == "true"
            or bool(_UNSHOWN.search(values.get("style", ""))))


class _Scanner:
    """Tags of a page from front to back; no part of it is read more than a few times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self._none: dict[str, bool] = {}

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, or -1; what has run out is not looked for again."""
        if self._none.get(what):
            return -1
        found = self.page.find(what, at)
        self._none[what] = found < 0
        return found

    def _past(self, what: str, at: int) -> int:
        found = self._find(what, at)
        return len(self.page) if found < 0 else found + len(what)

    def _tag_end(self, at: int) -> int:
        """The > that ends a tag, quoted values aside; an open quote ends at the first >."""
        start, page = at, self.page
        while True:
            at = _UP_TO.match(page, at).end()
            if at == len(page) or page[at] == ">":
                return at
            close = self._find(page[at], at + 1)
            if close < 0:
                first = self._find(">", start)
                return len(page) if first < 0 else first
            at = close + 1

    def raw_end(self, name: str) -> tuple[int, int]:
        """Where the raw text of an element ends, and where the page goes on."""
        if self._none.get(f"</{name}"):
            return len(self.page), len(self.page)
        found = re.compile(rf"</{re.escape(name)}(?![\w:-])", re.I).search(self.page, self.at)
        if not found:
            self._none[f"</{name}"] = True
            return len(self.page), len(self.page)
        return found.start(), self._past(">", found.end())

    def tags(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before it, name, whether it closes, attributes) of every tag.

        Comments, declarations and a tag that the page's end leaves open have no name. The text
        after the last tag comes with an empty name.
        """
        page, told = self.page, 0
        while (lt := page.find("<", self.at)) >= 0:
            name = None
            if page.startswith("<!--", lt):
                at = self._past("-->", lt + 4)
            elif page.startswith("<![CDATA[", lt):
                at = self._past("]]>", lt + 9)
            elif page.startswith(("<!", "<?"), lt):
                at = self._past(">", lt + 2)
            else:
                closing = page.startswith("/", lt + 1)
                name = _NAME.match(page, lt + 1 + closing)
                if not name:
                    self.at = lt + 1  # a plain <
                    continue
                end = self._tag_end(name.end())
                at = min(end + 1, len(page))
            text, self.at = page[told:lt], at
            if name and end < len(page):
                yield text, name[0].lower(), closing, page[name.end():end]
            else:
                yield text, "", False, ""
            told = self.at
        yield page[told:], "", False, ""


class _Open:
    """Open elements, innermost last."""

    def __init__(self):
        self._names: list[str] = []
        self._count: Counter = Counter()

    def __bool__(self) -> bool:
        return bool(self._names)

    def push(self, name: str) -> None:
        self._names.append(name)
        self._count[name] += 1

    def holds(self, name: str) -> bool:
        return self._count[name] > 0

    def close(self, name: str) -> None:
        """Close the innermost ``name`` and all in it."""
        while self._names:
            last = self._names.pop()
            self._count[last] -= 1
            if last == name:
                break

    def clear(self) -> None:
        self._names.clear()
        self._count.clear()


def lines_of(page: str) -> list[_Line]:
    """The page's blocks in order, each with what is known about its place."""
    lines = [_Line(False, False)]
    dropped = _Open()  # from the outermost dropped element on
    named = _Open()  # from the outermost element named as the article on
    article = linked = 0

    def fresh() -> None:
        if lines[-1].parts:
            lines.append(_Line(article > 0, bool(dropped), bool(named)))
        else:
            lines[-1].inside, lines[-1].dropped = article > 0, bool(dropped)
            lines[-1].named = bool(named)

    def say(text: str) -> None:
        if text:
            lines[-1].parts.append(text)
            if linked:
                lines[-1].linked += len(text.strip())

    scan = _Scanner(page)
    for text, name, closing, attributes in scan.tags():
        say(text)
        if not name:
            continue
        if name == "xmp" and not closing:  # plain text up to its end
            fresh()
            end, after = scan.raw_end(name)
            say(html.escape(page[scan.at:end]))
            scan.at = after
            fresh()
            continue
        if name in RAW and not (name == "svg" and article):
            if not closing and not attributes.endswith("/"):
                scan.at = scan.raw_end(name)[1]
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            linked = 0 if closing else 1
        if name in INLINE:
            continue
        if closing:
            if dropped.holds(name):
                dropped.close(name)
            elif name in ("article", "main") and article and not dropped:
                article -= 1
                linked = 0
            elif named.holds(name) and not dropped:
                named.close(name)
        else:
            values = _read(attributes) if attributes else {}
            main = name in ("article", "main")
            # headings and blocks of the article have ids after their subject
            marks = _marks(values, name == "article" or not (article or name in HEADINGS))
            if article and name != "article":
                marks &= INNER_MARKS
            marked = bool(marks) and name not in ("body", "html", "article", "main")
            if name == "article" and marks & {"comment", "comments", "reply", "promo", "ad"}:
                marked, main = True, False
            if main and dropped:
                dropped.clear()  # an unclosed container does not swallow the article
            if dropped:
                if name not in VOID:
                    dropped.push(name)
            elif (marked or name in DROP or (name == "header" and not article)
                  or (name not in ("html", "body") and _hidden(values))):
                if name not in VOID:
                    dropped.push(name)
            elif main:
                article += 1
                linked = 0
            elif name not in VOID and (named or (name not in ("body", "html")
                                                 and _article_named(values))):
                named.push(name)
        fresh()
    return lines


def _sums(values: list[int], window: int) -> list[int]:
    """Sums over the window around each value."""
    total = [0]
    for value in values:
        total.append(total[-1] + value)
    n, half = len(values), window // 2
    return [total[min(n, k + half + 1)] - total[max(0, k - half)] for k in range(n)]


def surging(lengths: list[int], linked: list[int], window: int, surge: float,
            link_share: float) -> list[bool]:
    """Whether a line is kept, by the distribution of text over the lines.

    A line that is links for more than ``link_share`` counts as zero unless it stands between
    two lines that are not: menus are several such lines, or stand at an end. The distribution
    surges at the first window sum of at least ``surge`` times the largest one and dives after
    the last such; zero lines between stay out.
    """
    there = [k for k, length in enumerate(lengths) if length]
    links = [linked[k] > link_share * lengths[k] for k in there]
    own = list(lengths)
    for place, k in enumerate(there):
        if links[place] and (place in (0, len(there) - 1) or links[place - 1] or links[place + 1]):
            own[k] = 0
    sums = _sums(own, window)
    least = max(1, surge * max(sums, default=0))
    high = [k for k, total in enumerate(sums) if total >= least and own[k]]
    if not high:
        return [False] * len(own)
    return [high[0] <= k <= high[-1] and own[k] > 0 for k in range(len(own))]


def extract(page: str | None, window: int = WINDOW, surge: float = SURGE,
            link_share: float = LINK_SHARE) -> str:
    """Main text of one page; an empty text if there is none."""
    lines = lines_of(page or "")
    marked = any(line.inside and not line.dropped for line in lines)
    if not marked:
        every = sum(len(line.text()) for line in lines if not line.dropped)
        own = sum(len(line.text()) for line in lines if line.named and not line.dropped)
        if own and 2 * own >= every:
            marked = True
            for line in lines:
                line.inside = line.named
    if marked:
        texts = [line.text() for line in lines if line.inside and not line.dropped]
        return "\n".join(t for t in texts if t)
    texts = ["" if line.dropped else line.text() for line in lines]
    # a line without a letter or digit has no text to speak of
    lengths = [len(t) if any(c.isalnum() for c in t) else 0 for t in texts]
    linked = [min(line.linked, n) for line, n in zip(lines, lengths, strict=True)]
    held = surging(lengths, linked, window, surge, link_share)
    kept = [k for k, stays in enumerate(held) if stays]
    if not kept:
        return ""
    return "\n".join(t for k, t in enumerate(texts) if t and kept[0] <= k <= kept[-1]
                     and (held[k] or not lengths[k]))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without a main text, have an empty text. Unclosed and
    stray tags are tolerated; whole pages are read however long. Repeated rows are extracted
    each on their own; an empty table gives no rows.
    """
    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(p, window, surge) for p in part], dtype=object)

    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        main_text(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op8_html_text(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
