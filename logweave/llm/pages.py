"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Elements that stay inside a line of text; all others begin a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav aside footer form button select dialog menu template svg math canvas object audio video head fieldset datalist".split())
#: Roles and words of a class or id that mark menus, headers, notices, adverts, forms and comments.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead
    cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond
    share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright skip""".split()
)
#: Words that mark a page's header, unless it is the header of an article; words before a mark that make it a layout.
HEADER = frozenset("header topbar".split())
LAYOUT = frozenset("has with no without".split())
#: Headings above reader comments.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|leser|all)[\s-]*)?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)?:?|leave a (?:reply|comment)", re.IGNORECASE)
#: Which open elements the start of another one ends, up to which.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Smoothing over neighbouring blocks, share of the largest ratio from which a path holds content, share of a page's content that its container holds.
KERNEL = np.array([0.25, 0.5, 0.25])
LEAST, WHOLE = 0.1, 0.9
#: A block of another path with more than this share of its text in links is a list of links.
LINKS = 0.6

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|\d+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：«»“”„]")


def _tags(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of each piece of markup: text, and the start and end of elements with their attributes. Every character is looked at a bounded number of times."""
    at, size, lost = 0, len(text), set()
    while at < size:
        open_ = text.find("<", at)
        if open_ < 0:
            yield "text", "", text[at:]
            return
        if open_ > at:
            yield "text", "", text[at:open_]
        after = text[open_ + 1 : open_ + 2]
        if text.startswith("<!--", open_):
            end = text.find("-->", open_ + 2)
            at = size if end < 0 else end + 3
            continue
        start = open_ + 1 + (after == "/")
        name = _NAME.match(text, start)
        if name is None:
            if after and after in "!?/":
                end = text.find(">", open_)
                at = size if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = open_ + 1
            continue
        end = at = name.end()
        # The tag ends at the first > that no quoted value holds; a quote that is never closed is a plain character.
        while True:
            end = text.find(">", end)
            if end < 0:
                return
            inner = text[at:end]
            quote = min((q for q in "\"'" if q in inner and q not in lost), key=inner.find, default=None)
            if quote is None:
                break
            close = text.find(quote, at + inner.find(quote) + 1)
            if close < 0:
                lost.add(quote)
                end = at
            elif close > end:
                at = end = close + 1
            else:
                at = close + 1
                end = at
        rest = text[name.end() : end]
        low = name[0].lower()
        at = end + 1
        if after == "/":
            yield "end", low, ""
            continue
        yield "start", low, rest
        if low in RAW and not rest.endswith("/"):
            close = _RAW_END[low].search(text, at)
            at = size if close is None else close.start()


def _outside(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is none of an article's, by its name, role, class and id."""
    if name in OUTSIDE or name in RAW:
        return True
    if name == "header" and not in_article:
        return True
    if not rest or name in ("html", "body", "main", "article"):
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = [x.lower() for x in _WORD.findall(word)]
                for before, part in zip([""] + parts, parts):
                    if part in MARKS and before not in LAYOUT or part in HEADER and not in_article and name not in _HEADING:
                        return True
    return False


class _Page:
    """Blocks of a page in order: text, path, punctuation, characters in links, heading level and the open elements' numbers."""

    def __init__(self, text: str) -> None:
        self.texts: list[str] = []
        self.paths: list[int] = []
        self.links: list[int] = []
        self.elements: list[int] = []
        self.names = ["#"]
        self.parents = [-1]
        self.path_of: dict[tuple[int, str], int] = {}
        self._stack = [(0, "#", 0, False)]
        self._open: dict[str, int] = {}
        self._run: list[str] = []
        self._linked = 0
        self._ended: set[int] = set()
        for kind, name, rest in _tags(text):
            if kind == "text":
                if not self._stack[-1][3]:
                    self._run.append(html.unescape(rest))
                    if self._open.get("a"):
                        self._linked += len(rest.strip())
            elif kind == "start":
                self._start(name, rest)
            else:
                self._end(name)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        self._run.clear()
        linked, self._linked = self._linked, 0
        if not text:
            return
        i = len(self._stack) - 1
        while self._stack[i][1] in INLINE:
            i -= 1
        element, name, path, out = self._stack[i]
        parent = self.parents[element]
        if out or parent in self._ended:
            return
        if (name in _HEADING or name in ("p", "strong")) and COMMENTS.fullmatch(text):
            self._ended.add(parent)
            return
        self.texts.append(text)
        self.paths.append(path)
        self.links.append(min(linked, len(text)))
        self.elements.append(element)

    def _pop(self) -> None:
        _, name, _, _ = self._stack.pop()
        self._open[name] -= 1

    def _close(self, names: tuple, stop: tuple) -> None:
        """End the innermost open element of the given names, and what it holds, unless one to stop at is met first."""
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i][1]
            if name in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if name in stop:
                return

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._run.append(" ")
            return
        if name not in INLINE:
            self._flush()
            if self._open.get("p"):
                self._close(("p",), ("td", "th", "table", "object", "template", "button"))
        names, stop = CLOSES.get(name, ((), ()))
        if any(self._open.get(x) for x in names):
            self._close(names, stop)
            if name in ("tr", "tbody", "thead", "tfoot"):
                for x in names[1:]:
                    if self._open.get(x):
                        self._close((x,), stop)
        if name in VOID:
            return
        top, _, path, out = self._stack[-1]
        out = out or top in self._ended or _outside(name, rest, bool(self._open.get("article") or self._open.get("main")))
        element = len(self.names)
        self.names.append(name)
        self.parents.append(top)
        path = path if name in INLINE else self.path_of.setdefault((path, name), len(self.path_of) + 1)
        self._stack.append((element, name, path, out))
        self._open[name] = self._open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        if self._open.get(name):
            while self._stack[-1][1] != name:
                self._pop()
            self._pop()


def _content(page: _Page) -> np.ndarray:
    """Which blocks lie on paths of content: the ratios of text and of punctuation to the nodes of a path, smoothed over the page, fused, and held against the largest."""
    paths = np.array(page.paths)
    length = np.array([len(t) for t in page.texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.texts], float)
    free = length - np.array(page.links)
    nodes = np.bincount(paths)
    ratio = lambda x: (np.bincount(paths, x) / np.maximum(nodes, 1))[paths]
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), KERNEL, "valid")
    fused = smooth(ratio(free)) * (1 + smooth(ratio(marks)))
    score = (np.bincount(paths, fused * free) / np.maximum(np.bincount(paths, free), 1))[paths]
    return (score >= LEAST * score.max()) & (free > 0)


def _container(page: _Page, content: np.ndarray) -> int:
    """The element that an article is in: the article or main element with most content, or else the innermost one with nearly all of it."""
    weight: dict[int, int] = {}
    for i in np.flatnonzero(content):
        element = page.elements[i]
        weight[element] = weight.get(element, 0) + len(page.texts[i])
    # Parents come before their children.
    for element in range(len(page.names) - 1, 0, -1):
        if element in weight:
            parent = page.parents[element]
            weight[parent] = weight.get(parent, 0) + weight[element]
    for name in ("article", "main"):
        named = [(n, -e) for e, n in weight.items() if page.names[e] == name]
        if named and max(named)[0] * 2 > weight[0]:
            return -max(named)[1]
    best = 0
    for element, n in sorted(weight.items()):
        if n >= WHOLE * weight[0] and page.names[element] not in ("p", *_HEADING, *INLINE):
            best = element
    return best


def main_text(text: str | None) -> str:
    """The main text of one page, blocks joined by two line feeds; empty without any.

    Blocks are the runs of text between block elements, with white space as one space. Those of menus, footers, forms and the like are
    set aside by element, role, class and id. Among the others, paths of tags are scored by the length and the punctuation
    of their text in proportion to their nodes. The article is what lies in the element that holds the content so found, its headings and short blocks
    too, but for lists of links; a first heading before that element belongs to it.
    """
    page = _Page(text or "")
    if not page.texts:
        return ""
    content = _content(page)
    if not content.any():
        return ""
    top = _container(page, content)
    inside = np.zeros(len(page.names), bool)
    inside[top] = True
    for element in range(top + 1, len(page.names)):
        inside[element] = inside[page.parents[element]]
    held = [i for i, e in enumerate(page.elements) if inside[e] and (content[i] or page.links[i] <= LINKS * len(page.texts[i]))]
    titles = [i for i, e in enumerate(page.elements) if page.names[e] == "h1"]
    if held and len(titles) == 1 and titles[0] < held[0]:
        held = titles + held
    return "\n\n".join(page.texts[i] for i in held)


def extract_text(pages: DataFrame, html_col: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """pages with the main text of each and its number of code points; a column of either name that pages bring is replaced.

    Each page is read whole, however long, by itself: no shuffle. Null and empty pages, and those without any content, have an empty text; repeated rows get
    equal texts, an empty table stays empty. Null ids and other columns stay.
    """
    kept = pages.drop(*names).withColumn("__lw_html", F.col(html_col).cast("string"))
    schema = kept.drop("__lw_html").schema.add(names[0], "string").add(names[1], "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__lw_html"):
                texts = [main_text(t) for t in part.column("__lw_html").to_pylist()]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[:-1], *names])

    return kept.mapInArrow(run, schema)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
