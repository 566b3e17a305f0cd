"""Main-text extraction by line-block distribution.

Markup is stripped to a sequence of lines, one for each block of the page; scripts, styles, forms, menus and other
boilerplate elements (by tag, role, class or id) count as empty lines, whose text is not kept. The block distribution
sums text lengths over sliding windows of ``window`` lines. A surge point is where the distribution rises from
nothing, a dive point where it falls back to nothing; text between them is one region. Pages that mark their content
(``article`` or ``main``) are measured inside the marked lines, with everything else empty, and keep all their regions;
on other pages the region with most text stays, and with it regions in the same container (the innermost element of
more than one line that holds over half of that region's text) and regions of at least ``share`` of its text; a line
whose text is mostly links counts as empty there too.

One pass of Arrow batches, no shuffle. The parser is one regular expression for markup and one for each kind of skipped
element, linear in the html's length, and never fails on broken markup.

Defined results: null or empty html, or no text: empty string, 0 characters. Repeated pages each give a row. Extra
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

#: Markup: comments, declarations, tags; an unclosed one runs to the end.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements skipped with their content, up to the first end tag; without one only script and style run to the end.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript textarea iframe title".split()}
#: The same for elements that may hold others of their name, up to their own end tag.
_NESTED = {
    name: re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>{name})(?![\w:-])(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
    for name in "svg object canvas template select annotation annotation-xml".split()
}
#: Of these a slash closes the start tag.
_FOREIGN = frozenset({"svg", "math", "annotation", "annotation-xml"})
#: What a head may hold; anything else ends it.
_IN_HEAD = frozenset("title base basefont bgsound link meta script style noscript template".split())
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Elements that do not break a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mfenced mpadded mphantom mtable mtr mtd semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset input label option audio video".split())
#: Words in class, id or role that mark boilerplate.
_STRONG = (
    r"ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side-bar|aside|widget|widgets|footer|"
    r"header|masthead|topbar|site-header|page-header|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|related|recommended|recommendations|comment|comments|disqus|respond|replies|reply|"
    r"pagination|pager|copyright|disclaimer|skip-link|toolbar|complementary|contentinfo"
)
#: Words that also name subjects: they mark boilerplate only beside words of the layout.
_WEAK = r"legal|social|search|discussion|form|foot|skip|rail"
_WORDS = rf"(?:{_STRONG}|{_WEAK})"
_MARKS = re.compile(rf"(?:^|[\s_-])(?:{_STRONG})(?:$|[\s_-])", re.I)
#: Words that an id, or a class with a weak word, may hold beside those; with any other word it names a subject.
_BESIDE = r"(?:main|site|page|top|bottom|left|right|primary|secondary|global|inner|outer|container|wrapper|wrap|bar|box|area|block|list|links|link|icons|buttons|media|info|posts|articles|section|\d+)"
_ID_MARKS = re.compile(rf"(?:{_BESIDE}[_-])*{_WORDS}(?:[_-](?:{_WORDS}|{_BESIDE}))*", re.I)
#: Sections and headings of marked content are content, but for readers' replies.
_PARTS = frozenset("section h1 h2 h3 h4 h5 h6".split())
_REPLIES = re.compile(r"(?:comments?|disqus|respond)", re.I)
_FORM_OR_CONTENT = re.compile(r"(?P<form></form\s*>)|<(?:article|main)(?![\w:-])", re.I)
#: Elements that hold several blocks.
_CONTAINERS = frozenset("div section td th center".split())
_SPACE = re.compile(r"\s+")
CONTENT = frozenset({"article", "main"})
#: A new block of these closes an open paragraph.
_CLOSES_P = frozenset("p div ul ol dl table article section h1 h2 h3 h4 h5 h6 blockquote pre main header footer nav aside form hr".split())


#: Prefixes of layout switches, which say nothing about the element's own text.
_SWITCH = ("has-", "no-", "with-", "without-", "is-", "js-")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADING = re.compile(r"header|masthead|banner", re.I)


def _marked(value: str, inside: bool) -> bool:
    """Whether a class, id or role marks boilerplate; the heading of marked content is content."""
    for token in _CAMEL.sub("-", value).split():
        if token.lower().startswith(_SWITCH):
            continue
        if (m := _MARKS.search(token) or _ID_MARKS.fullmatch(token)) and not (inside and _HEADING.search(m[0])):
            return True
    return False


def _boilerplate(name: str, key: str, value: str, inside: bool) -> bool:
    """Whether an attribute marks its element as boilerplate."""
    if key == "role":
        return _marked(value, inside)
    if inside and name in _PARTS:
        return key in ("id", "class") and any(_REPLIES.fullmatch(x) for x in value.split())
    if key == "id":
        token = _CAMEL.sub("-", value.strip())
        return name not in _PARTS - {"section"} and not token.lower().startswith(_SWITCH) and bool(_ID_MARKS.fullmatch(token)) and _marked(value, inside)
    return key in ("class", "aria-label") and _marked(value, inside)


class Line:
    __slots__ = ("text", "links", "inside", "node")

    def __init__(self, text: str, links: int, inside: bool, node: int = 0):
        self.text, self.links, self.inside, self.node = text, links, inside, node


class Ends:
    """Where elements skipped with their content end."""

    def __init__(self, page: str):
        self.page, self.nested, self.none, self.forms = page, {}, set(), True

    def form_of_page(self, stop: int) -> bool:
        """Whether the form opened before ``stop`` is one that a server wraps around the page: content begins in it."""
        found = self.forms and _FORM_OR_CONTENT.search(self.page, stop)
        self.forms = bool(found)
        return bool(found) and not found["form"]

    def after(self, name: str, start: int, stop: int) -> int:
        """The end of the element whose start tag is at [start, stop); ``stop`` where only the tag is skipped."""
        if name in _NESTED:
            if name not in self.nested:
                self.nested[name] = self._pairs(name)
            return self.nested[name].get(start, stop)
        # Once an end tag is missing it is for the rest of the page: every search pays for itself.
        found = None if name in self.none else _RAW[name].search(self.page, stop)
        if found:
            return found.end()
        self.none.add(name)
        return len(self.page) if name in ("script", "style") else stop

    def _pairs(self, name: str) -> dict[int, int]:
        out, starts = {}, []
        for m in _NESTED[name].finditer(self.page):
            if m["close"]:
                if starts:
                    out[starts.pop()] = m.end()
            elif m["name"] and not (name in _FOREIGN and m["attrs"].endswith("/")):
                starts.append(m.start())
        return out


def lines_of(page: str) -> tuple[list[Line], bool, list[int]]:
    """The page's lines, boilerplate as empty lines, whether the page marks its content, and the parent of each container.

    Container 0 is the page; a container has a higher number than its parent.
    """
    out: list[Line] = []
    parts: list[str] = []
    links = depth_a = 0
    stack: list[tuple[str, bool, bool, int]] = []  # (name, boilerplate, content, the container around)
    parents, node = [0], 0
    skip = inside = 0
    marked = False

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Line(text, links, inside > 0, node))
        links = 0

    def leave(n: int) -> None:
        nonlocal skip, inside, depth_a, node
        while len(stack) > n:
            name, b, c, node = stack.pop()
            skip -= b
            inside -= c
            depth_a -= name == "a"

    at = 0
    ends = Ends(page)
    head = False
    while m := _MARKUP.search(page, at):
        piece = page[at : m.start()]
        head = head and not piece.strip()
        if piece and not skip and not head:
            parts.append(piece)
            if depth_a:
                links += len(piece.strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if head:
            if m["close"]:
                head = name not in ("head", "body", "html")
                continue
            if name in _IN_HEAD:
                if name in _RAW or name in _NESTED:
                    at = ends.after(name, m.start(), at)
                continue
            head = False
        if not m["close"] and (name == "head" or name != "title" and name in _RAW or name in _NESTED):
            if name not in INLINE:
                flush()
            if name == "head":
                head = True
            elif not (name in _FOREIGN and m["attrs"].endswith("/")):
                at = ends.after(name, m.start(), at)
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1]:
                        flush()
                        out.append(Line("", 0, False))
                    leave(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    leave(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name == "li" or name in ("td", "th", "tr", "dt", "dd", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl"):
                    break
        attrs = m["attrs"]
        content = name in CONTENT
        boilerplate = name in BOILERPLATE or (name == "header" and not inside)
        if name == "form" and not inside and ends.form_of_page(m.end()):
            boilerplate = False
        if attrs and not boilerplate:
            values = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs)]
            named = dict(reversed(values))
            if any(k == "role" and v.lower() == "main" or k == "itemprop" and v.lower() == "articlebody" for k, v in values):
                content = True
            elif not content and name not in ("html", "body") and any(_boilerplate(name, k, v, inside > 0) for k, v in values):
                boilerplate = True
            if "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(named.get("style", "")):
                boilerplate = True
        if attrs.endswith("/") and not inline:
            continue
        if boilerplate:
            flush()
            out.append(Line("", 0, False))
        marked |= content and not skip
        stack.append((name, boilerplate, content, node))
        if name in _CONTAINERS:
            parents.append(node)
            node = len(parents) - 1
        skip += boilerplate
        inside += content
        depth_a += name == "a"
    if at < len(page) and not skip:
        parts.append(page[at:])
    flush()
    return out, marked, parents


def regions(lengths: np.ndarray, window: int = 3) -> list[tuple[int, int]]:
    """[surge, dive) stretches of the block distribution: sums over ``window`` lines from each line on."""
    if not len(lengths):
        return []
    sums = np.concatenate([[0], np.cumsum(lengths)])
    blocks = sums[np.minimum(np.arange(len(lengths)) + window, len(lengths))] - sums[:-1]
    up = np.concatenate([[False], blocks > 0, [False]])
    surge, dive = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    return list(zip(surge.tolist(), dive.tolist(), strict=True))


def in_container(lines: list[Line], lengths: np.ndarray, parents: list[int], a: int, b: int) -> np.ndarray:
    """Whether each line lies in the container of the lines [a, b); in the page itself only what no container holds."""
    text, count = [0] * len(parents), [0] * len(parents)
    for i, x in enumerate(lines):
        if lengths[i]:
            count[x.node] += 1
            text[x.node] += int(lengths[i]) * (a <= i < b)
    half = sum(text) / 2
    for k in range(len(parents) - 1, 0, -1):
        text[parents[k]] += text[k]
        count[parents[k]] += count[k]
    # Containers with over half of a text hold each other, the innermost has the highest number.
    best = max((k for k in range(1, len(parents)) if text[k] > half and count[k] > 1), default=0)
    within = [k == best for k in range(len(parents))]
    for k in range(best + 1, len(parents)):
        within[k] = best > 0 and within[parents[k]]
    return np.array([within[x.node] for x in lines], bool)


def main_text(page: str | None, window: int = 3, share: float = 0.25, max_link_share: float = 0.5) -> str:
    if not page:
        return ""
    lines, marked, parents = lines_of(page)
    if marked:
        lengths = np.array([len(x.text) if x.inside else 0 for x in lines], np.int64)
        kept = regions(lengths, window)
        keep = [lines[i].text for a, b in kept for i in range(a, b) if lengths[i]]
        return " ".join(keep)
    lengths = np.array([len(x.text) if x.links <= max_link_share * len(x.text) else 0 for x in lines], np.int64)
    found = regions(lengths, window)
    weight = [int(lengths[a:b].sum()) for a, b in found]
    if not weight:
        return ""
    beside = in_container(lines, lengths, parents, *found[int(np.argmax(weight))]) & (lengths > 0)
    keep = [lines[i].text for (a, b), w in zip(found, weight, strict=True) if w >= share * max(weight) or beside[a:b].any() for i in range(a, b) if lengths[i]]
    return " ".join(keep)


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
