"""HTML extraction by tree scoring.

A page is parsed into blocks of text that hang in a tree of elements.  Each
paragraph scores points for its length and its commas, and passes them up to its
ancestors, less the higher it goes.  A container's score is discounted by the
share of its text that stands in links.  The best container is kept, and with it
those siblings that score well, read like prose or carry on what do; what belongs
to navigation, forms, notices, adverts or comments never counts.

What readers wrote is told by more than names: an article inside an article, and
elements of one shape, side by side, that bear the marks of an author or a reply.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm import tokens

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
NEVER = frozenset("head nav aside header footer form button dialog menu".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre search section summary table tbody td tfoot th thead tr ul".split()
) | NEVER
# Elements that hold paragraphs, and so can be a container.
BOXES = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt td th tr figcaption caption legend summary hr blockquote address center".split())
# Elements that an opening tag of the given kind closes, if they are open and nothing in the scope stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th div article section main ul ol dl blockquote aside nav header footer form".split())
# Words in class, id or role that mark boilerplate.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget toolbar masthead header footer copyright comment comments commentlist disqus respond reply replies discussion "
    "related recommended share sharing social tags pagination pager skip hidden search complementary contentinfo dialog form".split()
)
# Those of them that also name what an article is about; there a section of that name is content, if it has a heading and reads like prose.
AMBIGUOUS = frozenset("discussion search sharing tags copyright widget toolbar".split())
# Words in class, id, rel or itemprop that mark who wrote something and when.
MARKS = frozenset("author user username nickname avatar reply replies replied responder timestamp posted karma upvote upvotes downvote likes".split())
# What stands alone in a block below what a reader wrote, or heads such blocks.
_REPLY = re.compile(r"(?i)(?:reply|reply to this|report|like|share|permalink|antworten|répondre|responder)(?:\s*[(|\xb7\u00b7]?\s*\d*\)?)?")
_THREAD_HEAD = re.compile(r"(?i)(?:(?:\d+\s+)?(?:reader |all |user )?(?:comments?|replies|kommentare|commentaires|comentarios)|\d+\s+(?:responses?|réponses?|antworten|respuestas))(?:\s*[(:]?\s*\d*\)?)?")
# A line that says who wrote what follows, or when.
_BYLINE = re.compile(r"(?i)\bago\b|\b(?:says|said|wrote|writes|posted)\b|\b\d{1,2}:\d{2}\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}\b|^@\w+$")
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIKELY = frozenset("article articlebody post entry content story main body".split())
# A name with one of these in front tells of the page's layout, not of the element.
LAYOUT = ("has", "with", "no", "without")

_COMMENT = re.compile(r"<!--(?:.*?(?:-->|--!>)|.*\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.S)
# Where quotes don't pair up, a tag ends at the next bracket.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s\xa0]+")


class _Element:
    __slots__ = ("tag", "parent", "dead", "score", "chars", "link_chars", "first", "last", "depth", "likely", "inside", "fresh", "passed", "shape", "doubt", "marked", "heads", "longest")

    def __init__(self, tag: str, parent: _Element | None, first: int, name: _Name):
        self.tag, self.parent, self.likely, self.doubt, self.marked = tag, parent, name.likely, name.doubt, name.marked
        self.dead = name.dead or parent is not None and parent.dead
        #: Elements of one shape are made alike: tag and class.
        self.shape = (tag, name.classes)
        #: Headings inside, and characters of the longest other block.
        self.heads = self.longest = 0
        self.score = 0.0
        #: Whether it is an article or main, or inside one.
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        #: Points that no container has had yet, and those that come from one.
        self.fresh = self.passed = 0.0
        self.chars = self.link_chars = 0
        #: Blocks from first up to last are inside.
        self.first = self.last = first
        self.depth = parent.depth + 1 if parent else 0


class _Name:
    """What an element's tag and attributes say of it."""

    __slots__ = ("dead", "likely", "doubt", "marked", "classes")

    def __init__(self, tag: str, attributes: str, inside: bool):
        """Inside an article its own header is content, and a section may have a name that means something else there."""
        self.dead = tag in NEVER and not (inside and tag == "header")
        self.likely = tag in ("main", "article")
        self.doubt, self.marked, self.classes = False, tag == "time" and not inside, ""
        if self.dead or not attributes:
            return
        names, hidden = [], False
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                names.append(value)
                if key == "class":
                    self.classes = " ".join(sorted(value.split()))
            elif key in ("rel", "itemprop"):
                self.marked |= not MARKS.isdisjoint(value.split())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        if tag in ("html", "body", "main", "article"):
            return
        words = [re.split(r"[_-]+", x) for x in " ".join(names).split()]
        self.marked |= any(not MARKS.isdisjoint(w) for w in words)
        words = [w for w in words if w[0] not in LAYOUT]
        bad = UNLIKELY.intersection(x for w in words for x in w)
        if inside and tag == "section":
            self.doubt = bool(bad) and bad <= AMBIGUOUS
        elif inside and tag == "header":
            bad -= {"header", "masthead"}
        self.dead = hidden or bool(bad) and not self.doubt
        self.likely = any(not LIKELY.isdisjoint(w) for w in words)


class _Page:
    def __init__(self) -> None:
        self.root = _Element("#root", None, 0, _Name("#root", "", False))
        self.elements = [self.root]
        self.stack = [self.root]
        self.blocks: list[tuple[str, int, _Element]] = []
        self.held: list[tuple[str, bool]] = []
        self.links = 0
        #: How many elements of each kind are open.
        self.opened: Counter[str] = Counter()

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].dead:
            self.held.append((html.unescape(raw) if "&" in raw else raw, self.links > 0))

    def flush(self) -> None:
        """End a block of text."""
        if not self.held:
            return
        text = _SPACE.sub(" ", "".join(t for t, _ in self.held)).strip()
        linked = sum(len(_SPACE.sub(" ", t).strip()) for t, link in self.held if link)
        self.held = []
        if text:
            self.blocks.append((text, min(linked, len(text)), self.stack[-1]))

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.held and self.held.append((" ", self.links > 0))
            return
        if tag in BLOCK:
            self.flush()
            self.close("p", implied=True)
        for other in CLOSES.get(tag, ()):
            self.close(other, implied=True)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            return
        if tag == "a":
            self.links += 1
        parent = self.stack[-1]
        element = _Element(tag, parent, len(self.blocks), _Name(tag, attributes, parent.inside))
        self.elements.append(element)
        self.stack.append(element)
        self.opened[tag] += 1

    def close(self, tag: str, implied: bool = False) -> None:
        if not self.opened[tag]:
            if tag == "p" and not implied:
                self.flush()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                break
            if implied and self.stack[k].tag in SCOPES:
                return
        for element in reversed(self.stack[k:]):
            if element.tag in BLOCK:
                self.flush()
            if element.tag == "a":
                self.links = max(0, self.links - 1)
            self.stack.pop()
            self.opened[element.tag] -= 1
            element.last = len(self.blocks)

    def end(self) -> None:
        self.flush()
        while self.stack:
            self.stack.pop().last = len(self.blocks)


def parse(page: str) -> _Page:
    """The page's blocks and elements, in one pass over the text."""
    out = _Page()
    at = 0
    low = None
    last = page.rfind(">")
    tag_of, plain = _TAG, False
    cdata = page.rfind("]]>")
    while (start := page.find("<", at)) >= 0:
        head = page[start + 1 : start + 3]
        if not (head[:1] in "!?" or head.lstrip("/")[:1].isascii() and head.lstrip("/")[:1].isalpha()) or head == "//" or not head:
            # no markup, but a bracket in the text
            out.text(page[at : start + 1])
            at = start + 1
            continue
        out.text(page[at:start])
        if page.startswith("<!--", start):
            at = _COMMENT.match(page, start).end()
            continue
        if start > last:
            # a tag that never ends is no text
            at = len(page)
            break
        if head[0] in "!?":
            if page.startswith("<![CDATA[", start) and start < cdata:
                at = page.find("]]>", start)
                out.text(page[start + 9 : at])
                at += 3
            else:
                at = page.find(">", start) + 1
            continue
        m = tag_of.match(page, start)
        if m is None and not plain:
            tag_of, plain = _PLAIN_TAG, True
            m = tag_of.match(page, start)
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            out.close(tag)
        elif tag in RAW and not m[3].endswith("/"):
            if low is None:
                low = page.lower()
                if len(low) != len(page):
                    low = page.translate(_ASCII_LOWER)
            stop = low.find(f"</{tag}", at)
            end = page.find(">", stop) if stop >= 0 else -1
            at = end + 1 if end >= 0 else len(page)
        else:
            out.open(tag, m[3])
    out.text(page[at:])
    out.end()
    return out


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _measure(page: _Page) -> None:
    """Characters, headings, and marks of each element with all inside it; in one pass from the last element to the first."""
    for text, linked, element in page.blocks:
        element.chars += len(text)
        element.link_chars += linked
        if element.tag in HEADS:
            # an author's name is no heading of what follows
            element.heads += not element.marked
        else:
            element.longest = max(element.longest, len(text))
        if len(text) < 30 and _REPLY.fullmatch(text):
            element.marked = True
    for e in reversed(page.elements):
        if (up := e.parent) is not None:
            up.chars += e.chars
            up.link_chars += e.link_chars
            up.heads += e.heads
            up.longest = max(up.longest, e.longest)
            up.marked |= e.marked


def _kin(page: _Page) -> dict[tuple[int, tuple[str, str]], list[_Element]]:
    """Elements with text by their parent and shape."""
    kin: dict[tuple[int, tuple[str, str]], list[_Element]] = {}
    for e in page.elements[1:]:
        if not e.dead and e.first < e.last and e.tag in BLOCK:
            kin.setdefault((id(e.parent), e.shape), []).append(e)
    return kin


def _byline(page: _Page, e: _Element) -> bool:
    """Whether an element starts with a line that says who wrote it or when: a short block that is no heading, with a longer one behind it."""
    if e.last - e.first < 2:
        return False
    (head, _, of), (body, _, _) = page.blocks[e.first], page.blocks[e.first + 1]
    return of.tag not in HEADS and len(head) <= 40 and len(body) > len(head) and _BYLINE.search(head) is not None


def _threads(page: _Page) -> list[_Element]:
    """What readers wrote, as far as no name tells of it: elements of one shape with marks, or below a heading that says so."""
    out = []
    for alike in _kin(page).values():
        up = alike[0].parent
        if up.tag in ("tr", "table", "tbody", "ul", "ol", "dl") and alike[0].tag not in ("li", "dd", "dt") or alike[0].tag in ("p", "td", "th", "dt", "dd") or alike[0].tag in HEADS:
            continue
        # a mark stands beside what was written; one block with a mark in it is, say, an entry of a bibliography
        marked = sum(e.marked and e.heads == 0 and e.last - e.first > 1 for e in alike)
        named = sum(e.heads == 0 and _byline(page, e) for e in alike)
        before = page.blocks[alike[0].first - 1] if alike[0].first else None
        headed = before is not None and before[2].tag in HEADS and _THREAD_HEAD.fullmatch(before[0]) is not None
        if headed or len(alike) > 1 and (3 * marked >= 2 * len(alike) or len(alike) > 2 and 3 * named >= 2 * len(alike)):
            out += alike
            if headed:
                out.append(before[2])
            # what else the list of them says is a heading or a button
            rest = up.chars - sum(e.chars for e in alike)
            if up.tag not in ("#root", "html", "body", "main", "article") and rest < 100 and up.longest <= max(e.longest for e in alike):
                out.append(up)
    return out


def _unread(page: _Page) -> list[_Element]:
    """Sections of an article whose name leaves in doubt what they are, unless they have a heading and read like prose."""
    return [e for e in page.elements if e.doubt and not (e.heads and not e.marked and e.longest >= 80 and e.link_chars < 0.25 * e.chars)]


def _cut(page: _Page, elements: list[_Element]) -> None:
    """Takes elements out of the page with all inside them."""
    if not elements:
        return
    for e in elements:
        e.dead = True
    for e in page.elements[1:]:
        e.dead |= e.parent.dead


def _score(page: _Page) -> None:
    """Points go to the nearest container whole, and half as many to each element above.

    Elements stand behind those they are in, so one pass from the last to the first hands all of them up.
    """
    for e in page.elements:
        e.chars = e.link_chars = 0
        e.score = e.fresh = e.passed = 0.0
    for text, linked, element in page.blocks:
        if element.dead:
            continue
        element.chars += len(text)
        element.link_chars += linked
        if len(text) >= 25:
            element.fresh += 1 + text.count(",") + min(len(text) / 100, 3)
    for e in reversed(page.elements):
        if e.tag in BOXES or e is page.root:
            e.passed, e.fresh = e.passed + e.fresh, 0.0
        e.score = e.passed
        if e.parent:
            e.parent.chars += e.chars
            e.parent.link_chars += e.link_chars
            e.parent.fresh += e.fresh
            e.parent.passed += e.passed / 2
        if e.chars:
            e.score *= (1 - e.link_chars / e.chars) * (1.5 if e.likely else 1)


def _best(page: _Page) -> _Element:
    boxes = (e for e in page.elements if not e.dead and e.chars and (e.tag in BOXES or e is page.root))
    return max(boxes, key=lambda e: (e.score, -e.depth), default=page.root)


def _article(page: _Page, best: _Element) -> _Element | None:
    """The article that the best container is in, else the main element.

    It is the outermost one, and articles inside it are what readers wrote; but
    one without a paragraph of its own is a wrapper, and stands for the article
    in it that is most of its text, or for all of them.
    """
    around = []
    e: _Element | None = best
    while e is not None:
        if e.tag in ("article", "main"):
            around.append(e)
        e = e.parent
    if best.tag not in ("article", "main") and not around:
        return None
    articles = [e for e in around if e.tag == "article"]
    top = articles[-1] if articles else around[-1] if around else None
    if top is None or top.tag == "main":
        return top
    inner = [e for e in page.elements if e.tag == "article" and not e.dead and e is not top and _inside(e, top)]
    while inner:
        nested = set()
        for e in inner:
            nested.update(range(e.first, e.last))
        if any(i not in nested and len(t) >= 25 and of.tag not in HEADS and not of.dead for i, (t, _, of) in enumerate(page.blocks[top.first : top.last], top.first)):
            _cut(page, inner)
            break
        most = max(inner, key=lambda e: e.chars)
        if 2 * most.chars <= top.chars:
            break
        top = most
        inner = [e for e in inner if e is not top and _inside(e, top)]
    return top


def _inside(e: _Element, outer: _Element) -> bool:
    while e is not None and e.depth >= outer.depth:
        if e is outer:
            return True
        e = e.parent
    return False


def _kept(page: _Page, best: _Element) -> list[_Element]:
    """The best container with those siblings that belong to it."""
    # a container that is all there is of the one around it has its siblings further up
    while best.parent is not None and best.parent.tag not in ("body", "html", "#root") and best.parent.chars == best.chars:
        best = best.parent
    if best.parent is None or best.tag in ("main", "body", "html"):
        return [best]
    limit = max(10.0, best.score * 0.2)
    siblings = [e for e in page.elements if e.parent is best.parent and not e.dead and e.chars]

    def linked(e: _Element) -> bool:
        return e.link_chars >= 0.25 * e.chars

    good = [k for k, e in enumerate(siblings) if e is best or e.score >= limit or e.tag == "p" and e.chars > 80 and not linked(e)]
    shapes = {siblings[k].shape for k in good}

    def goes_on(e: _Element) -> bool:
        """Whether a short sibling is a part like the good ones: made alike, of headings or paragraphs."""
        return not linked(e) and (e.tag in HEADS or e.tag == "p" or e.shape in shapes and (e.shape[1] != "" or e.heads > 0 or e in holders))

    holders = {b.parent for _, _, b in page.blocks if b.tag == "p" and not b.dead}
    first, last = good[0], good[-1]
    while first > 0 and goes_on(siblings[first - 1]):
        first -= 1
    if siblings[first].tag == "p" and siblings[first].chars <= 80 and not any(e.heads for e in siblings[first : good[0] + 1]):
        # short paragraphs in front are an introduction only below a heading
        first = next(k for k in range(first, good[0] + 1) if k == good[0] or siblings[k].tag != "p" or siblings[k].chars > 80)
    while last + 1 < len(siblings) and goes_on(siblings[last + 1]) and siblings[last + 1].tag not in HEADS:
        last += 1
    return [e for k, e in enumerate(siblings) if k in good or first <= k <= last and not linked(e)]


def _after_body(page: _Page, best: _Element) -> _Element | None:
    """A list of like elements without a heading that outscores what stands below the page's first heading, apart from it."""
    head = next((of for _, _, of in page.blocks if of.tag == "h1" and not of.dead), None)
    if head is None or best.heads:
        return None
    box = head.parent
    while box is not None and not (box.tag in BOXES and box.score >= 2):
        box = box.parent
    if box is None or box.chars < 80 or box.last > best.first:
        return None
    for thread in (best, best.parent):
        if thread is None or thread.heads or thread.tag in ("body", "html", "#root") or thread.first < box.last:
            continue
        shapes = Counter(e.shape for e in page.elements if e.parent is thread and not e.dead and e.chars and e.tag in BLOCK and e.tag != "p")
        if shapes and shapes.most_common(1)[0][1] >= 3:
            return thread
    return None


def main_text(page: str) -> str:
    """The text of the best container and its good siblings, a line per block."""
    tree = parse(page)
    if not tree.blocks:
        return ""
    _measure(tree)
    _cut(tree, _unread(tree) + _threads(tree))
    _score(tree)
    best = _best(tree)
    while (thread := _after_body(tree, best)) is not None:
        _cut(tree, [thread])
        _score(tree)
        best = _best(tree)
    named = _article(tree, best)
    change = [0] * (len(tree.blocks) + 1)
    for e in [named] if named is not None else _kept(tree, best):
        change[e.first] += 1
        change[e.last] -= 1
    return "\n".join(text for (text, _, of), n in zip(tree.blocks, accumulate(change)) if n and not of.dead)


def _run(batches):
    for batch in tokens.parts(batches, "html"):
        texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of pages.

    White space inside a block is one space, blocks are trimmed and joined by
    one line feed in page order; nothing is capped.  Null and empty pages, and
    those of markup or boilerplate alone, have the empty text; null ids and urls
    are passed on; repeated rows are extracted each; extra columns are ignored;
    an empty table gives an empty one.  A page without markup is one block.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
