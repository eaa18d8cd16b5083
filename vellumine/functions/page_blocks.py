"""A web page as blocks, and blocks as Markdown.

``blocks`` reads a page once, from left to right, with a stack of open elements.
A block is what stands between the starts and ends of block elements: a heading,
a paragraph, an item, a table, preformatted text.  It knows the quotes and items
it is in, so that Markdown is written line by line.  Time grows with the page,
however its tags nest or fail to close.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements, roles and words of classes and ids that are not what a page is about.
ASIDE = frozenset("head nav aside footer form button dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu toolbar".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement sponsored promo banner cookie cookies consent popup newsletter nav navbar menu breadcrumb breadcrumbs sidebar footer comments comment related share social pagination".split())
# What an opening tag closes, up to the nearest of the elements behind the bar.
IMPLIED = {
    "li": ("li", "ul ol menu table td th"), "dt": ("dt dd", "dl table td th"), "dd": ("dt dd", "dl table td th"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tr td th caption", "table"), "tfoot": ("tbody tr td th", "table"), "option": ("option", "select"),
}
STYLES = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "tt": "`", "del": "~~", "s": "~~"}

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_NAME = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[\s\xa0]+")
_SPECIAL = re.compile(r"([\\`*_\[\]<>~|])")
_START = re.compile(r"^(#{1,6}(?=\s)|[-+](?=\s)|\d+(?=[.)]\s)|={3,}|-{3,})")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _NAME.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


@dataclass
class _Open:
    """An element that is open."""

    tag: str
    aside: bool
    region: int
    #: The next number of an ordered list; none for others.
    number: int | None = None
    #: What stands in front of a quote's lines, of an item's first one, and, as spaces, of its others.
    marker: str = ""
    style: tuple[str, str] | None = None
    rows: list[list[str]] = field(default_factory=list)
    heads: bool = False


@dataclass(frozen=True)
class Block:
    kind: str
    text: str
    markdown: str
    #: In an element that is not what the page is about.
    aside: bool
    #: Number of the main or article element that it is in, outermost; 0 for none.
    region: int


class _Builder:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[_Open] = [_Open("#root", False, 0)]
        self.opened: Counter[str] = Counter()
        self.pieces: list[tuple[str, tuple[tuple[str, str], ...]]] = []
        self.regions: list[str] = ["none"]
        self.styles: list[tuple[str, str]] = []
        #: The open quotes and items, and the open tables.
        self.around: list[_Open] = []
        self.tables: list[_Open] = []

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append((html.unescape(raw) if "&" in raw else raw, tuple(self.styles)))

    def _prefix(self) -> tuple[str, str]:
        """What stands in front of a block's first line and of its others."""
        first = rest = ""
        for e in self.around:
            first += e.marker
            if e.tag == "li":
                e.marker = " " * len(e.marker)
            rest += e.marker
        return first, rest

    def _emit(self, kind: str, text: str, lines: list[str]) -> None:
        top = self.stack[-1]
        first, rest = ("", "") if top.aside else self._prefix()
        self.blocks.append(Block(kind, text, "\n".join((first if k == 0 else rest) + line for k, line in enumerate(lines)), top.aside, top.region))

    def flush(self) -> None:
        """End a block of text, of a cell if the innermost table has one open."""
        pieces, self.pieces = self.pieces, []
        if not pieces:
            return
        pre = self.opened["pre"] > 0 and not self.opened["table"]
        if pre:
            text = "".join(t for t, _ in pieces).strip("\n")
            if text.strip():
                fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", text)), default=0))
                self._emit("pre", text, [fence, *text.split("\n"), fence])
            return
        text = _SPACE.sub(" ", "".join(t for t, _ in pieces)).strip()
        if not text and not any(s[0] == "!" for _, styles in pieces for s in styles):
            return
        table = self.tables[0] if self.tables else None
        if table is not None and not table.aside:
            if not table.rows:
                table.rows.append([])
            if not table.rows[-1]:
                table.rows[-1].append("")
            cell = table.rows[-1][-1]
            table.rows[-1][-1] = f"{cell} {inline(pieces)}" if cell else inline(pieces)
            return
        kind = next((e.tag for e in reversed(self.stack) if e.tag in BLOCK), "p")
        marked = inline(pieces)
        if kind[0] == "h" and kind[1:].isdigit():
            marked = "#" * int(kind[1]) + " " + marked.replace("\n", " ")
        else:
            # what would start a heading, an item or a rule does not, behind a backslash
            marked = _START.sub(lambda m: m[0] + "\\" if m[0].isdigit() else "\\" + m[0], marked)
        self._emit(kind, text, marked.split("\n"))

    def _end_table(self, table: _Open) -> None:
        rows = [r for r in table.rows if any(r)]
        if not rows or table.aside:
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join([*(c.replace("\n", " ") for c in r), *[""] * (width - len(r))]) + " |" for r in rows]
        if not table.heads:
            lines.insert(0, "|" + "  |" * width)
        lines.insert(1, "|" + " --- |" * width)
        self._emit("table", "\n".join(" ".join(filter(None, map(unmarked, r))) for r in rows), lines)

    def open(self, tag: str, raw: str) -> None:
        if tag == "br":
            if self.pieces:
                self.pieces.append(("\n", (*self.styles, ("br", ""))))
            return
        if tag in BLOCK:
            self.flush()
            self.close("p", implied=True)
        closes, within = IMPLIED.get(tag, ("", ""))
        for other in closes.split():
            self.close(other, implied=True, within=within.split())
        parent = self.stack[-1]
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        if tag == "hr" and not parent.aside:
            self._emit("hr", "", ["---"])
        if tag == "img" and attributes.get("src"):
            self.pieces.append((attributes.get("alt", ""), (*self.styles, ("!", attributes["src"]))))
        if tag in VOID:
            return
        e = _Open(tag, parent.aside or self._is_aside(tag, attributes), parent.region)
        if tag in ("main", "article") and not e.region and not e.aside:
            self.regions.append(tag)
            e.region = len(self.regions) - 1
        if tag == "ol":
            start = attributes.get("start", "1")
            e.number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        elif tag == "li":
            up = next((x for x in reversed(self.stack) if x.tag in ("ol", "ul", "menu")), None)
            e.marker = "- " if up is None or up.number is None else f"{up.number}. "
            if up is not None and up.number is not None:
                up.number += 1
        elif tag in ("tr", "td", "th") and len(self.tables) == 1:
            table = self.tables[0]
            if tag == "tr":
                table.rows.append([])
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append("")
                table.heads |= tag == "th" and len(table.rows) == 1
        elif tag == "a" and attributes.get("href"):
            e.style = ("a", attributes["href"])
        elif tag in STYLES and not self.opened["pre"]:
            e.style = (STYLES[tag], "")
        if tag == "blockquote":
            e.marker = "> "
        if e.marker:
            self.around.append(e)
        elif tag == "table":
            self.tables.append(e)
        if e.style:
            self.styles.append(e.style)
        self.stack.append(e)
        self.opened[tag] += 1

    def _is_aside(self, tag: str, attributes: dict[str, str]) -> bool:
        if tag in ASIDE or tag == "header" and not (self.opened["article"] or self.opened["main"]):
            return True
        if not attributes or tag in ("html", "body", "main", "article"):
            return False
        words = re.split(r"[\s_-]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ASIDE_ROLES or not ASIDE_WORDS.isdisjoint(words)

    def close(self, tag: str, implied: bool = False, within: list[str] | None = None) -> None:
        if not self.opened[tag]:
            return
        stop = frozenset(within or ("table", "td", "th", "div", "section", "article", "main", "li", "blockquote")) if implied else frozenset()
        k = len(self.stack) - 1
        while self.stack[k].tag != tag:
            if self.stack[k].tag in stop:
                return
            k -= 1
        while len(self.stack) > k:
            e = self.stack[-1]
            if e.tag in BLOCK:
                self.flush()
            self.stack.pop()
            self.opened[e.tag] -= 1
            if e.style:
                self.styles.pop()
            if e.marker:
                self.around.pop()
            elif e.tag == "table":
                self.tables.pop()
                if not self.tables:
                    self._end_table(e)


def _escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unmarked(marked: str) -> str:
    """The text of a cell without the marks that ``inline`` made."""
    marked = re.sub(r"!?\[((?:[^\[\]\\]|\\.)*)\]\((?:[^()\\]|\\.)*\)", r"\1", marked)
    return re.sub(r"\\(.)|[*`~]", lambda m: m[1] or "", marked)


def inline(pieces: list[tuple[str, tuple[tuple[str, str], ...]]]) -> str:
    """Pieces of text with their styles as one run of Markdown; a line break stands where the page has one."""
    out: list[str] = []
    now: tuple[tuple[str, str], ...] = ()
    space = False

    def mark(style: tuple[str, str], opening: bool) -> str:
        kind, target = style
        if kind == "a":
            return "[" if opening else "](" + re.sub(r"([()\s\\])", lambda m: "%%%02X" % ord(m[1]) if m[1].isspace() else "\\" + m[1], target) + ")"
        return kind

    for text, styles in pieces:
        if styles and styles[-1][0] == "br":
            out += ["  \n"] if out else []
            space = False
            continue
        image = styles and styles[-1][0] == "!"
        target = styles[-1][1] if image else ""
        wanted = tuple(dict.fromkeys(styles[:-1] if image else styles))
        folded = _SPACE.sub(" ", text)
        body = folded.strip()
        space = space or folded[:1] == " "
        if not body and not image:
            continue
        same = 0
        while same < min(len(now), len(wanted)) and now[same] == wanted[same]:
            same += 1
        out += [mark(s, False) for s in reversed(now[same:])]
        if space and out and not out[-1].endswith("\n"):
            out.append(" ")
        out += [mark(s, True) for s in wanted[same:]]
        now = wanted
        if image:
            out.append(f"![{_escape(body)}]({target})")
        else:
            out.append(body.replace("`", "'") if any(s[0] == "`" for s in now) else _escape(body))
        space = folded[-1:] == " "
    out += [mark(s, False) for s in reversed(now)]
    return "".join(out).rstrip()


def blocks(page: str) -> list[Block]:
    """All blocks of a page in order."""
    out = _Builder()
    at, low, paired = 0, "", True
    while (m := _MARKUP.search(page, at)) is not None:
        start = m.start()
        out.text(page[at:start])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
        elif m[0] == "<![CDATA[":
            end = page.find("]]>", m.end())
            end = end if end >= 0 else len(page)
            out.text(html.escape(page[m.end() : end], quote=False))
            at = end + 3
        elif page.find(">", m.end()) < 0:
            # a tag that never ends is no text
            at = len(page)
        elif m[2] is None:
            at = page.find(">", m.end()) + 1
        else:
            # a tag ends at the first > outside quoted values; where quotes don't pair up to the page's end, at the first > from there on
            end = _REST.match(page, m.end()) if paired else None
            paired = end is not None
            tag, at = m[2].lower(), end.end() if end else page.find(">", m.end()) + 1
            if m[1]:
                out.close(tag)
            elif tag in RAW:
                low = low or _lower(page)
                end = low.find(f"</{tag}", at)
                end = page.find(">", end) if end >= 0 else -1
                at = end + 1 if end >= 0 else len(page)
            else:
                out.open(tag, page[m.end() : at - 1])
    out.text(page[at:])
    out.flush()
    while len(out.stack) > 1:
        out.close(out.stack[-1].tag)
    return out.blocks


def _lower(page: str) -> str:
    return page.translate({c: c + 32 for c in range(65, 91)})


def main_blocks(page: str) -> list[Block]:
    """The blocks that a page is about: those of its main element, else of its articles, else all that are not aside."""
    found = [b for b in blocks(page) if not b.aside]
    inside = [b for b in found if b.region]
    return inside or found


def to_markdown(found: list[Block]) -> str:
    """Blocks as Markdown, a blank line between them, none between the items of a list."""
    out: list[str] = []
    for k, b in enumerate(found):
        if k:
            item = found[k - 1].kind == b.kind == "li"
            out.append("\n" if item else "\n\n")
        out.append(b.markdown)
    return "".join(out)
