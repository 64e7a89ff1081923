"""Visible text of HTML pages, laid out as a reader sees it.

``Tree`` builds elements from the tags as they come: it supplies html, head and body, ends what a
new tag ends by itself (paragraphs, list items, cells, options), drops closing tags that match nothing
and closes what is open at the end. ``render`` walks the tree without recursion and leaves out what is
not shown: scripts, styles, templates, comments, elements that are hidden by attribute or inline style, and
the closed parts of details and dialogs. Blocks start new lines, paragraphs and headings are set off by an
empty line, list items carry a bullet or number and are indented, preformatted text keeps its spaces,
and the cells of a table stand in columns of equal width.

A page is a row, so Spark deals pages to tasks; nothing is shared between them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.registry import query, table

#: As in browsers, elements nested deeper than this are put beside each other; no text is lost.
MAX_DEPTH = 512

_TAG_NAME = re.compile(r"/?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

# Element names of the HTML standard by what they mean for layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object "
                   "audio video canvas svg math datalist area param source track".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre "
                  "search section summary ul xmp table caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure hr".split())
PRE = frozenset("pre xmp textarea".split())
ENDS_PARAGRAPH = BLOCK - frozenset("html body option optgroup legend summary caption dt dd li".split()) | frozenset("li dt dd".split())
ROW_GROUP = frozenset("thead tbody tfoot".split())
# A start tag ends the open elements of its set, up to the nearest element of the second set.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("td th tr caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{g: (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(["table"])) for g in ROW_GROUP},
}
SCOPE = frozenset("table td th caption button".split())


@dataclass
class Element:
    tag: str
    attributes: dict
    children: list = field(default_factory=list)


class Scanner:
    """Tags, comments and declarations of a page, in one pass: no part of the page is gone over more than a few times,
    whatever it holds. What looks like a tag but does not end outside quotes is text."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special, self.name_end = (_Next(page, re.compile(p)) for p in (r"""[>"']""", r"[\s/>]"))
        self.dead: set[int] = set()  # quotes from which no end was found

    def token(self, at: int) -> tuple[int, int, str, str] | None:
        """Begin, end, name (with its slash, '' where there is none) and attributes of the next token."""
        page = self.page
        at = page.find("<", at)
        while 0 <= at < self.last or (at >= 0 and page.startswith("<!--", at)):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", ""
            if page[at + 1] in "!?":
                return at, page.find(">", at) + 1, "", ""
            if _TAG_NAME.match(page, at + 1):
                stop = self.name_end(at + 1 + (page[at + 1] == "/"))
                end = self._end(stop)
                if end is not None:
                    return at, end + 1, page[at + 1:stop], page[stop:end]
            at = page.find("<", at + 1)
        return None

    def _end(self, at: int) -> int | None:
        """Where the tag ends whose attributes begin at ``at``."""
        met = []
        while (at := self.special(at)) < len(self.page) and at not in self.dead:
            quote = self.page[at]
            if quote == ">":
                return at
            met.append(at)
            at = self.page.find(quote, at + 1) + 1
            if not at:
                break
        self.dead.update(met)
        return None


class _Next:
    """The next place where a pattern matches; places before a known one are not searched again."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.low, self.high = page, pattern, 0, -1

    def __call__(self, at: int) -> int:
        if not self.low <= at <= self.high:
            m = self.pattern.search(self.page, at)
            self.low, self.high = at, m.start() if m else len(self.page)
        return self.high


class Tree:
    """Elements of one page; ``root`` is its html element."""

    def __init__(self, page: str):
        self.root = Element("html", {})
        self.open = [self.root]
        self.body: Element | None = None
        self._read(page)

    def _read(self, page: str) -> None:
        scan = Scanner(page)
        at, n = 0, len(page)
        while at < n:
            found = scan.token(at)
            if found is None:
                self._text(page[at:])
                return
            begin, end, name, rest = found
            self._text(page[at:begin])
            at = end
            if not name:
                continue
            tag = name.lstrip("/").lower()
            if name[0] == "/":
                self._end(tag)
                continue
            self._start(tag, rest)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", stop.end()) if stop else -1
                self._raw(tag, page[at:stop.start()] if close >= 0 else page[at:])
                at = close + 1 if close >= 0 else n

    def _raw(self, tag: str, body: str) -> None:
        if body:
            self.open[-1].children.append(html.unescape(body) if tag in ("textarea", "title") else body)
        self._end(tag)

    def _in_body(self) -> None:
        if self.body is None:
            while self.open[-1].tag != "html":
                self.open.pop()
            self.body = Element("body", {})
            self.root.children.append(self.body)
            self.open.append(self.body)

    def _text(self, text: str) -> None:
        if not text:
            return
        if self.body is None and not text.strip(" \t\n\r\f"):
            return
        self._in_body()
        self.open[-1].children.append(html.unescape(text) if "&" in text else text)

    def _close_to(self, index: int) -> None:
        del self.open[max(index, 2 if self.body is not None else 1):]

    def _start(self, tag: str, rest: str) -> None:
        attributes = {}
        if rest:
            for m in _ATTRIBUTE.finditer(rest):
                value = m[2] or ""
                attributes.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        if tag == "html":
            self.root.attributes = {**attributes, **self.root.attributes}
            return
        if tag == "body":
            first = self.body is None
            self._in_body()
            self.body.attributes = attributes if first else {**attributes, **self.body.attributes}
            return
        if tag == "head":
            if self.body is None and len(self.open) == 1:
                self._push(Element("head", attributes))
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                if self.open[-1].tag == "html":
                    self._push(Element("head", {}))
            else:
                self._in_body()
        if tag in ENDS_PARAGRAPH:
            self._end_within("p", SCOPE)
        if tag in IMPLIED_END:
            ended, bounds = IMPLIED_END[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in bounds:
                    break
                if self.open[i].tag in ended:
                    cut = i
                    while self.open[cut - 1].tag in ended:
                        cut -= 1
                    self._close_to(cut)
                    break
        if tag in ("td", "th") and self.open[-1].tag in ROW_GROUP | {"table"}:
            self._push(Element("tr", {}))
        new = Element(tag, attributes)
        if tag in VOID:
            self.open[-1].children.append(new)
        else:
            self._push(new)

    def _push(self, element: Element) -> None:
        if len(self.open) >= MAX_DEPTH:
            self.open.pop()
        self.open[-1].children.append(element)
        self.open.append(element)

    def _end_within(self, tag: str, bounds: frozenset) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close_to(i)
                return True
            if self.open[i].tag in bounds:
                return False
        return False

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._start("br", "")
            return
        bounds = frozenset(["table"]) if tag in ("td", "th", "tr", "caption", *ROW_GROUP) else \
            frozenset() if tag in ("table", "html") else SCOPE
        if not self._end_within(tag, bounds) and tag == "p":
            self._start("p", "")
            self._end_within("p", SCOPE)


def hidden(e: Element, parent: Element | None) -> bool:
    """Whether an element is not shown at all."""
    if e.tag in UNSEEN or "hidden" in e.attributes:
        return True
    if e.tag == "input" and e.attributes.get("type", "").lower() not in ("submit", "button", "reset"):
        return True
    if e.tag == "dialog" and "open" not in e.attributes:
        return True
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and e.tag != "summary":
        return True
    style = e.attributes.get("style")
    return bool(style and _HIDDEN_STYLE.search(style))


class Frame:
    """Lines of one block while its content comes in."""

    def __init__(self, element: Element, pre: bool = False, prefix: str = "", indent: str = ""):
        self.element, self.pre, self.prefix, self.indent = element, pre, prefix, indent
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False          # an empty line is due before what follows
        self.counter = 0
        self.rows: list[list[list[str]]] = []   # of a table: cells as lines
        self.column = 0
        self.taken: dict[int, int] = {}  # of a table: column and the last row that a cell above reaches down to

    def text(self, value: str) -> None:
        self.inline.append(value)

    def flush(self) -> None:
        """Turn the inline text so far into lines."""
        if not self.inline:
            return
        joined = "".join(self.inline)
        self.inline = []
        if self.pre:
            lines = joined.split("\n")
            if lines and not lines[0]:
                lines = lines[1:]
            lines = [x.rstrip() for x in lines]
        else:
            lines = [_SPACES.sub(" ", x).strip(" ") for x in joined.split("\x00")]
        while lines and not lines[-1]:
            lines.pop()
        if lines and (self.pre or any(lines)):
            self._add(lines)

    def block(self, lines: list[str], spaced: bool) -> None:
        self.flush()
        if not lines:
            return
        if spaced:
            self.gap = True
        self._add(lines)
        self.gap = spaced

    def _add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.extend(lines)

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        """A cell in the next column that no cell above reaches into."""
        at = self.column
        while self.taken.get(at, -1) >= len(self.rows) - 1:
            at += 1
        row = self.rows[-1]
        row.extend([_NOTHING] * (at - len(row)))
        row.append(lines)
        self.column = at + across
        if down > 1:
            self.taken.update(dict.fromkeys(range(at, self.column), len(self.rows) + down - 2))

    def finish(self) -> list[str]:
        self.flush()
        if self.rows:
            self._add(aligned(self.rows))
        if not self.prefix and not self.indent:
            return self.lines
        head = [self.prefix + self.lines[0]] if self.lines else []
        return head + [(self.indent + x) if x else x for x in self.lines[1:]]


_NOTHING: list[str] = []


def _span(value: str, most: int) -> int:
    """Columns or rows of a cell; what is no plain number of at most five digits is 1."""
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,5}", value) else 1


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells as lines: each column as wide as its widest line, two spaces between columns."""
    width: list[int] = []
    for row in rows:
        width += [0] * (len(row) - len(width))
        for i, cell in enumerate(row):
            width[i] = max([width[i], *map(len, cell)])
    out = []
    for row in rows:
        for k in range(max((len(c) for c in row), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(width[i]) for i, c in enumerate(row)).rstrip())
    return out


def render(root: Element) -> str:
    """The visible text below ``root``."""
    frames = [Frame(root)]
    stack: list[tuple] = [("in", root, None)]
    while stack:
        step, e, parent = stack.pop()
        frame = frames[-1]
        if step == "out":
            _leave(frames, e)
            continue
        if isinstance(e, str):
            if parent is not None and parent.tag == "details" and "open" not in parent.attributes:
                continue
            if frame.element.tag not in ("table", "tr", "thead", "tbody", "tfoot") or e.strip():
                frame.text(e)
            continue
        if hidden(e, parent):
            continue
        if e.tag == "br" or e.tag == "wbr":
            frame.text("\n" if frame.pre else "\x00" if e.tag == "br" else "")
            continue
        if e.tag == "hr":
            frame.block(["---"], True)
            continue
        if e.tag == "input":
            frame.text(e.attributes.get("value", ""))
            continue
        stack.append(("out", e, parent))
        _enter(frames, e)
        stack.extend(("in", c, e) for c in reversed(e.children))
    return "\n".join(frames[0].finish())


def _enter(frames: list[Frame], e: Element) -> None:
    parent = frames[-1]
    pre = parent.pre or e.tag in PRE
    if e.tag == "li":
        lists = next((f for f in reversed(frames) if f.element.tag in ("ol", "ul", "menu", "dir")), None)
        mark = "- "
        if lists is not None and lists.element.tag == "ol":
            start = e.attributes.get("value") or (lists.element.attributes.get("start") if not lists.counter else None)
            lists.counter = int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else lists.counter + 1
            mark = f"{lists.counter}. "
        frames.append(Frame(e, pre, mark, " " * len(mark)))
    elif e.tag == "tr":
        next((f for f in reversed(frames) if f.element.tag == "table"), frames[0]).row()
        frames.append(Frame(e, pre))
    elif e.tag in ROW_GROUP:
        next((f for f in reversed(frames) if f.element.tag == "table"), frames[0]).taken.clear()  # cells end with their group
        frames.append(Frame(e, pre))
    elif e.tag in BLOCK or e.tag in ("td", "th", *ROW_GROUP):
        indent = "  " if e.tag in ("blockquote", "dd") else ""
        frames.append(Frame(e, pre, indent, indent))
    elif e.tag == "q":
        parent.text("“")
    elif e.tag == "textarea":
        frames.append(Frame(e, True))


def _leave(frames: list[Frame], e: Element) -> None:
    if e.tag == "q":
        frames[-1].text("”")
        return
    if frames[-1].element is not e or len(frames) == 1:
        return
    done = frames.pop()
    lines = done.finish()
    if e.tag in ("td", "th"):
        home = next((f for f in reversed(frames) if f.element.tag == "table"), None)
        if home is not None and home.rows:
            down = _span(e.attributes.get("rowspan", "1"), 65_534)
            home.cell(lines, max(_span(e.attributes.get("colspan", "1"), 1000), 1), down or 65_534)  # 0: to the end of the group
            return
    nested = e.tag in ("ul", "ol") and any(f.element.tag == "li" for f in frames)
    frames[-1].block(lines, e.tag in SPACED and not nested)  # a list inside an item is not set off by empty lines


def visible_text(page: str | None) -> str:
    return render(Tree(page).root) if page else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``text``, the visible text of ``source``, in place of it; a ``text`` column is replaced.

    A null or empty page has an empty text. Repeated rows and other columns pass through, a page that is no
    HTML at all is shown as text. Pages of any length are read whole.
    """
    names = [c for c in pages.columns if c not in (source, "text")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([visible_text(v.as_py()) for v in batch[source]], pa.string())
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [text], names=[*names, "text"])

    read = pages.select(*names, source)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != source]
    return read.mapInArrow(each, ", ".join([*kinds, "text string"]))


@query("op1_html_text")
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
