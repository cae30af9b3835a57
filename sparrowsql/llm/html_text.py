"""HTML extraction by layout-aware rendering.

A tree builder with implied tags reads the page (end tags that may be left out,
void elements, raw text, table parts), visibility rules drop what a browser
wouldn't show (head, scripts, templates, `hidden`, `display:none` and
`visibility:hidden`, inline or in a style sheet's simple selectors, closed
details and dialogs, what SVG and MathML define or describe without drawing it),
and a renderer emits all other text: white space
collapsed, a line per block, an empty line around paragraphs, headings, lists
and tables, list marks with two spaces of indent a level, and table cells
padded to their column's width and set apart by " | ". Preformatted text keeps
its white space. Style sheets count as on a screen of unknown size: blocks for
other media, for sizes and for other conditions hide nothing.

Null and empty pages give the empty text. Nothing recurses and no step walks the
open elements, so time and text grow in proportion to the page, however deep it
is nested; broken markup gives some text and never an error. Repeated rows give
repeated results; columns of other names don't matter.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element lists of the HTML standard that this renderer needs.
VOID = set("area base br col embed hr img input link meta source track wbr param basefont bgsound frame keygen".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template title meta link iframe object audio video canvas noembed noframes datalist area param source track map rp".split())
# What isn't drawn inside of drawings and formulas.
UNDRAWN = {
    "svg": set("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": set("annotation annotation-xml mphantom".split()),
}
BLOCK = set(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary search table ul caption tr".split()
)
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "tr", "select", "legend"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# tag -> (the tags it closes, the tags beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "template", "details"}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|url\([^)"']*\)|[{};]""", re.S)
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


#: Layout stops growing here, so that a page's text is in proportion to the page: columns of indent, columns that a
#: table's cells are padded to, columns that a cell spans, tables in tables that are laid out as tables. All text is emitted.
MAX_INDENT, MAX_WIDTH, MAX_SPAN, MAX_TABLES = 40, 120, 100, 8


class Node:
    __slots__ = ("tag", "attrs", "children", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.inside = ""  # svg or math


class _Open:
    """The open elements, with the places of each tag, so that the innermost of some tags is found without a walk."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from a place up."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]

    def innermost(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def build(page: str) -> Node:
    """The tree of a page; children are nodes and texts."""
    root = Node("#root", {})
    opened = _Open(root)
    stack = opened.stack
    at, end = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def close(tags: set[str], limit: set[str]) -> None:
        """Close down to the lowest open element of these tags that stands above no limit."""
        low = opened.innermost(tags)
        if low > opened.innermost(limit):
            while low > 1 and stack[low - 1].tag in tags:
                low -= 1
            opened.cut(low)

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, opening = found[1], found[2]
        if closing:
            tag = closing.lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not opened.innermost(("p",)):
                stack[-1].children.append(Node("p", {}))
            else:
                barrier = {"table", "td", "th"} if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "html", "body") else {"table"} - {tag}
                low = opened.innermost(HEADINGS if tag in HEADINGS else (tag,))
                if low and low >= opened.innermost(barrier):
                    opened.cut(low)
        elif opening:
            tag = opening.lower()
            attrs = {}
            for name, a, b, c in _ATTRIBUTE.findall(found[3]):
                attrs.setdefault(name.lower(), entities.unescape(a or b or c))
            if tag in ("html", "body") and opened.innermost((tag,)):
                continue
            if tag in CLOSES_P:
                low = opened.innermost(("p",))
                if low > opened.innermost(SCOPE):
                    opened.cut(low)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                opened.cut(len(stack) - 1)
            if tag not in HIDDEN and stack[-1].tag == "head" and tag not in ("base", "noscript", "basefont", "bgsound"):
                opened.cut(len(stack) - 1)  # the body starts without its tag
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node, above = Node(tag, attrs), stack[-1]
            node.inside = above.tag if above.tag in UNDRAWN else "" if above.tag == "foreignobject" else above.inside
            above.children.append(node)
            if tag in RAW:
                stop = _END[tag].search(page, at)
                raw = page[at : stop.start() if stop else end]
                node.children.append(entities.unescape(raw) if tag in ("textarea", "title") else raw)
                at = stop.end() if stop else end
            elif tag not in VOID and not found[3].rstrip().endswith("/") or tag not in VOID and tag in BLOCK:
                opened.push(node)
    return root


def on_screen(media: str) -> bool:
    """Whether a media query list holds on every screen."""
    for one in media.lower().split(","):
        words = one.split()
        if words[:1] == ["only"]:
            words = words[1:]
        if words in ([], ["all"], ["screen"]) or len(words) == 2 and words[0] == "not" and words[1] not in ("all", "screen"):
            return True
    return False


def style_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on every screen; rules nested in rules are left out."""
    found = []
    open_: list[tuple[str | None, bool, list[str]]] = []  # selectors (None for a block of rules), whether it holds, declarations
    start = 0

    def close(end: int) -> None:
        selectors, holds, said = open_.pop()
        if selectors is not None and holds:
            found.append((selectors, ";".join([*said, sheet[start:end]])))

    for m in _CSS.finditer(sheet):
        if m[0] == "{":
            selectors: str | None = sheet[start : m.start()].strip()
            holds = not open_ or open_[-1][0] is None and open_[-1][1]
            at_rule = re.match(r"@([\w-]+)(.*)", selectors, re.S)
            if at_rule:
                name, rest = at_rule[1].lower(), at_rule[2].strip()
                holds = holds and (name == "layer" or name == "media" and on_screen(rest) or name == "supports" and not re.match(r"not\b", rest, re.I))
                selectors = None
            open_.append((selectors, holds, []))
        elif m[0] == "}":
            if open_:
                close(m.start())
        elif m[0] == ";":
            if open_:
                open_[-1][2].append(sheet[start : m.start()])
        else:
            continue
        start = m.end()
    while open_:  # the end of a sheet closes its blocks
        close(len(sheet))
        start = len(sheet)
    return found


def hiding_rules(root: Node) -> set[tuple[str, str]]:
    """(tag, .class or #id) of a style sheet's simple selectors that hide; either may be empty."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                todo.append(child)
        if node.tag == "style" and on_screen(node.attrs.get("media", "")):
            sheet = _COMMENT.sub("", "".join(c for c in node.children if isinstance(c, str)))
            for selectors, body in style_rules(sheet):
                if _GONE.search(body):
                    for one in selectors.split(","):
                        m = re.fullmatch(r"\s*([a-zA-Z][\w-]*|\*)?([.#][\w-]+)?\s*", one)
                        if m and (m[1] or m[2]):
                            found.add(((m[1] or "").lower().replace("*", ""), m[2] or ""))
    return found


def visible(node: Node, rules: set[tuple[str, str]]) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in HIDDEN or "hidden" in attrs and attrs["hidden"].lower() != "until-found" or _GONE.search(attrs.get("style", "")):
        return False
    if node.inside and tag in UNDRAWN[node.inside]:
        return False
    if tag == "input" or tag == "dialog" and "open" not in attrs:
        return False
    if rules:
        marks = ["", *(f".{c}" for c in attrs.get("class", "").split()), *([f"#{attrs['id']}"] if attrs.get("id") else [])]
        if any((t, m) in rules for t in (tag, "") for m in marks if t or m):
            return False
    return True


def width(text: str) -> int:
    """Columns of a text on a terminal: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a block being laid out."""

    __slots__ = ("lines", "line", "space", "gap", "indent", "mark")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []  # inline pieces of the open line
        self.space = False  # a space is due before the next piece
        self.gap = 0  # empty lines due before the next line
        self.indent = 0
        self.mark = ""  # a list mark due on the next line

    def text(self, raw: str) -> None:
        parts = _SPACE.split(raw)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self.line.append(part)

    def pre(self, raw: str) -> None:
        for i, part in enumerate(raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.end(keep=True)
            if part:
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        """Close the open line; an empty one counts only if kept."""
        said = "".join(self.line)
        self.line, self.space = [], False
        if said or keep:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            indent = min(self.indent, MAX_INDENT)
            lead = " " * indent
            if self.mark:
                lead, self.mark = " " * max(0, indent - len(self.mark)) + self.mark, ""
            self.lines.append((lead + said).rstrip())

    def spaced(self) -> None:
        self.end()
        self.gap = max(self.gap, 1)

    def block(self, lines: list[str]) -> None:
        for one in lines:
            self.line = [one] if one else []
            self.end(keep=True)


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


class Table:
    """Rows of rendered cells, aligned when the table ends."""

    __slots__ = ("rows", "caption", "outer", "cell", "span")

    def __init__(self, outer: Flow):
        self.rows: list[list[tuple[str, int]]] = []
        self.caption: list[str] = []
        self.outer = outer
        self.cell: Flow | None = None
        self.span = 1

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for said, span in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), min(width(said), MAX_WIDTH))
                at += span
        out = []
        for row in self.rows:
            at, parts = 0, []
            for i, (said, span) in enumerate(row):
                room = sum(widths.get(k, 0) for k in range(at, at + span)) + 3 * (span - 1)
                parts.append(said + " " * max(0, min(room, MAX_WIDTH) - width(said)) if i + 1 < len(row) else said)
                at += span
            if any(said for said, _ in row):
                out.append(" | ".join(parts).rstrip())
        return [*self.caption, *out]


def render(page: str) -> str:
    """All visible text of a page."""
    root = build(page)
    rules = hiding_rules(root)
    flow = Flow()
    lists: list[list] = []  # [ordered, next number]
    tables: list[Table] = []
    flat = 0  # open tables beyond MAX_TABLES: their cells are blocks
    pre = 0
    todo: list[tuple[object, bool]] = [(root, False)]
    closed = 0  # inside closed details: only the summary shows
    while todo:
        item, leaving = todo.pop()
        if isinstance(item, str):
            if not closed:
                flow.pre(item) if pre else flow.text(item)
            continue
        tag = item.tag
        label = item.inside == "svg" and tag in ("text", "foreignobject")
        if not leaving:
            if not visible(item, rules):
                continue
            if closed and tag != "summary" and tag != "details":
                continue
            if tag == "br":
                flow.end(keep=True)
                continue
            if tag == "hr":
                flow.spaced()
                continue
            if tag == "details" and closed:
                continue
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) and tag != "table":
                flow.spaced()
            elif label or tag in BLOCK and tag != "table":
                flow.end()
            if tag == "table" and (flat or len(tables) >= MAX_TABLES):
                flow.end()
                flat += 1
            elif flat and tag in ("tr", "td", "th", "caption"):
                flow.end()
            elif tag == "table":
                if tables and tables[-1].cell is not None:
                    flow.end()
                else:
                    flow.spaced()
                tables.append(Table(flow))
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].cell, tables[-1].span = flow, max(1, min(MAX_SPAN, _number(item.attrs.get("colspan"), 1)))
                flow = Flow()
            elif tag == "caption" and tables:
                tables[-1].cell = flow
                flow = Flow()
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(item.attrs.get("start"), 1)])
            elif tag == "li":
                mark = "- "
                if lists:
                    if lists[-1][0]:
                        lists[-1][1] = _number(item.attrs.get("value"), lists[-1][1])
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                flow.indent += len(mark) if not lists else max(2, len(mark))
                flow.mark = mark
                item.attrs["#mark"] = mark
            elif tag == "dd" or tag == "blockquote":
                flow.indent += 2
            elif tag == "pre":
                pre += 1
            elif tag == "details" and "open" not in item.attrs:
                closed += 1
            elif tag == "summary" and closed:
                item.attrs["#closed"] = str(closed)
                closed = 0
            todo.append((item, True))
            todo += [(c, False) for c in reversed(item.children)]
            continue
        if flat and tag in ("table", "tr", "td", "th", "caption"):
            flow.end()
            flat -= tag == "table"
        elif tag in ("td", "th") and tables and tables[-1].cell is not None:
            flow.end()
            tables[-1].rows[-1].append((" ".join(x.strip() for x in flow.lines if x.strip()), tables[-1].span))
            flow, tables[-1].cell = tables[-1].cell, None
        elif tag == "caption" and tables and tables[-1].cell is not None:
            flow.end()
            tables[-1].caption += flow.lines
            flow, tables[-1].cell = tables[-1].cell, None
        elif tag == "table" and tables:
            flow.end()
            table, stray = tables.pop(), flow.lines
            flow = table.outer
            flow.block([*stray, *table.lines()])
            flow.spaced()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            flow.end() if lists else flow.spaced()
        elif tag == "li":
            flow.end()
            flow.indent -= max(2, len(item.attrs["#mark"])) if lists else len(item.attrs["#mark"])
            flow.mark = ""
        elif tag in ("dd", "blockquote"):
            flow.spaced() if tag == "blockquote" else flow.end()
            flow.indent -= 2
        elif tag == "pre":
            flow.spaced()
            pre -= 1
        elif tag == "details" and "open" not in item.attrs:
            flow.end()
            closed = max(0, closed - 1)
        elif tag == "summary" and "#closed" in item.attrs:
            flow.end()
            closed = int(item.attrs["#closed"])
        elif tag in SPACED:
            flow.spaced()
        elif label or tag in BLOCK:
            flow.end()
    flow.end()
    return "\n".join(flow.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """One row per page: id, the rendered text, n_chars, n_lines."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                made = [render(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in made], pa.int64())],
                    ["id", "text", "n_chars", "n_lines"],
                )

    out = rows.mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long")
    return out.withColumnRenamed("text", text_col).withColumnRenamed("id", id_col)
