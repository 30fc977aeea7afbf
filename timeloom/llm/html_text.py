"""HTML to visible text as a layout would show it: a tree with implied tags, visibility rules, blocks, lists, tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object datalist audio video canvas title".split())
#: what a head may hold; anything else ends it, as </head> may be omitted
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: parts of drawings and formulas that are never drawn where they stand
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset(["annotation", "annotation-xml"])}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup html legend li main menu nav ol p pre search section summary table ul".split()
)
#: boxes with lines of their own, which end no paragraph
BOX = frozenset("textarea select optgroup option".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: an opening tag closes these where they are the innermost open ones, up to a tag of the second set
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_NUMBER = re.compile(r"[+-]?\d{1,9}")
#: tables in so many others are laid out as boxes, a cell in a line
DEEPEST = 16
#: what a table may add to its cells' characters: so many spaces a character and a cell, and so many empty places a cell for spans
PADDING, PER_CELL, PLACES = 4, 8, 8
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _closable(html: str) -> str:
    """html in which `<` is text where nothing can close what it opens: behind the last `>`, or a comment or section without an end behind
    it. The parser would look for each such end through the rest of the page."""
    for opening, closing in (("<!--", "-->"), ("<![", "]>"), ("<", ">")):
        end = html.rfind(closing) + len(closing) if closing in html else 0
        if html.find(opening, end) >= 0:
            html = html[:end] + html[end:].replace(opening, "&lt;" + opening[1:])
    return html


class Node:
    """hidden: nothing in it is shown; unseen: whether its own text is (None: as its parent's); value: the start of a list, number of an item, or kind of box."""

    __slots__ = ("children", "hidden", "lines", "parent", "span", "tag", "unseen", "value")

    def __init__(self, tag: str, parent: Node | None, hidden: bool = False, value: str = "", unseen: bool | None = None, span: tuple[int, int] = (1, 1)):
        self.tag, self.parent, self.hidden, self.value, self.unseen, self.span, self.children, self.lines = tag, parent, hidden, value, unseen, span, [], []


def _span(text: str | None) -> int:
    return max(1, int(text)) if text and _NUMBER.fullmatch(text) else 1


class Builder(HTMLParser):
    """Builds the tree; a paragraph ends where a block begins, items and cells where the next one begins.

    `places` has, for each tag, where its open elements stand in the stack of open ones, so a tag costs what it closes.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    @property
    def at(self) -> Node:
        return self.stack[-1]

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _leave(self, depth: int) -> None:
        """Closes the open elements from `depth` on."""
        while len(self.stack) > depth:
            self.places[self.stack.pop().tag].pop()

    def _last(self, tags) -> int:
        """Depth of the innermost open element of tags, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, tags, stop) -> None:
        """Closes the outermost open element of tags below the innermost one of stop."""
        floor = self._last(stop)
        found = [own[k] for t in tags if (own := self.places.get(t)) and (k := bisect_right(own, floor)) < len(own)]
        if found:
            self._leave(min(found))

    def handle_starttag(self, tag, attrs):
        if tag == "body" and (head := self._last({"head"})):
            self._leave(head)
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "button"})
        if self.at.tag == "head" and tag not in HEAD:
            self._leave(len(self.stack) - 1)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        a = dict(attrs)
        style = a.get("style") or ""
        hidden = tag in HIDDEN or "hidden" in a or bool(_NONE.search(style)) or (tag == "dialog" and "open" not in a)
        seen = _VISIBILITY.findall(style)
        unseen = seen[-1].lower() != "visible" if seen else None
        value = (a.get("start") if tag == "ol" else a.get("value") if tag == "li" else "") or ""
        if tag == "details" and "open" not in a:
            value = "closed"
        if len(self.places.get("table", ())) + (tag == "table") > DEEPEST and tag in ("table", "tr", "td", "th"):
            value = "box"
        if tag == "text" or tag in UNDRAWN["svg"] or tag in UNDRAWN["math"]:
            drawing = self.stack[self._last(UNDRAWN)]
            hidden = hidden or (drawing.tag in UNDRAWN and tag in UNDRAWN[drawing.tag])
            value = drawing.tag if drawing.tag in UNDRAWN else ""
        node = Node(tag, self.at, hidden, value, unseen, (_span(a.get("colspan")), _span(a.get("rowspan"))) if tag in ("td", "th") else (1, 1))
        self.at.children.append(node)
        if tag == "optgroup" and a.get("label"):
            node.children.append(a["label"])
        if tag not in VOID:
            self._push(node)
        if tag == "textarea":  # its tags are text
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag != "textarea":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self._last({tag})
        if depth and (tag in ("tr", "table", "thead", "tbody", "tfoot") or depth >= self._last({"td", "th"})):
            self._leave(depth)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip(" \t\n\r\f"):
            self._leave(len(self.stack) - 1)
        if self.at.tag == "textarea":
            data = unescape(data if self.at.children else data.removeprefix("\n"))
            if not data.strip():
                return
        self.at.children.append(data)

    def close(self):
        super().close()
        if self.cdata_elem == "textarea" and self.rawdata:  # unclosed: the parser keeps the rest back
            self.handle_data(self.rawdata)


class Renderer:
    """Lines of text; `gap` is how many line ends the next text needs before it."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.prefix = ""

    def need(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def text(self, s: str, keep: bool = False) -> None:
        if not keep:
            s = _SPACE.sub(" ", s)
            if not s.strip(" "):
                self.space = self.space or bool(s)
                return
            lead, tail, s = s[0] == " ", s[-1] == " ", s.strip(" ")
        else:
            lead = tail = False
        if self.parts and self.gap:
            self.parts.append("\n" * self.gap)
        elif self.parts and (self.space or lead) and not self.prefix:
            self.parts.append(" ")
        self.parts.append(self.prefix + s)
        self.prefix, self.gap, self.space = "", 0, tail

    def done(self) -> str:
        return "".join(self.parts)


def _render(root: Node, unseen: bool = False) -> str:
    """The text of a node; unseen: whether the text around it is."""
    out = Renderer()
    todo: list = [(root, 0, None, unseen)]
    while todo:
        node, depth, number, unseen = todo.pop()
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            if not unseen:
                out.text(node, number == "pre")
            continue
        if node.hidden:
            continue
        tag = node.tag
        unseen = unseen if node.unseen is None else node.unseen
        if tag == "br":
            out.need(min(out.gap + 1, 2))
            continue
        if tag == "hr":
            out.need(2)
            continue
        if tag == "table" and node.value != "box":
            out.need(2)
            for line in node.lines:
                out.text(line, keep=True)
                out.need(1)
            out.need(2)
            continue
        lines = 2 if tag in PARAGRAPH else 1 if tag in BLOCK or tag in BOX or node.value == "box" or (tag == "text" and node.value == "svg") else 0
        if tag in ("ul", "ol") and depth:
            lines = 1
        if lines:
            out.need(lines)
        if tag == "li" and not unseen:
            out.prefix = "  " * min(max(depth - 1, 0), 16) + (f"{number}. " if isinstance(number, int) else "- ")
        todo.append((lambda n=lines: out.need(n) if n else None, 0, None, False))
        inner = depth + (tag in ("ul", "ol", "menu"))
        count = int(node.value) if tag == "ol" and _NUMBER.fullmatch(node.value) else 1
        children = []
        shown = node.children
        if node.value == "closed":
            shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"][:1]
        for child in shown:
            if isinstance(child, Node) and child.tag == "li" and tag == "ol":
                count = int(child.value) if _NUMBER.fullmatch(child.value) else count
                children.append((child, inner, count, unseen))
                count += 1
            else:
                children.append((child, inner, "pre" if tag in ("pre", "textarea") or number == "pre" else None, unseen))
        todo.extend(reversed(children))
    return out.done()


def _placed(rows: list[list[tuple[str, tuple[int, int]]]]) -> list[list[str]]:
    """Cells in their columns: a cell's text stands in the first place of its span, the others are empty. Spans that would
    make more than `PLACES` empty places a cell in all are left out, as are columns and rows beyond the table's own."""
    wide = max(map(len, rows), default=0)
    most = PLACES * sum(map(len, rows))
    out, taken, extra = [], {}, 0  # taken: column -> rows below that a span still covers
    for k, row in enumerate(rows):
        line, following = [], {}

        def covered(line=line, following=following):
            nonlocal extra
            while (left := taken.get(len(line), 0)) > 0:
                if left > 1:
                    following[len(line)] = left - 1
                line.append("")
                extra += 1

        for text, (across, down) in row:
            covered()
            across, down = max(1, min(across, wide - len(line))), min(down, len(rows) - k)
            extra += across - 1
            if down > 1:
                following |= {c: down - 1 for c in range(len(line), len(line) + across)}
            line += [text] + [""] * (across - 1)
            if extra > most:
                return [[t for t, _ in r] for r in rows]
        covered()
        taken = following
        out.append(line)
    return out


def _table(table: Node, unseen: bool) -> list[str]:
    """A line per row, cells padded to the width of their column, with ` | ` between them; captions and stray text first. Tables inside have their lines.

    A table's padding is at most `PADDING` times its characters and `PER_CELL` a cell: beyond it the columns with the most padding have none.
    """
    rows: list[list[tuple[str, tuple[int, int]]]] = []
    lines: list[str] = []
    todo = [(c, unseen) for c in reversed(table.children)]
    while todo:
        node, unseen = todo.pop()
        if isinstance(node, str):
            lines += [s for s in [_SPACE.sub(" ", node).strip()] if s and not unseen]
            continue
        if node.hidden:
            continue
        unseen = unseen if node.unseen is None else node.unseen
        if node.tag == "tr":
            cells = [c for c in node.children if isinstance(c, Node) and not c.hidden]
            loose = "" if unseen else " ".join(_SPACE.sub(" ", c).strip() for c in node.children if isinstance(c, str)).strip()
            row = [(" ".join(_render(c, unseen).split()), c.span) for c in cells] + ([(loose, (1, 1))] if loose else [])
            if any(text for text, _ in row):
                rows.append(row)
        elif node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo.extend((c, unseen) for c in reversed(node.children))
        else:
            lines += [s for s in [" ".join(_render(node, unseen).split())] if s]
    places = _placed(rows)
    width = [0] * max(map(len, places), default=0)
    for row in places:
        for k, text in enumerate(row):
            width[k] = max(width[k], len(text))
    padding = [0] * len(width)
    for row in places:
        for k, text in enumerate(row[:-1]):
            padding[k] += width[k] - len(text)
    left = sum(PADDING * len(text) + PER_CELL for row in rows for text, _ in row)
    for k in sorted(range(len(width)), key=lambda k: padding[k]):
        left -= padding[k]
        if left < 0:
            width[k] = 0
    return lines + [" | ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in places]


def visible_text(html: str | None) -> str:
    """All text that a reader sees. Null: empty. Broken markup is read as browsers do, as far as the rules above go.

    `visibility: visible` shows text inside what is hidden by visibility; a closed <details> shows its summary, a closed <dialog> nothing.
    Items have the number that `value` and `start` give them and are indented up to 16 levels; `colspan` and `rowspan` leave their places empty.
    """
    if not html:
        return ""
    builder = Builder()
    builder.feed(_closable(html))
    builder.close()
    tables, todo = [], [(builder.root, False)]
    while todo:
        node, unseen = todo.pop()
        unseen = unseen if node.unseen is None else node.unseen
        if node.tag == "table" and node.value != "box":
            tables.append((node, unseen))
        todo += [(c, unseen) for c in node.children if isinstance(c, Node)]
    for table, unseen in reversed(tables):  # inner ones before those around them, however deep
        table.lines = _table(table, unseen)
    return _render(builder.root)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text for every row of pages, repeated rows each; null or empty html gives an empty text. An empty table gives an empty result. Other columns are ignored."""

    def extract(batches):
        for batch in batches:
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.selectExpr("cast(page_id as bigint) AS page_id", "cast(html as string) AS html").mapInArrow(extract, "page_id long, text string")
