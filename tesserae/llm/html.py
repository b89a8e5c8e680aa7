"""Visible text of HTML pages, laid out: a tree builder with implied tags and visibility rules, then a renderer.

The tree builder closes elements that HTML closes by itself (a paragraph before a block, list items, table parts) and
ignores end tags without a start. Hidden elements emit nothing. Blocks begin on lines of their own, paragraphs and
headings are set off by a blank line, list items get a bullet or number and nested lists an indent, and the cells of
a table are padded to the width of their column. Of form fields, a drop-down gives the option that it shows, a list box
all options, a textarea its default content.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noembed noframes iframe object audio video canvas annotation annotation-xml datalist title meta link base param source track area map".split())
#: Not shown inside of svg.
SVG_HIDDEN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset("address article aside body dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary caption center optgroup option".split())
ENDS_P = (BLOCK | frozenset("tr td th tbody thead tfoot".split())) - frozenset("body html legend caption option optgroup".split())
#: What a start tag closes, and the elements that it doesn't look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}), "select": ({"select"}, {"table", "td", "th", "caption", "html"}), "textarea": ({"select"}, {"table", "td", "th", "caption", "html"}), "input": ({"select"}, {"table", "td", "th", "caption", "html"}),
}
#: End tags that don't reach out of these.
SCOPE = frozenset("table td th caption html".split())

#: Characters of a line up to which table cells are aligned.
ALIGNED = 2000
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.DOTALL)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_PARTS = frozenset("tr tbody thead tfoot table body html".split())
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw) if raw.strip(" /\n\t") else ():
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


class Stack:
    """Open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.open, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def cut(self, k: int) -> None:
        for node in self.open[k:]:
            self.places[node.tag].pop()
        del self.open[k:]

    def _last(self, tags: set | frozenset) -> int:
        return max([self.places[t][-1] for t in tags if self.places.get(t)], default=0)

    def find(self, tags: set | frozenset, stop: set | frozenset) -> int:
        """Where the innermost element of these tags is open inside the innermost of stop; 0 if there is none."""
        k = self._last(tags)
        return k if k and k >= self._last(stop) else 0


class Tags:
    """Where tags end. Of scans that run to the end of the page the quotes are remembered, so no part is scanned again and again."""

    def __init__(self, html: str):
        self.html, self.last, self.dead = html, html.rfind(">"), set()

    def end(self, at: int) -> int:
        """The first ``>`` from a place on that isn't quoted, or failing that the first one; -1 if there is none."""
        if at > self.last:
            return -1
        seen, place = [], at
        while (m := _STOP.search(self.html, place)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            place = self.html.find(m[0], m.end()) + 1
            if not place:
                break
        self.dead.update(seen)
        return self.html.find(">", at)


def parse(html: str) -> Node:
    """The tree; text stands in it as strings, entities resolved."""
    root = Node("#root", {})
    stack, tags, at, size = Stack(root), Tags(html), 0, len(html)
    while at < size:
        if html[at] != "<":
            begin, at = at, html.find("<", at)
            at = size if at < 0 else at
            stack.open[-1].children.append(unescape(html[begin:at]))
            continue
        if c := _COMMENT.match(html, at):
            at = c.end()
            continue
        if at > tags.last:  # no tag ends any more: text, up to a comment that takes the rest
            begin, at = at, html.find("<!--", at)
            at = size if at < 0 else at
            stack.open[-1].children.append(unescape(html[begin:at]))
            continue
        m, odd = _NAME.match(html, at), html[at + 1 : at + 2] in ("!", "?")
        end = html.find(">", at) if odd and at <= tags.last else tags.end(m.end()) if m else -1
        if end < 0:  # a tag that doesn't end is text
            stack.open[-1].children.append("<")
            at += 1
            continue
        at = end + 1
        if odd:
            continue
        tag, raw = m[2].lower(), html[m.end() : end]
        if m[1]:
            if tag not in VOID and (k := stack.find({tag}, SCOPE - {tag} if tag not in _PARTS else {"table"} - {tag})):
                stack.cut(k)
            continue
        if tag in CLOSES:
            while k := stack.find(*CLOSES[tag]):
                stack.cut(k)
        elif tag in ENDS_P and (k := stack.find({"p"}, SCOPE)):
            stack.cut(k)
        node = Node(tag, attributes_of(raw))
        stack.open[-1].children.append(node)
        if tag in RAW or tag in ("title", "textarea"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(html, at)
            inner = html[at : end.start() if end else size]
            node.children.append(re.sub(r"\A\r?\n", "", unescape(inner)) if tag == "textarea" else inner)
            at = (html.find(">", end.start()) + 1 or size) if end else size
        elif tag not in VOID and (tag in BLOCK or not raw.endswith("/")):
            stack.push(node)
    return root


def shown(node: Node) -> bool:
    a = node.attributes
    return node.tag not in HIDDEN and "hidden" not in a and not ("style" in a and _NOT_SHOWN.search(a["style"])) and not (node.tag == "input")


def _text(node: Node) -> str:
    """All text in a node, without recursion, but not that of scripts and styles."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in ("script", "style"):
            todo += reversed(x.children)
    return "".join(out)


def _options(select: Node) -> list[tuple[Node, bool]]:
    """The options of a select in order, and whether each is disabled."""
    out, todo = [], [(c, False) for c in reversed(select.children)]
    while todo:
        x, off = todo.pop()
        if isinstance(x, str):
            continue
        off = off or (x.tag in ("option", "optgroup") and "disabled" in x.attributes)
        if x.tag == "option":
            out.append((x, off))
        else:
            todo += [(c, off) for c in reversed(x.children)]
    return out


def _label(option: Node) -> str:
    return option.attributes.get("label") or _text(option)


def chosen(select: Node) -> str:
    """What a closed drop-down shows: the last option marked as selected, or else the first that isn't disabled."""
    options = _options(select)
    marked = [x for x, _ in options if "selected" in x.attributes][-1:] or [x for x, off in options if not off][:1]
    return _label(marked[0]) if marked else ""


class Flow:
    """Lines laid out so far, the line being filled, and whether a blank line is due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            *whole, rest = s.split("\n")
            for part in whole:
                self.inline.append(part)
                self.lines_add(["".join(self.inline)])
                self.inline = []
            self.inline.append(rest)
            return
        s = _SPACES.sub(" ", s)
        if s.startswith(" ") and (not self.inline or self.inline[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.inline.append(s)

    def lines_add(self, lines: list[str]) -> None:
        if self.gap and self.lines and lines:
            self.lines.append("")
        self.gap = self.gap and not lines
        self.lines += lines

    def end_line(self, even_empty: bool = False) -> None:
        line = "".join(self.inline).rstrip(" ")
        self.inline = []
        if line or even_empty:
            self.lines_add([line])

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Table:
    """Rows of (column, columns, lines); a cell may keep columns of later rows.

    Kept columns are runs of neighbouring intervals [start, end, row that ends it]; a run is passed in one step until its
    first interval ends. Cells are aligned to their columns up to ALIGNED characters, beyond it two spaces part them.
    """

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.runs: list[tuple[int, int, int, list[tuple[int, int, int]]]] = []  # start, end, first ending, intervals
        self.fresh: list[tuple[int, int, int]] = []
        self.caption: list[str] = []
        self.at = self.run = 0

    def row(self) -> None:
        for start, end, until in self.fresh:
            self._keep(start, end, until)
        self.rows.append([])
        self.fresh, self.at, self.run = [], 0, 0

    def _keep(self, start: int, end: int, until: int) -> None:
        low = bisect_left(self.runs, start, key=lambda r: r[1])
        high = bisect_right(self.runs, end, key=lambda r: r[0])
        if high == low + 1 and self.runs[low][1] == start:  # goes on where a run ends
            first, _, least, parts = self.runs[low]
            parts.append((start, end, until))
            self.runs[low] = (first, end, min(least, until), parts)
            return
        old = [p for r in self.runs[low:high] for p in r[3]]
        cut = [x for a, b, u in old for x in ((a, min(b, start), u), (max(a, end), b, u)) if x[0] < x[1]]
        self.runs[low:high] = _runs(sorted([*cut, (start, end, until)]))

    def cell(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        column, now = self.at, len(self.rows)
        while self.run < len(self.runs):
            start, end, least, parts = self.runs[self.run]
            if end <= column:
                self.run += 1
            elif start > column:
                break
            elif least <= now:
                self.runs[self.run : self.run + 1] = _runs([p for p in parts if p[2] > now])
            else:
                column = end
        wide, high = _span(node.attributes.get("colspan")), _span(node.attributes.get("rowspan"), 65_534)
        self.rows[-1].append((column, wide, lines))
        self.at = column + wide
        if high > 1:
            self.fresh.append((column, column + wide, now + high))

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for column, wide, lines in row:
                if wide == 1:
                    width[column] = max(width.get(column, 0), *map(len, lines), 0)
        columns = sorted(width)
        places = [0, *accumulate(width[c] + 2 for c in columns)]
        out = list(self.caption)
        for row in self.rows:
            cells, k = [(places[bisect_left(columns, c)], lines) for c, _, lines in row], 0
            while cells := [x for x in cells if k < len(x[1])]:
                line, size = [], 0
                for place, lines in cells:
                    pad = place - size if size <= place <= ALIGNED else 2 if size else 0
                    line += [" " * pad, lines[k]]
                    size += pad + len(lines[k])
                out.append("".join(line).rstrip())
                k += 1
        return out


def _runs(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list]]:
    """Sorted intervals as runs of neighbours."""
    out: list[tuple[int, int, int, list]] = []
    for p in parts:
        if out and out[-1][1] == p[0]:
            first, _, least, held = out[-1]
            held.append(p)
            out[-1] = (first, p[1], min(least, p[2]), held)
        else:
            out.append((p[0], p[1], p[2], [p]))
    return out


def _span(value: str | None, most: int = 1000) -> int:
    """The value of a colspan, or of a rowspan with its own bound; HTML itself clamps both."""
    return min(most, max(1, int(value[:9]))) if value and value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    """Walks the tree without recursion, so that any depth can be read."""
    flows: list[Flow] = [Flow()]
    tables: list[Table] = []
    lists: list[list] = []  # kind, number
    pre = svg = 0
    todo: list[tuple[str, object]] = [("enter", root)]
    while todo:
        what, node = todo.pop()
        if what == "enter" and isinstance(node, str):
            flows[-1].text(node, bool(pre))
            continue
        tag = node.tag
        if what == "enter":
            if not shown(node) or (svg and tag in SVG_HIDDEN):
                continue
            flow = flows[-1]
            if tag == "textarea" or (tag == "select" and "multiple" not in node.attributes and _span(node.attributes.get("size")) == 1):
                flow.text(" ", False)
                flow.text(_text(node) if tag == "textarea" else chosen(node).strip(), tag == "textarea")
                flow.text(" ", False)
                continue
            if tag == "option" and node.attributes.get("label"):
                flow.block(False)
                flow.text(_label(node), False)
                flow.block(False)
                continue
            if tag == "br":
                flow.end_line(even_empty=True)
                continue
            if tag == "hr":
                flow.block(True)
                continue
            if tag == "table":
                flow.block(True)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Flow())
            elif tag in ("li", "dd", "blockquote"):
                flow.block(tag == "blockquote")
                flows.append(Flow())
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "ol", "menu"):
                    start = node.attributes.get("start", "")
                    lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.ASCII) else 1])
                elif tag == "pre":
                    pre += 1
                elif tag == "optgroup":
                    flow.text(node.attributes.get("label", ""), False)
                    flow.block(False)
            elif tag == "svg":
                svg += 1
            elif tag == "mtr" or (svg and tag in ("text", "foreignobject")):
                flow.block(False)
            todo.append(("leave", node))
            todo += [("enter", c) for c in reversed(node.children)]
            continue
        if tag == "table":
            flows[-1].lines_add(tables.pop().lines())
            flows[-1].block(True)
        elif tag in ("td", "th") and tables:
            tables[-1].cell(node, flows.pop().done())
        elif tag == "caption" and tables:
            tables[-1].caption += flows.pop().done()
        elif tag in ("li", "dd", "blockquote"):
            lines = flows.pop().done()
            mark = "  "
            if tag == "li":
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
            flows[-1].lines_add([(mark if not k else " " * len(mark)) + x if x else x for k, x in enumerate(lines)])
            flows[-1].block(tag == "blockquote")
        elif tag in BLOCK:
            if tag == "pre":
                pre -= 1
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
            flows[-1].block(tag in SPACED and not (tag in ("ul", "ol") and lists))
        elif tag == "svg":
            svg -= 1
        elif tag == "mtd":
            flows[-1].text(" ", False)
        elif tag == "mtr" or (svg and tag in ("text", "foreignobject")):
            flows[-1].block(False)
    return "\n".join(flows[0].done())


def extract(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id, ``text``, n_chars and n_lines.

    Null and empty pages have an empty text. Pages of any length and depth are read, one at a time. Rows are
    independent: repeated rows give repeated results, an empty table none; other columns are not looked at.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                texts = [extract(x.as_py()) for x in batch.column(1).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=[id_col, "text", "n_chars", "n_lines"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
