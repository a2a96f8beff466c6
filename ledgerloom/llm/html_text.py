"""HTML to text by layout-aware rendering.

A scanner that looks at each character a bounded number of times (where a tag ends is known for all quotes and brackets
of the page beforehand, so an unclosed tag is text and is not scanned again) feeds a tree builder that closes elements by the
implied-end rules (a block ends an open paragraph, an item ends the item before it, cells, rows, options and definition parts
likewise), skips unmatched end tags and ends all at the end of input. The renderer walks the tree: elements that are not rendered (head, script, style, template, the
attribute `hidden`, a style of display none or visibility hidden, definitions of drawings, annotations of formulas) give
nothing, text of formulas and drawings and what stands in for scripts is text, inline text collapses white space, blocks stand on lines of their own with a blank
line around paragraphs, headings, lists and tables, list items get a mark and an indent, preformatted text stays as it
is, and table cells, which may have several lines (blocks, lists and tables inside them keep their lines), are padded line by
line so that columns align. Time and text are linear in the page: a column is as wide as its widest line, but where padding
would exceed four times the table's text, or all tables' padding eight times the page, lines longer than 160, 80, 40 or 20 letters stick
out instead; lists inside lists are set in 16 times at most; a table has 1,000 columns, and what lies beyond is in the last one.

Null html gives empty text; text without markup is one paragraph; broken markup (cut tags, stray '<') is text. Elements
nest 512 deep, deeper ones join their ancestor at that depth, with all their text. Extra columns are kept; result
columns are overwritten.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element classes of the public HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes datalist object audio video canvas".split())
UNDRAWN = dict.fromkeys("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient".split(), "svg") | dict.fromkeys(("annotation", "annotation-xml"), "math")  # inside svg or math only
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer header hgroup html li legend main menu nav option optgroup search section summary caption tr".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"), "tr": ("td th tr caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("td th tr thead tbody tfoot caption colgroup", "table"), "tbody": ("td th tr thead tbody tfoot caption colgroup", "table"), "tfoot": ("td th tr thead tbody tfoot caption colgroup", "table"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - {"option", "optgroup", "tr", "html", "body", "caption"}
DEPTH, MOST_ACROSS = 512, 1000  # the standard's bound of colspan, and the depth at which its parsers stop nesting

SPECIAL, BREAK, OPENING = re.compile("[>\"']"), re.compile(r"[\s/>]"), re.compile(r"/\*|[\"'(]")
CLOSING = {"/*": "*/", '"': '"', "'": "'", "(": ")"}
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']\S*))?")
INDENTS, COLUMNS = 16, 1000
HIDING = {("display", "none"), ("visibility", "hidden"), ("visibility", "collapse")}


class Node:
    __slots__ = ("tag", "attrs", "items", "shown")

    def __init__(self, tag, attrs="", within=()):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.shown = not (tag in HIDDEN or attrs and hides(attrs) or tag in UNDRAWN and any(x.tag == UNDRAWN[tag] for x in within))


def unquoted(style: str) -> str:
    """A style without comments, strings and what stands in brackets. What has no end stays."""
    out, at, endless = [], 0, set()
    while m := OPENING.search(style, at):
        close = CLOSING[m[0]]
        end = -1 if close in endless else style.find(close, m.end())
        if end < 0:
            endless.add(close)
            out.append(style[at : m.end()])
            at = m.end()
        else:
            out.append(style[at : m.start()])
            at = end + len(close)
    return "".join([*out, style[at:]])


def hides(attrs: str) -> bool:
    """The attribute `hidden`, whatever its value, or a style that leaves display none or visibility hidden in force."""
    low = attrs.lower()
    if "hidden" not in low and "style" not in low:
        return False
    values = {}
    for m in ATTRIBUTE.finditer(low):
        values.setdefault(m[1], m[2] or "")  # of repeated attributes the first holds
    style, fixed = {}, set()
    for part in unquoted(html.unescape(values.get("style", "").strip("\"'"))).split(";"):
        name, _, value = part.partition(":")
        name, (value, _, last) = name.strip(), value.partition("!")
        if last.strip() == "important" or name not in fixed:
            style[name] = value.strip()
            fixed |= {name} if last.strip() == "important" else set()
    return "hidden" in values or not HIDING.isdisjoint(style.items())


class Tags:
    """Where tags end: a tag that is open at a bracket or quote ends at the first bracket that no quotes enclose, which follows for
    every place from the places behind it."""

    def __init__(self, source: str):
        self.source = source
        self.special = [m.start() for m in SPECIAL.finditer(source)]
        self.breaks = [m.start() for m in BREAK.finditer(source)]
        self.ends = [-1] * (len(self.special) + 1)
        later: dict[str, int] = {}
        for k in range(len(self.special) - 1, -1, -1):
            mark = source[self.special[k]]
            if mark == ">":
                self.ends[k] = self.special[k]
            else:
                if mark in later:
                    self.ends[k] = self.ends[later[mark] + 1]
                later[mark] = k
        self.last = source.rfind(">")

    def at(self, place: int) -> tuple[str, str, int] | None:
        """(name, attributes, place after it) of the tag whose name begins here."""
        k = bisect_left(self.breaks, place)
        stop = self.breaks[k] if k < len(self.breaks) else len(self.source)
        end = self.ends[bisect_left(self.special, stop)]
        return (self.source[place:stop].lower(), self.source[stop:end], end + 1) if end >= 0 else None


def tree(source: str) -> tuple[Node, str]:
    """(the page's tree, the text of its first title)."""
    root, tags, title = Node("html"), Tags(source), None
    open_, at, end, look = [root], 0, len(source), 0

    def close(names, until):
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in until:
                return
            if open_[i].tag in names:
                del open_[i:]

    def put(stop):
        if stop > at:
            open_[-1].items.append(html.unescape(source[at:stop]))

    while 0 <= (begin := source.find("<", look)) <= tags.last:
        look, mark = begin + 1, source[begin + 1 : begin + 2]
        if mark in ("!", "?"):
            if source.startswith("<!--", begin):
                stop = source.find("-->", begin + 4)
                stop = stop + 3 if stop >= 0 else end
            else:
                stop = source.find(">", begin) + 1
            put(begin)
            at = look = stop
            continue
        ending = mark == "/"
        first = source[begin + 1 + ending : begin + 2 + ending]
        if not (first.isascii() and first.isalpha()):
            continue
        found = tags.at(begin + 1 + ending)
        if not found:
            continue
        put(begin)
        tag, attrs, at = found
        look = at
        if ending:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ENDS_P:
            close(("p",), ("td", "th", "table", "button"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        node = Node(tag, attrs, open_)
        open_[-1].items.append(node)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(source, at)
            node.items.append(html.unescape(source[at : stop.start() if stop else end]))
            if tag == "title" and title is None and stop and not any(x.tag == "svg" for x in open_):
                title = node.items[0]
            at = look = (source.find(">", stop.start()) + 1 or end) if stop else end
        elif tag not in VOID and not attrs.endswith("/") and len(open_) < DEPTH:
            open_.append(node)
    stop = source.find("<!--", begin) if begin >= 0 else -1
    put(stop if stop >= 0 else end)  # a comment without end is none of the text
    return root, " ".join((title or "").split())


def collapse(lines: list[str]) -> list[str]:
    """No blank line first, last or after another."""
    if "" not in lines:
        return lines
    out = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return out


def render(node: Node, room: list[int], pre: bool = False, level: int = 0) -> list[str]:
    """Lines of a visible block element. room: padding that tables may still take; level: how often lists are set in."""
    lines, inline = [], []

    def flush():
        if inline:
            text = "".join(inline)
            inline.clear()
            if pre:
                lines.extend(x.rstrip() for x in text.strip("\n").split("\n"))
            else:
                lines.extend(t for x in text.split("\r") if (t := " ".join(x.split())) or len(lines))

    def put(child, nth):
        if isinstance(child, str):
            inline.append(child if pre else child.replace("\r", " "))
        elif not child.shown:
            return
        elif child.tag == "br":
            inline.append("\n" if pre else "\r")
        elif child.tag == "img":
            inline.append(" ")
        elif child.tag not in BLOCK:
            if child.tag in ("td", "th"):
                inline.append(" ")
            walk(child)
        else:
            flush()
            if child.tag == "table":
                inner = table(child, room, level)
            elif child.tag == "hr":
                inner = ["---"]
            else:
                inset = child.tag in ("li", "dd", "blockquote")
                inner = render(child, room, pre or child.tag == "pre", level + inset)
                inner = collapse(inner) if child.tag in ("li", "dd", "dt", "blockquote") else inner
            if child.tag == "li":
                mark = "- " if nth is None else f"{nth}. "
                inner = inner or [""]
                if level < INDENTS:
                    inner = [" " * len(mark) + x if x else x for x in inner]
                    inner[0] = inner[0][len(mark) :]
                inner[0] = (mark + inner[0]).rstrip()
            elif child.tag in ("dd", "blockquote") and level < INDENTS:
                inner = ["  " + x if x else x for x in inner]
            elif child.tag == "pre":
                inner = [x or "\0" for x in inner]  # blank lines inside stay
            space = [""] if child.tag in SPACED and not (node.tag == "li" and child.tag in ("ul", "ol")) else []
            lines.extend(space)
            lines.extend(inner)
            lines.extend(space)

    def walk(parent):
        count = number(parent, "start", 1) if parent.tag == "ol" else 0
        for child in parent.items:
            item = parent.tag == "ol" and not isinstance(child, str) and child.tag == "li"
            count = number(child, "value", count) if item else count
            put(child, count if parent.tag == "ol" else None)
            count += item

    walk(node)
    flush()
    return lines


def number(node: Node, name: str, default: int) -> int:
    """An integer attribute; of repeated ones the first holds."""
    if name in node.attrs.lower():
        for m in ATTRIBUTE.finditer(node.attrs):
            if m[1].lower() == name:
                value = re.match(r"\s*([+-]?[0-9]+)", (m[2] or "").strip("\"'"))
                return int(value[1]) if value else default
    return default


def table(node: Node, room: list[int], level: int = 0) -> list[str]:
    """Rows with aligned cells. A cell holds its place in the rows it spans, to the end of its row group at most; columns
    without any text take no space."""
    rows, before, held, stack = [], [], {}, list(reversed(node.items))
    while stack:
        child = stack.pop()
        if child is None:
            held = {}
        elif isinstance(child, str):
            if text := " ".join(child.split()):
                before.append(text)
        elif not child.shown:
            continue
        elif child.tag == "tr" or child.tag in ("td", "th"):
            cells = child.items if child.tag == "tr" else [child]
            row, at, fresh = {}, 0, {}
            for cell in cells:
                while at in held:
                    at += 1
                at = min(at, COLUMNS - 1)
                if isinstance(cell, str):
                    if cell.strip():
                        row.setdefault(at, []).append(" ".join(cell.split()))
                        at += 1
                elif cell.shown:
                    row.setdefault(at, []).extend(collapse(render(cell, room, False, level)))
                    across, down = min(max(number(cell, "colspan", 1), 1), MOST_ACROSS), number(cell, "rowspan", 1)
                    if down == 0 or down > 1:
                        fresh |= dict.fromkeys(range(at, min(at + across, COLUMNS)), down - 1 if down else -1)  # below nothing ends it: to the end of the group
                    at += across
            held = {k: v - 1 for k, v in held.items() if v != 1} | fresh
            rows.append(row)
        elif child.tag in ("tbody", "thead", "tfoot"):
            stack.extend([None, *reversed(child.items), None])
        else:
            before.extend(collapse(render(child, room, False, level)))
    return before + aligned(rows, room)


def aligned(rows: list[dict[int, list[str]]], room: list[int]) -> list[str]:
    """Lines of rows, cells beside each other. Columns begin behind the widest lines before them that do not stick out."""
    text = sum(len(line) for row in rows for cell in row.values() for line in cell)
    for most in (None, 160, 80, 40, 20, 0):
        wide: dict[int, int] = {}
        for row in rows:
            for at, cell in row.items():
                fit = [len(x) for x in cell if x and (most is None or len(x) <= most)]
                if fit or any(cell):
                    wide[at] = max(wide.get(at, 0), *fit, 0)
        begin, place = {}, 0
        for at in sorted(wide):
            begin[at] = place
            place += wide[at] + 2
        padding = 0
        for row in rows:
            last = [0] * max(map(len, row.values()), default=0)  # the last column of each line
            for at in sorted(row):
                for i, line in enumerate(row[at]):
                    if line:
                        last[i] = begin[at]
            padding += sum(last)
        if padding <= min(4 * text + 4096, room[0]):
            room[0] -= padding
            break
    else:
        begin = dict.fromkeys(begin, 0)  # no room at all: two blanks between cells
    out = []
    for row in rows:
        lines = [""] * max(max(map(len, row.values()), default=0), 1)
        for at in sorted(row):
            for i, line in enumerate(row[at]):
                if line:
                    gap = max(begin[at] - len(lines[i]), 2 * bool(lines[i]))
                    lines[i] += " " * gap + line
        out += lines
    return out


def page_text(source: str | None) -> tuple[str, str]:
    """(title, visible text) of a page."""
    if not source:
        return "", ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * DEPTH))
    root, title = tree(source.replace("\0", ""))
    lines = [x.rstrip() for x in render(root, [8 * len(source) + 4096])]
    return title, "\n".join(collapse(lines)).replace("\0", "")


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with title and text instead of the html column."""
    plain = pages.drop("title", "text")
    names = plain.columns

    def rendered(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                got = [page_text(x) for x in part.column(names.index(source)).to_pylist()]
                columns = [c for c, name in zip(part.columns, names) if name != source]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], [*(n for n in names if n != source), "title", "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields if f.name != source)
    return plain.mapInArrow(rendered, f"{fields}title string, text string")
