"""HTML extraction: a tree with implied tags, and a renderer that lays its visible text out.

The tree builder closes what HTML closes by itself (paragraphs before blocks, list
items, table rows and cells, options), ignores end tags without a start, and keeps
everything open at the end of the input. Tags are read by the states of the HTML
tokenizer: a quote opens a value only behind an equals sign, and a tag that the input
ends in is dropped. Reading takes time in proportion to the page.

Hidden are: the head, scripts, styles, templates, comments, elements with `hidden` or
with `display: none` in their style, hidden inputs, and what a closed `details` holds
beside its summary. `visibility` in a style is handed down until an element sets it
anew. Rules of style sheets are not read. Everything else is laid out: blocks on lines
of their own, a blank line around paragraphs and headings, list items with bullets or
numbers and indents, table cells padded to the width of their column (up to MAX_WIDTH)
under the cells that span rows, preformatted text as it stands.

Null and empty pages give an empty text. Elements nested deeper than MAX_DEPTH
become siblings, their text stays. Repeated rows give a row each; an empty table
gives none.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from curbspark.llm.common import table

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes datalist object svg canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table ul caption".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
CLOSES_P = BLOCK - {"option", "optgroup", "select", "caption", "html", "body", "legend"}
#: Tag -> open tags that it closes, and the tags beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"})),
    "body": ({"head"}, set()),
}
#: What an end tag never reaches through.
SCOPE = frozenset({"table", "td", "th", "caption", "template", "html"})

MAX_DEPTH = 512
CELL_GAP = "  "

#: Widest column that cells are padded to; longer cells stand out of their column.
MAX_WIDTH = 1000
MAX_SPAN = 1000

_WS = r"[ \t\n\f\r]"
#: What may begin with "<": a comment, a section, a declaration or malformed end tag, a tag.
_MARKUP = re.compile(rf"<(?:(!--)|(!\[CDATA\[)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^ \t\n\f\r/>]*+))")
_COMMENT = re.compile(r"-?>|.*?(?:--!?>|\Z)", re.S)
_VALUE = rf"""(?:{_WS}*+={_WS}*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)|))?+"""
_ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+){_VALUE}")
#: All attributes and the end of the tag. Nothing here is tried twice.
_REST = re.compile(rf"(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+{re.sub(r'[(](?![?])', '(?:', _VALUE)})*+>")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "_values")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self._values = tag, attributes, [], None

    def get(self, name: str) -> str | None:
        if self._values is None:
            self._values = {}
            for key, *values in _ATTRIBUTE.findall(self.attributes):
                self._values.setdefault(key.lower(), "".join(values))
        value = self._values.get(name)
        return None if value is None else html.unescape(value)


def parsed(source: str) -> Node:
    """The tree; children are nodes and texts."""
    root = Node("html")
    open_ = [root]

    def close(tags: set, bounds) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return close(tags, bounds)
            if open_[k].tag in bounds:
                return None
        return None

    at = 0
    while at < len(source):
        m = _MARKUP.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            open_[-1].children.append(html.unescape(source[at:end]))
        if not m:
            break
        at = m.end()
        if m[1]:
            at = _COMMENT.match(source, at).end()
            continue
        if m[2] or m[3]:
            end = source.find("]]>" if m[2] else ">", at)
            at = end + len("]]>" if m[2] else ">") if end >= 0 else len(source)
            continue
        tag = m[5].lower()
        rest = _REST.match(source, at)
        if rest is None:
            break
        attributes, at = source[at : rest.end() - 1], rest.end()
        if m[4]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if open_[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                    break
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE | {"button"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "html":
            continue
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\f\r/>])", re.I).search(source, at)
            inner = source[at : stop.start() if stop else len(source)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            rest = _REST.match(source, stop.end()) if stop else None
            at = rest.end() if rest else len(source)
        elif tag not in VOID and len(open_) < MAX_DEPTH:
            open_.append(node)
    return root


def displayed(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes or node.attributes.isspace():
        return True
    if "hidden" in node.attributes.lower():
        kind = node.get("type") if node.tag == "input" else None
        if node.get("hidden") is not None or (kind or "").lower() == "hidden":
            return False
    return not (_DISPLAY_NONE.search(node.attributes) and _DISPLAY_NONE.search(node.get("style") or ""))


def visibility(node: Node) -> bool | None:
    """What the element's style sets, if anything; the last value counts."""
    if not node.attributes or not _VISIBILITY.search(node.attributes):
        return None
    values = _VISIBILITY.findall(node.get("style") or "")
    return values[-1].lower() == "visible" if values else None


class Flow:
    """Lines of text that blocks are put into."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.blank = False, False

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = words[-1] == " "
            self.parts.append(words.rstrip(" "))

    def end_line(self) -> None:
        if self.parts:
            self.add(["".join(self.parts)])
        self.parts, self.space = [], False

    def gap(self, blank: bool) -> None:
        self.end_line()
        self.blank = self.blank or blank

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines

    def finished(self) -> list[str]:
        self.end_line()
        return self.lines


#: A cell: its lines, the columns and the rows that it spans.
Cell = tuple[list[str], int, int]


def under_spans(rows: list[list[Cell]]) -> list[list[tuple[list[str], int]]]:
    """Rows of cells (lines, columns spanned), with empty cells where a cell of a row above reaches down."""
    out, held = [], {}
    for row in rows:
        placed: list[tuple[list[str], int]] = []
        column, below = 0, {}

        def fill(placed=placed, below=below) -> None:
            nonlocal column
            while column in held:
                span, left = held.pop(column)
                placed.append(([], span))
                if left > 1:
                    below[column] = (span, left - 1)
                column += span

        for lines, span, depth in row:
            fill()
            placed.append((lines, span))
            if depth > 1:
                below[column] = (span, depth - 1)
            column += span
        # What reaches down further to the right stays in its column.
        fill()
        for start in sorted(held):
            span, left = held[start]
            if start >= column and left > 1:
                below[start] = (span, left - 1)
        held = below
        out.append(placed)
    return out


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of cells (lines, columns spanned) as lines, each cell padded to its columns' width."""
    widths: list[int] = []
    for span_one in (True, False):
        for row in rows:
            column = 0
            for lines, span in row:
                widths += [0] * (column + span - len(widths))
                need = min(MAX_WIDTH, max(map(len, lines), default=0))
                if span == 1:
                    widths[column] = max(widths[column], need) if span_one else widths[column]
                elif not span_one:
                    have = sum(widths[column : column + span]) + len(CELL_GAP) * (span - 1)
                    widths[column + span - 1] += max(0, need - have)
                column += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            column, line = 0, []
            for lines, span in row:
                width = sum(widths[column : column + span]) + len(CELL_GAP) * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(min(width, MAX_WIDTH)))
                column += span
            out.append(CELL_GAP.join(line).rstrip())
    return out


def spanned(value: str | None) -> int:
    return min(max(int(value), 1), MAX_SPAN) if value and value.isascii() and value.isdigit() and len(value) < 5 else 1


def rendered(root: Node) -> str:
    """The visible text. Flows are stacked: list items and cells are laid out by themselves, then placed."""
    flows, tables, lists, pre, shown = [Flow()], [], [], 0, [True]
    #: (node, entering)
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown[-1]:
                continue
            if pre:
                first, *rest = node.expandtabs().split("\n")
                flow.parts.append(first)
                for line in rest:
                    flow.add(["".join(flow.parts).rstrip()])
                    flow.parts = [line]
            else:
                flow.text(node)
            continue
        tag = node.tag
        if entering:
            if tag == "br":
                if flow.parts:
                    flow.end_line()
                else:
                    flow.blank = True
                continue
            if not displayed(node):
                continue
            sets = visibility(node)
            shown.append(shown[-1] if sets is None else sets)
            if tag in BLOCK:
                flow.gap(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.get("start") or ""
                lists.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                flows.append(Flow())
            pre += tag == "pre"
            stack.append((node, False))
            children = node.children
            if tag == "details" and node.get("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            stack += [(c, True) for c in reversed(children)]
            continue
        pre -= tag == "pre"
        shown.pop()
        if tag == "li":
            lines = flows.pop().finished()
            number = lists[-1] if lists else None
            bullet = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1] += 1
            flows[-1].add([(bullet if k == 0 else " " * len(bullet)) + x if x else "" for k, x in enumerate(lines)])
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("td", "th") and tables:
            tables[-1][-1].append((flows.pop().finished(), spanned(node.get("colspan")), spanned(node.get("rowspan"))))
        elif tag == "table":
            flows[-1].add(aligned([r for r in under_spans(tables.pop()) if any(lines for lines, _ in r)]))
        if tag in BLOCK:
            flows[-1].gap(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return "\n".join(flows[0].finished())


def visible_text(source: str) -> str:
    return rendered(parsed(source))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(h.as_py() or "") for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()),
            ],
            ["page_id", "text", "n_chars", "text_sha256"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and text_sha256 of every page."""
    return pages.select("page_id", "html").mapInArrow(
        _extract, "page_id long, text string, n_chars long, text_sha256 string"
    )


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
