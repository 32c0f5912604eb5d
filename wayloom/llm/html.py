"""Text of web pages as a reader sees it laid out.

A small tree builder closes and opens the elements that HTML lets authors leave out; a renderer walks the tree, skips
what is not visible, and sets blocks, lists and tables out in lines: blank lines round paragraphs and headings, marks
before list items, table cells padded to columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Elements that may stand in a head; any other start tag, or text, ends it.
IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li optgroup option main menu nav ol p pre section summary table ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd caption legend summary option optgroup".split()) | {"summary"}
#: Which open elements a start tag ends, and the elements beyond which it does not look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

#: A comment, a tag whose quotes are closed, or another declaration. Nothing in it is tried twice.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
#: The beginning of a tag; if its quotes are not closed it ends at the next '>'.
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Blanks before a line and columns of a cell are held to these.
MOST_INDENT, MOST_COLUMNS = 64, 1000
SPACES = re.compile(r"[ \t\n\f\r]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict) -> None:
        self.name, self.attrs, self.children = name, attrs, []


def attributes(text: str) -> dict:
    out: dict = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def parse(page: str) -> Node:
    """The page's tree, in time that grows with its length: where open elements stand in the stack is kept by name."""
    root = Node("html", {})
    stack, at, lower = [root], 0, None
    where: dict[str, list[int]] = {}

    def cut(i: int) -> None:
        while len(stack) > i:
            where[stack.pop().name].pop()

    def close(names: set, scope: set) -> None:
        """Ends the innermost open element of names, and all within it, unless one of scope stands between."""
        last = lambda of: max((where[n][-1] for n in of if where.get(n)), default=0)
        found = last(names)
        if found and found >= last(scope):
            cut(found)

    def start(name: str, attrs: dict) -> None:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID:
            where.setdefault(name, []).append(len(stack))
            stack.append(node)

    def text(part: str) -> None:
        part = html.unescape(part)
        if stack[-1].name == "head" and part.strip(" \t\n\f\r"):
            cut(len(stack) - 1)
        stack[-1].children.append(part)

    begin = at
    while (begin := page.find("<", begin)) >= 0:
        m = TOKEN.match(page, begin)
        if not m:
            if page.find(">", begin) < 0:
                break  # no tag ends after this
            m = BROKEN.match(page, begin)
            if not m:
                begin += 1
                continue
        if m.start() > at:
            text(page[at : m.start()])
        begin = at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not where.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name not in ("html", "body"):
                close({name}, {"td", "th", "table"} - {name} if name not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {name})
            continue
        if name == "html":
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        if m[3].rstrip().endswith("/") and (name in ("svg", "math") or where.get("svg") or where.get("math")):
            stack[-1].children.append(Node(name, attributes(m[3])))
            continue
        if name in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "li", "div", "section", "article"} - {"p"})
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
            if name == "tr":
                close({"tr"}, {"table"})
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            start("tr", {})
        attrs = attributes(m[3]) if m[3].strip() else {}
        start(name, attrs)
        if name in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):
                lower = re.sub("[A-Z]", lambda x: x.group().lower(), page)
            end = lower.find(f"</{name}", at)
            end = len(page) if end < 0 else end
            stack[-1].children.append(html.unescape(page[at:end]) if name == "textarea" else page[at:end])
            begin = at = end
    if at < len(page):
        text(page[at:])
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return node.name not in UNSEEN and (not a or not ("hidden" in a or NOT_SHOWN.search(a.get("style", ""))))


def shown(node: Node) -> list:
    """A node's children; of closed details the summary alone."""
    if node.name == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    return node.children


class Canvas:
    """Lines of text; breaks and spaces are kept back until more text follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.fresh = 0, False, True
        self.indents, self.depth, self.mark = [], 0, ""

    def deeper(self, width: int) -> None:
        self.indents.append(width)
        self.depth += width

    def higher(self) -> None:
        self.depth -= self.indents.pop()
        self.mark = ""

    def block(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def put(self, text: str) -> None:
        if self.breaks or self.fresh:
            if not self.fresh:
                self.parts.append("\n" * self.breaks)
            self.parts.append(" " * min(self.depth - len(self.mark), MOST_INDENT) + self.mark)
            self.mark = ""
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space, self.fresh = 0, False, False
        self.parts.append(text)

    def flow(self, text: str) -> None:
        body = SPACES.sub(" ", text)
        if body[:1] == " ":
            self.space = True
            body = body[1:]
        if body:
            ends = body[-1] == " "
            self.put(body[:-1] if ends else body)
            self.space = ends

    def text(self) -> str:
        return "".join(self.parts).replace("\xa0", " ")


def table_lines(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Cells (text, columns) of several lines fill as many lines of their row; one over several columns widens none of them."""
    columns = max((sum(n for _, n in row) for row in rows), default=0)
    widths, split = [0] * columns, []
    for row in rows:
        k, cells = 0, []
        for text, n in row:
            lines = text.split("\n")
            if n == 1:
                widths[k] = max(widths[k], *map(len, lines))
            cells.append((k, n, lines))
            k += n
        split.append(cells)
    out = []
    for cells in split:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            parts = [(lines[i] if i < len(lines) else "").ljust(sum(widths[k : k + n]) + 3 * (n - 1)) for k, n, lines in cells]
            out.append(" | ".join(parts).rstrip())
    return out


def number_of(start: str) -> int:
    """The number a list starts with: an integer of up to nine ASCII digits, with a sign or not, else one."""
    start = start.strip()
    digits = start[1:] if start[:1] in ("-", "+") else start
    return int(start) if digits.isascii() and digits.isdigit() and len(digits) < 10 else 1


def span_of(node: Node) -> int:
    n = node.attrs.get("colspan", "1").strip()
    return min(max(int(n), 1), MOST_COLUMNS) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def render(root: Node) -> str:
    """Walks the tree with a stack of its own, as pages may nest deeper than functions can."""
    canvases, tables, lists, pre = [Canvas()], [], [], 0
    work: list = [("open", root)]
    while work:
        what, node = work.pop()
        canvas = canvases[-1]
        if what == "close":
            name = node.name
            if name in ("td", "th") and tables and tables[-1][1] is not None:
                tables[-1][1].append((canvases.pop().text(), span_of(node)))
            elif name == "tr" and tables and tables[-1][1] is not None:
                if any(c.strip() for c, _ in tables[-1][1]):
                    tables[-1][0].append(tables[-1][1])
                tables[-1][1] = None
            elif name == "table":
                rows = tables.pop()[0]
                for line in table_lines(rows):
                    canvas.block(1)
                    canvas.put(line)
                canvas.block(2)
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                canvas.block(1 if lists else 2)
            elif name in ("li", "dd", "blockquote"):
                canvas.higher()
                canvas.block(2 if name == "blockquote" else 1)
            elif name == "pre":
                pre -= 1
                canvas.block(2)
            elif name in BLOCK:
                canvas.block(2 if name in SPACED else 1)
            continue
        if isinstance(node, str):
            if not pre:
                canvas.flow(node)
            else:
                for k, line in enumerate(node.split("\n")):
                    if k:
                        canvas.breaks = canvas.breaks + 1 if not canvas.fresh else 0
                    if line.strip():
                        canvas.put(line)
            continue
        name = node.name
        if not visible(node):
            continue
        if name == "br":
            canvas.breaks, canvas.space = canvas.breaks + 1, False
            continue
        if name == "hr":
            canvas.block(1)
            canvas.put("---")
            canvas.block(1)
            continue
        if name == "img":
            if node.attrs.get("alt"):
                canvas.flow(node.attrs["alt"])
            continue
        if name == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                canvas.flow(node.attrs["value"])
            continue
        if name == "table":
            canvas.block(2)
            tables.append([[], None])
        elif name == "tr" and tables:
            tables[-1][1] = []
        elif name in ("td", "th") and tables and tables[-1][1] is not None:
            canvases.append(Canvas())
        elif name in ("ul", "ol", "menu", "dir"):
            canvas.block(1 if lists else 2)
            lists.append([name == "ol", number_of(node.attrs.get("start", ""))])
        elif name == "li":
            canvas.block(1)
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            canvas.deeper(len(mark))
            canvas.mark = mark
        elif name in ("dd", "blockquote"):
            canvas.block(2 if name == "blockquote" else 1)
            canvas.deeper(4)
        elif name in BLOCK:
            canvas.block(2 if name in SPACED else 1)
            pre += name == "pre"
        work.append(("close", node))
        work.extend(("open", c) for c in reversed(shown(node)))
    return canvases[0].text()


def extractor() -> Callable[[list], list[tuple]]:
    return lambda pages: [(render(parse(p)) if p else "",) for p in pages]


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars) for each row of pages: all visible text, laid out in lines, in one pass without a shuffle.

    A null or empty page has an empty text; broken markup is read as far as it goes. Repeated rows and null ids each
    give a row of their own; an empty table gives an empty result; other columns are ignored.
    """
    found = map_texts(pages.select(F.col(id_col), F.col(html_col).alias("html")), extractor, "text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
