"""HTML extraction: a small tree builder and a layout-aware text renderer."""

from __future__ import annotations

import html
import re
import textwrap
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cleanloom.llm.common import kind, map_rows, quoted

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
# Elements whose content is never shown.
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg datalist title meta link".split())
# Elements on lines of their own, and those with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre xmp blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div article section header footer nav aside main address form li dt dd details summary dialog "
                            "figcaption legend caption center option optgroup select tr thead tbody tfoot td th menu hgroup search".split())
CLOSE_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot caption option optgroup select".split())
# A start tag ends these open elements, looking up to the nearest of the limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
        "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, set())}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
# Content that cannot stand in a head; it ends one.
HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
# Lines of cells that have others beside them are broken between words at this width; only a longer word pushes the rest of its line.
# Deeper tables are not laid out, and one cell spans at most COLUMNS columns; below a cell columns are kept free up to that number.
PAD, NESTED_TABLES, COLUMNS = 120, 16, 1000

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_INSIDE = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m.group(1).lower() == name:
                return html.unescape(m.group(2) or m.group(3) or m.group(4) or "")
        return None

    def hidden(self) -> bool:
        if self.tag in UNSEEN:
            return True
        if self.tag == "dialog" and self.get("open") is None:
            return True
        if not self.attributes:
            return False
        return self.get("hidden") is not None or bool(_HIDING.search(self.get("style") or ""))


def parse(source: str) -> Node:
    """Tree of a page. Unclosed, misnested and missing tags are mended as browsers do in the common cases:
    paragraphs end at blocks, items, rows and cells at their next sibling, cells outside a row get one."""
    root = Node("#root")
    stack = [root]
    opened: dict[str, int] = {}
    low = source.lower()
    if len(low) != len(source):
        # A few letters change length in lower case; tags need ASCII only.
        low = source.translate({c: c + 32 for c in range(65, 91)})
    at, size = 0, len(source)

    def end_from(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    def add_text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                end_from(len(stack) - 1)
            stack[-1].children.append(html.unescape(raw))

    def close(tags: set | frozenset, limits: set) -> None:
        """End the outermost open element of ``tags`` above the nearest limit."""
        found = None
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in limits:
                break
            if stack[i].tag in tags:
                found = i
        if found is not None:
            end_from(found)

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            add_text(source[at:])
            break
        nxt = source[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            add_text(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(source, lt + 1 + closing)
        if not m:
            # A lone "<" is text.
            add_text(source[at:lt + 1])
            at = lt + 1
            continue
        add_text(source[at:lt])
        inside = _INSIDE.match(source, m.end()).end()
        if inside >= size or source[inside] != ">":
            inside = source.find(">", m.end())
            inside = size if inside < 0 else inside
        tag, attributes = m.group().lower(), source[m.end():inside].strip()
        at = inside + 1
        if closing:
            # An end tag without its start is left out; one inside a table never ends what is around it.
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    end_from(i)
                    break
                if stack[i].tag == "table":
                    break
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            end_from(len(stack) - 1)
        if tag in CLOSE_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and not any(n.tag == "tr" for n in stack[-3:]) and any(n.tag == "table" for n in stack[-4:]):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
            opened["tr"] = opened.get("tr", 0) + 1
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = low.find(f"</{tag}", at)
            end = size if end < 0 else end
            if tag == "textarea":
                node.children.append(html.unescape(source[at:end]))
            elif tag == "xmp":
                node.children.append(source[at:end])
            gt = source.find(">", end)
            at = size if gt < 0 else gt + 1
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


class Page:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, raw: str) -> None:
        flat = _SPACE.sub(" ", raw)
        if not flat:
            return
        if flat[0] == " " and self.now:
            self.space = True
        core = flat.strip(" ")
        if core:
            self.now.append((" " if self.space and self.now else "") + core)
            self.space = flat[-1] == " "

    def line(self, forced: bool = False) -> None:
        if self.now or self.mark or forced:
            head = self.indent[:len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append((head + "".join(self.now)).rstrip())
            self.mark = ""
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line()
        if self.lines and self.lines[-1] and not self.mark:
            self.lines.append("")

    def exact(self, raw: str) -> None:
        """Preformatted text: line breaks and spaces stay."""
        parts = raw.split("\n")
        for i, part in enumerate(parts):
            if i:
                self.line(forced=True)
            if part:
                self.now.append(part)


def rows_of(table: Node) -> tuple[list[tuple[int, list[Node]]], list[Node]]:
    """Rows of cells of a table, each with the number of its row group, without those of tables inside it, and its other
    visible parts (captions)."""
    rows, rest, group = [], [], 0
    todo = [iter(table.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            group += 1
        elif isinstance(child, str):
            if child.strip():
                rest.append(child)
        elif child.hidden():
            continue
        elif child.tag == "tr":
            rows.append((group, [c for c in child.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and not c.hidden()]))
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo.append(iter(child.children))
            group += 1
        else:
            rest.append(child)
    return rows, rest


def span_of(cell: Node | str, name: str) -> int:
    span = (cell.get(name) or "1") if isinstance(cell, Node) and cell.attributes else "1"
    return int(span) if span.isascii() and span.isdigit() and len(span) < 6 else 1


def broken(lines: list[str]) -> list[str]:
    """Lines of at most PAD characters, but for longer words."""
    return [part for line in lines for part in (textwrap.wrap(line, PAD, break_long_words=False, break_on_hyphens=False, expand_tabs=False,
                                                              replace_whitespace=False) if len(line) > PAD else [line])]


def table_lines(table: Node, depth: int) -> list[str]:
    """Cells in aligned columns, two spaces apart; cells of several lines fill lines of their own below each other."""
    rows, rest = rows_of(table)
    grid: list[list[list[str]]] = []
    # Columns that cells from above still fill, by the number of rows they go on.
    taken: dict[int, int] = {}
    last = None
    for group, row in rows:
        if group != last:
            taken, last = {}, group
        cells: list[list[str]] = []
        more: dict[int, int] = {}
        for cell in row:
            while len(cells) in taken:
                cells.append([""])
            at = len(cells)
            lines = [x for x in render(cell if isinstance(cell, Node) else Node("td", "", [cell]), depth + 1) if x] or [""]
            cells.append(lines)
            cells += [[""]] * (min(COLUMNS, span_of(cell, "colspan")) - 1)
            # Zero rows: to the end of the group.
            down = (span_of(cell, "rowspan") or len(rows)) - 1
            if down:
                more.update(dict.fromkeys(range(at, min(COLUMNS, len(cells))), down))
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | more
        cells = [broken(c) for c in cells[:-1]] + cells[-1:]
        if cells:
            grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for k, lines in enumerate(cells[:-1]):
            width[k] = max(width.get(k, 0), max((len(x) for x in lines if len(x) <= PAD), default=0))
    out = [line for part in rest for line in render(part if isinstance(part, Node) else Node("caption", "", [part]), depth + 1) if line]
    for cells in grid:
        for i in range(max(map(len, cells))):
            out.append("  ".join((lines[i] if i < len(lines) else "").ljust(width.get(k, 0) if k < len(cells) - 1 else 0)
                                 for k, lines in enumerate(cells)).rstrip())
    return out


def render(root: Node, depth: int = 0) -> list[str]:
    """Lines of all visible text below ``root``, walked without recursion but for the cells of tables."""
    page = Page()
    # Entries: (node or text, None) to begin, (node, saved state) to end.
    todo: list[tuple] = [(child, None) for child in reversed(root.children)]
    lists: list[list] = []
    exact = 0
    while todo:
        item, saved = todo.pop()
        if saved is not None:
            tag = item.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag == "li" or tag in ("blockquote", "dd"):
                page.line()
                page.indent = saved[0]
            if tag in ("pre", "xmp"):
                exact -= 1
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.gap()
            elif tag in BLOCKS:
                page.line()
            continue
        if isinstance(item, str):
            page.exact(item) if exact else page.text(item)
            continue
        tag = item.tag
        if item.hidden():
            continue
        if tag == "br":
            page.line(forced=True)
            continue
        if tag == "img":
            page.text(item.get("alt") or "")
            continue
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            page.gap()
        elif tag in BLOCKS:
            page.line()
        if tag == "hr":
            continue
        if tag == "table" and depth < NESTED_TABLES:
            for line in table_lines(item, depth):
                page.now.append(line)
                page.line(forced=True)
            page.gap()
            continue
        saved = (page.indent,)
        if tag in ("ul", "ol", "menu"):
            start = item.get("start") if tag == "ol" and item.attributes else None
            lists.append([tag, int(start) if start and re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.indent, page.mark = (page.indent + " " * len(mark))[:80], mark
        elif tag in ("blockquote", "dd"):
            page.indent = (page.indent + "  ")[:80]
        elif tag in ("pre", "xmp"):
            exact += 1
        todo.append((item, saved))
        children = item.children
        if tag == "details" and item.get("open") is None:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        todo += [(child, None) for child in reversed(children)]
    page.line()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def to_text(source: str | None) -> str | None:
    return None if source is None else "\n".join(render(parse(source)))


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text, n_chars, n_lines`` of every page.

    Text keeps its blocks on lines of their own, an empty line around paragraphs, headings, lists and tables, marks and
    indents of list items, breaks of preformatted text, and table cells in aligned columns (known limits: PAD, NESTED_TABLES, COLUMNS). Hidden elements (``hidden``,
    ``display: none``, ``visibility: hidden``, closed dialogs and details), heads, scripts and styles are left out.

    A null page gives null text and zero counts; an empty one empty text. Broken and very long pages are rendered whole.
    Ids are kept as they are, null and repeated ones too; other columns are ignored.
    """
    def make():
        def step(ids: list, pages: list) -> dict[str, list]:
            texts = [to_text(p) for p in pages]
            return {id_col: ids, "text": texts, "n_chars": [len(t or "") for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}
        return step

    return map_rows(df, [id_col, html_col], f"{quoted(id_col)} {kind(df, id_col)}, text string, n_chars long, n_lines long", make)
