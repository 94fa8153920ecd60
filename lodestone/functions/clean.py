"""Clean-up of an article's tree, before its content is looked for: each step saves something that pruning by density would lose, or drops what no reader sees."""

from __future__ import annotations

import re

from lodestone.functions.dom import Node, each, link_share

NAVIGATION = ("nav", "header", "footer", "aside")
# The thresholds of pruning that content is to survive.
LINK_SHARE, SHORT = 0.2, 25
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# The word lists of the class and id weights that readability-like extractors share (Arc90's, under the Apache licence 2.0), and the sentence of placeholders.
POSITIVE = re.compile(r"article|body|content|entry|hentry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(r"combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget", re.I)
LOADING = re.compile(r"Loading(\s+\w+){0,3}\s*(\.\.\.|…)?", re.I)


def weight(node: Node) -> int:
    """25 for names that promise content, less 25 for those that do not; class and id each."""
    named = [x for x in (node.attrs.get("class"), node.attrs.get("id")) if x]
    return sum(25 * bool(POSITIVE.search(x)) - 25 * bool(NEGATIVE.search(x)) for x in named)


def drop_hidden(root: Node) -> None:
    for n in root.walk():
        if any(re.search(r"\bhidden\b", c) for c in n.classes) and n.parent is not None:
            n.remove()


def simplify_figures(root: Node) -> None:
    """A figure keeps its picture itself, not the layers around it; a div around nothing but a figure goes."""

    def lift(figure: Node) -> None:
        image = figure.first("img")
        if image is None or image.parent is figure:
            return
        top = image
        while top.parent is not figure:
            top = top.parent
        if not top.text().strip() and top.tag != "figcaption" and len(top.all("img")) == 1:
            top.swap(image)

    each(root, ("figure",), lift)

    def unwrap(div: Node) -> None:
        inner = div.elements()
        if len(inner) == 1 and inner[0].tag == "figure" and not "".join(c for c in div.children if isinstance(c, str)).strip():
            div.unwrap()

    each(root, ("div",), unwrap)


def unwrap_sections(root: Node) -> None:
    each(root, ("section",), Node.unwrap)


def join_intro(root: Node) -> None:
    """An introduction alone beside one large body, under one roof, moves into the body."""

    def join(header: Node) -> None:
        if header.inside(*NAVIGATION) or not header.all("p"):
            return
        beside = [n for n in header.parent.elements() if n is not header and n.tag not in NAVIGATION]
        if len(beside) == 1 and beside[0].tag in ("div", "main", "article") and len(beside[0].text()) > len(header.text()):
            first = beside[0].children[0] if beside[0].children else None
            moved = [c for c in header.take()]
            for c in reversed(moved):
                if isinstance(c, Node):
                    c.parent = beside[0]
                beside[0].children.insert(0 if first is None else 0, c)
            header.remove()

    each(root, ("header",), lambda h: join(h) if h.parent is not None and "intro" in " ".join(h.classes) else None)


def plain_headings(root: Node) -> None:
    """Headings without classes, ids and links to themselves."""

    def strip(h: Node) -> None:
        h.attrs.pop("class", None)
        h.attrs.pop("id", None)
        for a in h.all("a"):
            to_self = a.attrs.get("href", "").startswith("#")
            if to_self and not re.search(r"\w", a.text()):
                a.remove()
            elif to_self:
                a.unwrap()
        beside = h.neighbour(1)
        if beside is not None and beside.tag == "a" and beside.attrs.get("href", "").startswith("#") and not re.search(r"\w", beside.text()):
            beside.remove()

    each(root, HEADINGS, strip)


def rescue_linked_lists(root: Node) -> None:
    """The items of a list that is mostly links become paragraphs, outside navigation."""

    def rescue(box: Node) -> None:
        if box.inside(*NAVIGATION) or not box.text().strip() or link_share(box) <= LINK_SHARE:
            return
        box.swap(*[Node("p", children=item.take()) for item in box.elements() if item.tag == "li"])

    each(root, ("ul", "ol"), rescue)


def rescue_linked_tables(root: Node) -> None:
    """Rows of a table that is mostly links become paragraphs, cells parted by dots, unless its name promises content. Rows of headings go."""

    def rescue(table: Node) -> None:
        if not table.text().strip() or weight(table) >= 25 or link_share(table) <= LINK_SHARE:
            return
        lines = []
        for row in table.all("tr"):
            cells = [c for c in row.elements() if c.tag in ("td", "th")]
            if any(c.tag == "td" for c in cells):
                line = Node("p")
                for i, cell in enumerate(cells):
                    for part in ([" · "] if i else []) + cell.take():
                        line.append(part)
                lines.append(line)
        holder = table.parent
        alone = holder.tag == "figure" and holder.elements() == [table]
        (holder if alone else table).swap(*lines)

    each(root, ("table",), rescue)


def span(cell: Node, name: str) -> int:
    found = re.match(r"\s*\d+", cell.attrs.get(name, ""))
    return max(1, int(found[0])) if found else 1


#: Columns that the spans of a row may claim; real cells always count.
MAX_COLUMNS = 1000


def fill_spans(root: Node) -> None:
    """Cells that span rows or columns are repeated, so that every row has its own. The first row of a part of a table says how many columns it has."""

    def alone(cell: Node) -> Node:
        out = cell.copy()
        out.attrs.pop("rowspan", None)
        out.attrs.pop("colspan", None)
        return out

    def fill(table: Node) -> None:
        parts = [[r for r in p.elements() if r.tag == "tr"] for p in table.elements() if p.tag in ("thead", "tbody", "tfoot")] or [[r for r in table.elements() if r.tag == "tr"]]
        for rows in parts:
            cells_of = [[c for c in r.elements() if c.tag in ("td", "th")] for r in rows]
            widest = max(1, MAX_COLUMNS // max(1, len(cells_of[0]))) if rows else 1
            width = sum(min(span(c, "colspan"), widest) for c in cells_of[0]) if rows else 0
            grid: dict[tuple[int, int], Node] = {}
            for y, cells in enumerate(cells_of):
                waiting = iter(cells)
                x = 0
                while x < width:
                    if (y, x) in grid:
                        x += 1
                        continue
                    if (cell := next(waiting, None)) is None:
                        break
                    # A cell fills no more than the rows and columns that are there, whatever it claims.
                    claimed = min(span(cell, "colspan"), widest if y == 0 else width)
                    for dx in range(min(claimed, width - x)):
                        for dy in range(min(span(cell, "rowspan"), len(rows) - y)):
                            grid[y + dy, x + dx] = alone(cell)
                    x += claimed
            for y, row in enumerate(rows):
                if width:
                    row.take()
                    for x in range(width):
                        if (y, x) not in grid:
                            break
                        row.append(grid[y, x])

    each(root, ("table",), fill)


def inline_short_lists(root: Node) -> None:
    """A short list within an item, without pictures, is said in the item's own line."""

    def inline(box: Node) -> None:
        item = box.parent
        if item.tag != "li" or weight(box) < 0 or box.first("img") or len(box.text().strip()) >= SHORT:
            return
        if not "".join(c if isinstance(c, str) else c.text() for c in item.children if c is not box).strip():
            return
        said: list[Node | str] = [" "]
        for i, li in enumerate(n for n in box.elements() if n.tag == "li"):
            said += ([", "] if i else []) + [c.strip() if isinstance(c, str) else c for c in li.take()]
        box.swap(*said)

    each(root, ("ul", "ol"), inline)


def unwrap_item_paragraphs(root: Node) -> None:
    """The paragraph of an item is the item; of several all but the first begin a line."""

    def unwrap(p: Node) -> None:
        if p.parent.tag != "li":
            return
        if any(n.tag == "p" for n in p.parent.elements() if n is not p):
            p.put_before(Node("br")) if p.neighbour(-1) is not None else None
        p.unwrap()

    each(root, ("p",), unwrap)


def keep_short_labels(root: Node) -> None:
    """A short label in a figure is a paragraph, which nothing prunes."""

    def keep(box: Node) -> None:
        if box.parent.tag == "figure" and 0 < len(box.text().strip()) < SHORT and not box.first("img", "pre", "table"):
            box.tag = "p"

    each(root, ("div", "header"), keep)


def keep_syntax_notes(root: Node) -> None:
    """A footer right after code belongs to it."""

    def keep(footer: Node) -> None:
        before = footer.neighbour(-1)
        if before is not None and (before.tag == "pre" or (before.elements() and before.elements()[-1].tag == "pre")):
            footer.tag = "p"

    each(root, ("footer",), keep)


def unwrap_code(root: Node) -> None:
    """Boxes that hold only code go; the code stays."""

    def unwrap(div: Node) -> None:
        inner = div.elements()
        if inner and inner[-1].tag == "pre" and all(n.tag in ("pre", "p", "span", "button") for n in inner) and len(div.all("pre")) == 1:
            for n in inner:
                if n.tag == "button":
                    n.remove()
            div.unwrap()

    each(root, ("div",), unwrap)


def drop_placeholders(root: Node) -> None:
    """Elements that say nothing but that something is loading."""
    for n in reversed(list(root.walk())):
        if n.parent is not None and LOADING.fullmatch(n.text().strip()):
            n.remove()


STEPS = (drop_hidden, simplify_figures, unwrap_sections, join_intro, plain_headings, rescue_linked_lists, rescue_linked_tables, fill_spans, inline_short_lists, unwrap_item_paragraphs, keep_short_labels, keep_syntax_notes, unwrap_code)


def clean(root: Node) -> Node:
    for step in STEPS:
        step(root)
    return root
