"""From a tree to Markdown: headings with #, lists with -, fenced code with its language."""

from __future__ import annotations

import re

from lodestone.functions.dom import BLOCKS, Node, parse

LANGUAGE = re.compile(r"(?:^|\s)(?:language|lang|highlight-source|brush:?)[-:\s]\s*([\w+#.-]+)")
SAFE = re.compile(r"[A-Za-z0-9_+#.-]{1,30}")
SKIP = frozenset(("script", "style", "noscript", "template", "head", "title", "meta", "link"))
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def language(pre: Node) -> str:
    """The language of code: the code element's class before its lang, then the same of the block. Names that could break the fence are dropped."""
    code = pre.first("code")
    for n in (x for x in (code, pre) if x is not None):
        m = LANGUAGE.search(n.attrs.get("class", ""))
        for name in (m[1] if m else None, n.attrs.get("lang")):
            if name and SAFE.fullmatch(name):
                return name.lower()
    return ""


def normalize(root: Node) -> None:
    """Code that stands where no block can be: in a paragraph's line it is inline, in a block of code it is the block; a paragraph that only names the language of the code after it is the language."""
    for pre in root.all("pre"):
        if pre.parent is None:
            continue
        if pre.inside("pre"):
            pre.unwrap()
        elif pre.parent.tag == "p" and pre.parent.text().strip() != pre.text().strip():
            pre.tag = "code"
        before = pre.neighbour(-1)
        if pre.tag == "pre" and before is not None and before.tag == "p" and not language(pre) and re.fullmatch(r"[a-z+#]{1,15}", before.text().strip()) and not before.elements():
            pre.attrs["lang"] = before.text().strip()
            before.remove()


def line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def escaped(text: str) -> str:
    return re.sub(r"([*_`\[\]])", r"\\\1", text)


def inline(node: Node | str) -> str:
    if isinstance(node, str):
        return escaped(line(node))
    if node.tag in SKIP:
        return ""
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        src = node.attrs.get("src", "")
        return f"![{line(node.attrs.get('alt', '')).replace(']', '')}]({src})" if src else ""
    if node.tag in ("code", "kbd", "samp", "tt"):
        said = line(node.text()).strip()
        ticks = "`" * (max(map(len, re.findall("`+", said)), default=0) + 1)
        return f"{ticks}{said}{ticks}" if said else ""
    inner = "".join(map(inline, node.children))
    bare = inner.strip()
    left, right = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if node.tag in INLINE and bare:
        return f"{left}{INLINE[node.tag]}{bare}{INLINE[node.tag]}{right}"
    if node.tag == "a" and node.attrs.get("href") and bare:
        return f"{left}[{bare}]({node.attrs['href']}){right}"
    return inner


def table(node: Node) -> str:
    rows = [[line(inline_all(c)).strip().replace("|", "\\|") for c in r.elements() if c.tag in ("td", "th")] for r in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    shown = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([shown[0], f"|{' --- |' * width}", *shown[1:]])


def inline_all(node: Node) -> str:
    return "".join(map(inline, node.children)).strip()


def items(node: Node, ordered: bool) -> str:
    out = []
    for i, li in enumerate(n for n in node.elements() if n.tag == "li"):
        mark = f"{i + 1}. " if ordered else "- "
        out.append(mark + blocks(li, tight=True).replace("\n", "\n" + " " * len(mark)))
    return "\n".join(out)


def block(node: Node) -> str:
    tag = node.tag
    if tag in SKIP:
        return ""
    if tag[0:1] == "h" and tag[1:].isdigit():
        said = line(inline_all(node)).strip()
        return f"{'#' * int(tag[1:])} {said}" if said else ""
    if tag == "pre":
        code = node.text().strip("\n")
        fence = "`" * max(3, max(map(len, re.findall("`+", code)), default=0) + 1)
        return f"{fence}{language(node)}\n{code}\n{fence}"
    if tag in ("ul", "ol"):
        return items(node, tag == "ol")
    if tag == "blockquote":
        return "\n".join(f"> {x}".rstrip() for x in blocks(node).split("\n"))
    if tag == "hr":
        return "---"
    if tag == "table":
        return table(node)
    return blocks(node)


def blocks(node: Node, tight: bool = False) -> str:
    """The children as blocks; what stands between blocks is a paragraph."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        said = "\n".join(x.strip(" ") if not x.endswith("  ") else x.lstrip(" ") for x in "".join(run).strip().split("\n"))
        out.extend([said] if said else [])
        run.clear()

    for c in node.children:
        if isinstance(c, Node) and (c.tag in BLOCKS or c.first(*BLOCKS) is not None):
            end()
            said = block(c)
            out.extend([said] if said else [])
        else:
            run.append(inline(c))
    end()
    return ("\n" if tight else "\n\n").join(out)


def to_markdown(root: Node) -> str:
    tree = Node("div", children=[root.copy()])
    normalize(tree)
    return blocks(tree) + "\n"


def html_to_markdown(html: str) -> str:
    return to_markdown(parse(html))
