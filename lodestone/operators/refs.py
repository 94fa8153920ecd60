"""References in Markdown: reading them out, and rewriting hashtags in place.

Texts are never shuffled, and hardly ever leave the JVM: `refs_native` has the grammar in built-in functions. What it leaves (frontmatter that takes a YAML reader, for one) is read here line by line, in Arrow batches, by the same rules; tests hold
the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from lodestone.functions.identity import HASHTAG, title_key
from lodestone.operators import refs_native as native

# The grammar of references.
WIKILINK = re.compile(r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]")
HEADING = re.compile(r"#{1,6}\s+(.+)")
CODE_SPAN = re.compile(r"`[^`\n]+`")
FENCE = "```"
FRONTMATTER = re.compile(r"^---\n[\s\S]*?\n---\n", re.MULTILINE)
CONTEXT = 60

REF_TYPE = StructType()
for _name in ("target_text", "is_hashtag", "heading", "pre", "highlight", "post"):
    REF_TYPE = REF_TYPE.add(_name, BooleanType() if _name == "is_hashtag" else StringType())
REWRITTEN = StructType().add("markdown", StringType()).add("changed", IntegerType())


@dataclass
class Line:
    """A line of a body: what stands before its text (a heading's marker), the text, its end, and whether references in it count."""

    marker: str
    text: str
    end: str
    live: bool
    opens: str | None  # the heading that begins here

    @property
    def masked(self) -> str:
        """The text with inline code blanked; places stay."""
        return CODE_SPAN.sub(lambda m: " " * len(m[0]), self.text)


def lines(body: str) -> Iterator[Line]:
    fenced = False
    for whole in body.splitlines(keepends=True):
        text = whole.splitlines()[0] if whole else ""
        end = whole[len(text) :]
        if text.startswith(FENCE):
            fenced = not fenced
            yield Line("", text, end, False, None)
        elif not fenced and (m := HEADING.match(text)):
            yield Line(text[: m.start(1)], m[1], end, True, m[1].strip())
        else:
            yield Line("", text, end, not fenced, None)


def frontmatter(markdown: str) -> tuple[str, dict]:
    """The leading frontmatter block and what it says ({} if it says nothing readable)."""
    m = FRONTMATTER.match(markdown)
    if not m:
        return "", {}
    try:
        found = yaml.safe_load(m[0][4:-4])
    except Exception:
        found = None
    return m[0], found if isinstance(found, dict) else {}


def linked_titles(markdown: str) -> list[str]:
    """The titles that frontmatter links to, in its order. A plain string gives its characters, as any sequence does; anything else nothing."""
    found = frontmatter(markdown)[1].get("linked") or []
    return [str(t) for t in found] if isinstance(found, (list, tuple, str, dict, set)) else []


def parse(markdown: str) -> list[tuple]:
    """All references: those of the frontmatter, then line by line wikilinks before hashtags.

    The body begins after the first frontmatter-like block, even one in the middle of a text that has none at its head.
    """
    out: list[tuple] = [(t.lower(), False, None, "", f"[[{t}]]", "") for t in linked_titles(markdown)]
    heading = None
    for line in lines(FRONTMATTER.sub("", markdown, count=1)):
        heading = line.opens if line.opens is not None else heading
        if not line.live or ("[[" not in line.text and "#" not in line.text):
            continue
        masked = line.masked
        for pattern, is_tag in ((WIKILINK, False), (HASHTAG, True)):
            for m in pattern.finditer(masked):
                target = m[1].casefold() if is_tag else m[1].strip().lower()
                before, after = line.text[max(0, m.start() - CONTEXT) : m.start()], line.text[m.end() : m.end() + CONTEXT]
                out.append((target, is_tag, heading, before.strip(), f"#{m[1]}" if is_tag else m[0], after.strip()))
    return out


def rewrite(markdown: str, key: str, change: Callable[[str], str]) -> tuple[str, int]:
    """Change every live hashtag of an identity; all else stays byte for byte. Only frontmatter at the very beginning is passed over."""
    head = m[0] if (m := FRONTMATTER.match(markdown)) else ""
    out, n = [head], 0
    for line in lines(markdown[len(head) :]):
        text = line.text
        if line.live and "#" in text:
            parts, at = [], 0
            for m in HASHTAG.finditer(line.masked):
                if m[1].casefold() == key:
                    parts += [text[at : m.start()], change(text[m.start() : m.end()])]
                    at, n = m.end(), n + 1
            text = "".join(parts) + text[at:]
        out.append(line.marker + text + line.end)
    return ("".join(out), n) if n else (markdown, 0)


def set_linked(markdown: str, add: str | None = None, remove: str | None = None) -> str:
    """Add a title to the frontmatter's links, or take it out; without readable frontmatter nothing changes."""
    head, said = frontmatter(markdown)
    if not said:
        return markdown
    titles = [t for t in said.get("linked") or [] if t != remove]
    if add is not None and add not in titles:
        titles.append(add)
    said.pop("linked", None)
    if titles:
        said["linked"] = titles
    return f"---\n{yaml.dump(said, allow_unicode=True, sort_keys=False, default_flow_style=False)}---\n{markdown[len(head) :]}"


@F.pandas_udf(ArrayType(REF_TYPE))
def _parse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [dict(zip(REF_TYPE.names, r, strict=True)) for r in parse(t)])


def refs_of(markdown: Column) -> Column:
    """The references of a text, as an array; none for null. Only texts whose frontmatter takes a YAML reader go to Python."""
    may = markdown.contains("#") | markdown.contains("[[") | markdown.startswith("---\n")
    plain = native.is_plain(markdown)
    return F.when(~F.coalesce(may, F.lit(False)), F.array().cast(native.REF)).when(plain, native.parse(markdown)).otherwise(_parse(F.when(~plain, markdown)).cast(native.REF))


def parse_refs(markdown: DataFrame) -> DataFrame:
    """markdown (entry_id, markdown) -> one row for each occurrence, in the order of the text (ordinal)."""
    found = markdown.select(F.col("entry_id").alias("source_id"), F.posexplode(refs_of(F.col("markdown"))).alias("ordinal", "ref"))
    return found.select("source_id", "ordinal", "ref.*")


def _rewriter(change: Callable[[str], Callable[[str], str]]):
    @F.pandas_udf(REWRITTEN)
    def run(texts: pd.Series, keys: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if t is None else rewrite(t, k, change(n)) for t, k, n in zip(texts, keys, names, strict=True)]
        return pd.DataFrame(rows, columns=["markdown", "changed"])

    return run


_neutralize = _rewriter(lambda name: lambda span: f"`{span}`")
_rename = _rewriter(lambda name: lambda span: f"#{name}")


def _rewritten(markdown: Column, key: Column, name: Column, change: Callable[[Column], Column], exact) -> Column:
    plain = native.is_plain(markdown)
    other = exact(F.when(~plain, markdown), key, name)
    same = F.struct(markdown.alias("markdown"), F.lit(0).alias("changed"))
    return F.when(~markdown.contains("#"), same).when(plain, native.rewrite(markdown, key, change)).otherwise(F.struct(other["markdown"].alias("markdown"), other["changed"].alias("changed")))


def neutralize_hashtag(markdown: Column, key: Column) -> Column:
    """Put every live hashtag of the identity in backticks: struct (markdown, changed)."""
    return _rewritten(markdown, key, key, lambda tag: F.concat(F.lit("`"), tag, F.lit("`")), _neutralize)


def rename_hashtag(markdown: Column, key: Column, name: Column) -> Column:
    """Write every live hashtag of the identity as #name: struct (markdown, changed)."""
    return _rewritten(markdown, key, name, lambda tag: F.concat(F.lit("#"), name), _rename)


@F.pandas_udf(StringType())
def update_linked(texts: pd.Series, add: pd.Series, remove: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else set_linked(t, a, r) for t, a, r in zip(texts, add, remove, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def frontmatter_links(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else linked_titles(t))


def title_index(entries: DataFrame) -> DataFrame:
    """(is_hashtag, key, target_id, target_title, target_type): the entry that a wikilink or a hashtag means. Of entries with one title it is the latest."""
    keys = F.array(F.struct(F.lit(False).alias("is_hashtag"), F.lower("title").alias("key")), F.struct(F.lit(True).alias("is_hashtag"), title_key(F.col("title")).alias("key")))
    each = entries.select(F.explode(keys).alias("k"), "id", "title", "source_type")
    best = F.max(F.struct("id", "title", "source_type"))
    return each.groupBy("k.is_hashtag", "k.key").agg(best.alias("t")).select("is_hashtag", "key", F.col("t.id").alias("target_id"), F.col("t.title").alias("target_title"), F.col("t.source_type").alias("target_type"))
