"""The grammar of references in built-in functions: texts never leave the JVM.

Nothing is carried from line to line. Fences toggle, so a body split at its fence lines has live text in every other piece; the live text split before its headings has one heading for each piece; what a regular expression finds in a line
is marked in place, so a split at the marks gives the finds with their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.identity import HASHTAG_FIRST, HASHTAG_REST

# The grammar of references, for another engine of regular expressions. WHITE is white space, ENDS what ends a line, SPACES white space within one.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDS = r"\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
SPACES = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
HASHTAG = rf"(?<![^{WHITE}])#[{HASHTAG_FIRST}][{HASHTAG_REST}]*(?![{HASHTAG_REST}])"
WIKILINK = r"\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]"
CODE_SPAN = r"`[^`\n]+`"
LINE_START = rf"(?:\A|(?<=[{ENDS}]))"
LINE_END = rf"\r\n|[{ENDS}]"
FENCE_LINE = rf"{LINE_START}```[^{ENDS}]*(?:\r\n|[{ENDS}]|\z)"
MARKER = rf"#{{1,6}}[{SPACES}]+(?=[^{ENDS}])"
CONTEXT = 60

#: Two code points that no text has (they are not characters) go around what is found, a third before what is changed.
OPEN, CLOSE, CHANGED = "\ufdd0", "\ufdd1", "\ufdd2"
#: Texts with more places that could be references than this are read line by line in Python instead, as lists grow by copying here.
MANY = 5000

# A scalar that needs no YAML reader: in quotes without escapes, or of letters first.
QUOTED = r'"[\x20\x21\x23-\x5b\x5d-\x7e\xa0-\u1fff\u2010-\u2027\u2030-\ud7ff\ue000-\ufdcf\ufe00-\ufefe\uff00-\ufffd\x{10000}-\x{10ffff}]*"'
PROPERTY = rf"[A-Za-z_]+: (?:{QUOTED}|[A-Za-z][A-Za-z0-9_./ -]*)"
LINKED = rf"linked: \[{QUOTED}(?:, {QUOTED})*\]"
HEAD = r"(?s)\A---\n.*?\n---\n"
PLAIN_HEAD = rf"\A---\n(?:(?!linked){PROPERTY}\n)*(?:{LINKED}\n)?(?:(?!linked){PROPERTY}\n)*---\n\z"

FINDS = "array<struct<at: int, found: string>>"
REF = "array<struct<target_text: string, is_hashtag: boolean, heading: string, pre: string, highlight: string, post: string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once and standing once in the plan."""
    return F.get(F.transform(F.array(value), use), 0)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def marked(text: Column, pattern: str) -> Column:
    """The text in pieces: what is before the first find, and for each find it, CLOSE and what follows it."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)


def found_of(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, 1)


def after_found(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, -1)


def masked(line: Column) -> Column:
    """The line with inline code blanked; places stay."""
    blank = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.repeat(F.lit(" "), F.length(found_of(p))), after_found(p)))
    return F.when(line.contains("`"), F.array_join(F.transform(marked(line, CODE_SPAN), blank), "")).otherwise(line)


def finds(text: Column, pattern: str) -> Column:
    """[(at, found)]: what a pattern finds, and how many characters stand before it."""

    def step(acc: Column, p: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("at"), found_of(p).alias("found"))).cast(FINDS)
        return F.struct((acc["at"] + F.length(p) - 1).alias("at"), F.concat(acc["out"], one).alias("out"))

    def places(pieces: Column) -> Column:
        start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(FINDS).alias("out"))
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["out"])

    return let(marked(text, pattern), places)


def body_of(markdown: Column) -> Column:
    """Without the first block like frontmatter, wherever it begins."""
    return F.when(markdown.contains("\n---\n"), F.regexp_replace(markdown, r"(?dms)\A(.*?)^---\n.*?\n---\n", "$1")).otherwise(markdown)


def live_text(body: Column) -> Column:
    """Without fences and what they enclose."""
    outside = F.array_join(F.filter(F.split(body, FENCE_LINE), lambda p, i: i % 2 == 0), "")
    return F.when(body.contains("```"), outside).otherwise(body)


def refs_of_line(line: Column, heading: Column) -> Column:
    """Wikilinks, then hashtags."""

    def ref(f: Column, is_tag: bool) -> Column:
        at, m = f["at"], f["found"]
        target = F.lower(F.substring(m, 2, 2**31 - 1)) if is_tag else F.lower(stripped(F.regexp_extract(m, WIKILINK, 1)))
        pre = F.substring(line, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)))
        post = F.substring(line, at + F.length(m) + 1, F.lit(CONTEXT))
        return F.struct(target.alias("target_text"), F.lit(is_tag).alias("is_hashtag"), heading.alias("heading"), stripped(pre).alias("pre"), m.alias("highlight"), stripped(post).alias("post"))

    def both(shown: Column) -> Column:
        links = F.when(shown.contains("[["), F.transform(finds(shown, WIKILINK), lambda f: ref(f, False)).cast(REF)).otherwise(F.array().cast(REF))
        tags = F.when(shown.contains("#"), F.transform(finds(shown, HASHTAG), lambda f: ref(f, True)).cast(REF)).otherwise(F.array().cast(REF))
        return F.concat(links, tags)

    return let(masked(line), both)


def linked_of(markdown: Column) -> Column:
    """The titles of a plain head's `linked`."""
    line = F.regexp_extract(F.regexp_extract(markdown, HEAD, 0), rf"\n({LINKED})\n", 1)
    return F.when(markdown.startswith("---\n"), F.regexp_extract_all(line, F.lit('"([^"]*)"'), 1)).otherwise(F.array().cast("array<string>"))


def is_plain(markdown: Column) -> Column:
    """Can a text be read without Python: no frontmatter, or a plain one, none of the marks in it, and not too many places."""
    head = ~markdown.startswith("---\n") | ~markdown.rlike(HEAD) | F.regexp_extract(markdown, HEAD, 0).rlike(PLAIN_HEAD)
    places = F.length(markdown) - F.length(F.translate(markdown, "#[", ""))
    return head & ~markdown.rlike(f"[{OPEN}-{CHANGED}]") & (places <= MANY)


def parse(markdown: Column) -> Column:
    """All references of a plain text: those of the frontmatter, then line by line."""
    none = F.lit(None).cast("string")
    named = F.transform(linked_of(markdown), lambda t: F.struct(F.lower(t).alias("target_text"), F.lit(False).alias("is_hashtag"), none.alias("heading"), F.lit("").alias("pre"), F.concat(F.lit("[["), t, F.lit("]]")).alias("highlight"), F.lit("").alias("post")))
    has = lambda text: text.contains("#") | text.contains("[[")

    def of_section(section: Column) -> Column:
        opens = section.rlike(rf"\A{MARKER}")
        heading = F.when(opens, stripped(F.regexp_extract(section, rf"\A{MARKER}([^{ENDS}]+)", 1)))
        lines = F.filter(F.split(F.regexp_replace(section, rf"\A{MARKER}", ""), LINE_END), has)
        return F.flatten(F.transform(lines, lambda line: refs_of_line(line, heading)))

    sections = F.split(let(body_of(markdown), live_text), rf"{LINE_START}(?={MARKER})")
    return F.concat(named.cast(REF), F.flatten(F.transform(F.filter(sections, has), of_section)))


def rewrite(markdown: Column, key: Column, change) -> Column:
    """A plain text with every live hashtag of an identity changed by change(hashtag): struct (markdown, changed). All else stays byte for byte; only frontmatter at the very beginning is passed over."""
    is_it = lambda f: F.lower(F.substring(f["found"], 2, 2**31 - 1)) == key

    def of_line(line: Column) -> Column:
        marker = F.regexp_extract(line, rf"\A{MARKER}", 0)

        def with_finds(text: Column, mine: Column) -> Column:
            def with_ends(ends: Column) -> Column:
                each = F.transform(mine, lambda f, i: F.concat(F.substring(text, F.get(ends, i) + 1, f["at"] - F.get(ends, i)), F.lit(CHANGED), change(f["found"])))
                return F.concat(F.array_join(each, ""), F.substring(text, F.element_at(ends, -1) + 1, F.lit(2**31 - 1)))

            return let(F.concat(F.array(F.lit(0)), F.transform(mine, lambda f: f["at"] + F.length(f["found"]))), with_ends)

        rest = F.substring(line, F.length(marker) + 1, 2**31 - 1)
        new = let(rest, lambda text: let(F.filter(finds(masked(text), HASHTAG), is_it), lambda mine: with_finds(text, mine)))
        return F.when(line.contains("#"), F.concat(marker, new)).otherwise(line)

    def of_text(text: Column) -> Column:
        pieces = marked(text, LINE_END)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, of_line(p)).otherwise(F.concat(found_of(p), of_line(after_found(p))))), "")

    # Marks of lines are set within pieces between fences, so the fences are marked and split off first.
    piece = lambda p, i: F.when(i == 0, of_text(p)).when(i % 2 == 0, F.concat(found_of(p), of_text(after_found(p)))).otherwise(F.concat(found_of(p), after_found(p)))

    def of_body(head: Column) -> Column:
        body = F.substring(markdown, F.length(head) + 1, 2**31 - 1)
        return F.concat(head, F.array_join(F.transform(marked(body, FENCE_LINE), piece), ""))

    def counted(out: Column) -> Column:
        plain = F.replace(out, F.lit(CHANGED), F.lit(""))
        return F.struct(plain.alias("markdown"), (F.length(out) - F.length(plain)).cast("int").alias("changed"))

    return let(let(F.regexp_extract(markdown, HEAD, 0), of_body), counted)
