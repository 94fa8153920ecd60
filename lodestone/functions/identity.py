"""What makes two names the same: tags, titles, hashtags, urls and slugs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters of a hashtag.
HASHTAG_FIRST = "A-Za-zÁÉÍÓÚÑÜáéíóúñü"
HASHTAG_REST = "A-Za-zÁÉÍÓÚÑÜáéíóúñü0-9_'~^-"

ASCII_ONLY = r"^[\x00-\x7F]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_diacritics(texts: pd.Series) -> pd.Series:
    def fold(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))

    return texts.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(), na_action="ignore")


def _beyond_ascii(text: Column, plain: Column, exact) -> Column:
    """ASCII texts stay in the JVM; only the others go to Python."""
    return F.when(text.rlike(ASCII_ONLY), plain).otherwise(exact(F.when(~text.rlike(ASCII_ONLY), text)))


def casefold(text: Column) -> Column:
    """Full Unicode case folding (ß becomes ss), which lower() is not. Null stays null."""
    return _beyond_ascii(text, F.lower(text), _casefold)


#: Latin letters up to U+024F that are one small letter with marks, and that letter: by the rule that the Python fold has, so that these texts need no Python. I with a dot (U+0130) has no small letter of its own.
LATIN_ONLY = r"^[\x00-\u012F\u0131-\u024F]*$"
_marked = {c: parts[0] for c in map(chr, range(0xC0, 0x250)) if len(parts := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, parts[1:])) and c == c.lower()}
MARKED, PLAIN = "".join(_marked), "".join(_marked.values())


def fold_diacritics(text: Column) -> Column:
    """Lower case without diacritics, as the search index sees a text."""
    latin = text.rlike(LATIN_ONLY)
    return F.when(latin, F.translate(F.lower(text), MARKED, PLAIN)).otherwise(_fold_diacritics(F.when(~latin, text)))


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z only, as a database without Unicode rules does."""
    return F.translate(text, UPPER, LOWER)


def title_key(title: Column) -> Column:
    """The hashtag that stands for a title: white space runs become one underscore, then case is folded."""
    return casefold(F.regexp_replace(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_"))


def is_hashtag_name(name: Column) -> Column:
    """Could the name be typed as a hashtag. Null is not one."""
    return F.coalesce(name.rlike(rf"\A[{HASHTAG_FIRST}][{HASHTAG_REST}]*\z"), F.lit(False))


def slug(title: Column, limit: int = 60) -> Column:
    """File name of a title: ASCII letters, digits and hyphens."""
    plain = F.lower(_beyond_ascii(title, title, _ascii))
    words = F.regexp_replace(F.regexp_replace(F.trim(plain), r"[^\w\s-]", ""), r"[\s_]+", "-")
    hyphened = F.regexp_replace(words, r"-{2,}", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(hyphened, r"^-+|-+$", ""), 1, limit), r"-+$", "")


def page_path(title: Column, created_at: Column) -> Column:
    """pages/DAY-SLUG.md; a title of which nothing is left is called entry."""
    name = slug(title)
    return F.concat(F.lit("pages/"), F.date_format(created_at, "yyyy-MM-dd"), F.lit("-"), F.when(name == "", F.lit("entry")).otherwise(name), F.lit(".md"))


HASHTAG = re.compile(rf"(?<!\S)#([{HASHTAG_FIRST}][{HASHTAG_REST}]*)(?![{HASHTAG_REST}])")
