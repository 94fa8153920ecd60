"""Fill-in-middle: texts cut into prefix, middle and suffix, and written with the middle last.

A text becomes an array of its code points (UTF-32). Units are maximal runs of one class of code points: where neighbouring classes differ there is a boundary. Two drawn ranks choose two boundaries, and the pieces between
them are sliced and encoded again. Draws are digits of a hash of the seed and the id, so they do not depend on partitions, retries or the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exchange import tune

# The marks, and the white space that parts words.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], "<u4")

OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def every_code_point(codes: np.ndarray) -> np.ndarray:
    """No two neighbours are of one class: each code point is a unit."""
    return np.arange(len(codes))


def words_and_spaces(codes: np.ndarray) -> np.ndarray:
    """Units are words, and the white space between them."""
    return np.isin(codes, SPACES)


def lines(codes: np.ndarray) -> np.ndarray:
    """Units are lines, each with its end."""
    ends = codes == 0x0A
    return np.cumsum(ends) - ends


#: What a unit may be: code points -> classes.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": every_code_point, "word": words_and_spaces, "line": lines}


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: one more than there are units. An empty text has one boundary, its beginning."""
    kinds = UNITS[unit](codes)
    inner = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate(([0], inner, [len(codes)])) if len(codes) else np.zeros(1, np.int64)


def transform(text: str, draws: tuple[int, int, int, int], unit: str, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output. Texts that are empty, hold a mark or are not drawn stay plain."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    cuts = boundaries(codes, unit)
    n = len(cuts) - 1
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted(int(cuts[d % (n + 1)]) for d in draws[:2])
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le") for piece in (codes[:a], codes[a:b], codes[b:]))
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws_of(key: Column, seed: int) -> list[Column]:
    """Four draws: the first groups of eight digits of the hex sha256 of the seed, a colon and the key (nothing, if it is null)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, for every row.

    Of texts that can be cut `percent` of 100 are, of these `spm_percent` with the suffix first. Null texts are empty, and empty texts stay plain, as do those that hold a mark. Rows with one doc_id (null is one) have equal draws, repeated rows
    equal results. Very long texts are one array of four bytes a code point at a time. An empty table gives no rows; other columns are left behind, whatever their names.
    """
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(draws_of(F.col("doc_id"), seed))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            found = [transform(t.as_py(), d, unit, percent, spm_percent) for t, d in zip(batch.column(1), draws, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No piece holds a mark, and no two marks overlap, so the three marks part an output in one way only."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
