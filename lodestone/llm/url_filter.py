"""URL filtering by cascades of Bloom filters.

Rules (host and path prefix, allow or block) are the listed keys, with one cascade for each verdict. Every key that any url of the corpus could fit - the suffixes of its host with as many labels as a rule has, each with the
prefix of its path that is as long as that rule's - is the universe: keys of other shapes equal no rule. Level 1 encodes
the listed keys; level 2 encodes the keys of the universe that level 1 wrongly passes; level 3 the listed keys that level 2
wrongly passes, and so on until a level passes nothing wrongly. A key of the universe is listed exactly if the first level
that rejects it has an even number, so urls are judged by the cascades alone, without the list and without joins. Only the few false positives of a level ever leave
the executors, and they are bounded by the size of the list: a level has as many probes as it takes to pass a quarter of its own keys' number wrongly, of however many
keys it is asked (for level 1, the keys of the universe, counted once), and the list itself is a parameter on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exchange import written
from lodestone.llm.sketch import set_bits

#: Of a level's keys the share of false positives, and the longest filter that is sent along with a plan.
WRONG, MAX_BITS = 0.25, 1 << 26


class Level(NamedTuple):
    bitmap: bytes
    probes: int


def level_size(n: int, others: int) -> tuple[int, int]:
    """Bits and probes of a level of n keys that others are asked for: it passes about WRONG * n of them."""
    probes = max(2, math.ceil(math.log2(max(1.0, others / (WRONG * n)))))
    return max(64, 1 << (math.ceil(probes * n / math.log(2)) - 1).bit_length()), probes


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """`allow`, `org/` -> the host org and the path /."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? or #, with A-Z lowered; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, shapes: Collection[tuple[int, int]]) -> Column:
    """Structs (size, host_size, key, name) of the keys that the url fits, the longest first: one for each shape, which is a number of labels and a length of path. A key is host, \\0 and path."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    every = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(m).alias("length")) for n, m in sorted(shapes)])
    fit = F.filter(every, lambda s: (s.labels <= labels) & (s.length <= F.length(path)))

    def key(s: Column) -> Column:
        h, p = F.call_function("substring_index", host, F.lit("."), -s.labels), F.substring(path, F.lit(1), s.length)
        return F.struct((F.length(h) + s.length).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.lit("\0"), p).alias("key"), F.concat(h, p).alias("name"))

    return F.reverse(F.array_sort(F.transform(fit, key)))


def _probe(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _bitmap(keys: DataFrame, level: int, bits: int, probes: int) -> bytes:
    """The filter of the keys."""
    return set_bits(keys.select(F.explode(F.array(*[_probe(F.col("key"), level, i, bits) for i in range(probes)])).alias("bit")), bits)


def _passes(key: Column, level: int, made: Level) -> Column:
    bits = len(made.bitmap) * 8
    filled = F.lit(bytes(made.bitmap))

    def is_set(i: int) -> Column:
        bit = _probe(key, level, i, bits)
        byte = F.conv(F.hex(F.substring(filled, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7).cast("bigint")).cast("int"))) != 0

    hit = is_set(0)
    for i in range(1, made.probes):
        hit = hit & is_set(i)
    return hit


def build_cascade(universe: DataFrame, listed: DataFrame, n_listed: int, n_universe: int | None = None) -> list[Level]:
    """Levels over the keys of universe (column key) for the listed keys. n_listed and n_universe (distinct keys, about; counted here if not given) are what level 1 is sized by."""
    levels: list[Level] = []
    inside, outside, n = listed, universe, n_listed
    others = universe.agg(F.approx_count_distinct("key")).first()[0] if n_universe is None else n_universe
    while n:
        bits, probes = level_size(n, others)
        if bits > MAX_BITS:
            raise ValueError(f"{n} keys need a filter of {bits} bits; split the list by host")
        level = Level(_bitmap(inside, len(levels) + 1, bits, probes), probes)
        levels.append(level)
        wrong = outside.where(_passes(F.col("key"), len(levels), level)).select("key").distinct()
        if len(levels) == 1:
            # Few keys get here: of all the universe, only what the first level passes.
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = written(wrong, "cascade")
        inside, outside, n, others = wrong, inside, wrong.count(), n
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe: the first level that rejects a key is even only for listed ones."""
    if not levels:
        return F.lit(False)
    verdict = F.lit(len(levels) % 2 == 1)
    for n in range(len(levels), 0, -1):
        verdict = F.when(~_passes(key, n, levels[n - 1]), F.lit(n % 2 == 0)).otherwise(verdict)
    return verdict


def url_filter(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Judge every url: the id, host, path, rule (null if none fits), verdict, n_levels of the cascades.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host and path wins, of equally long
    ones the longer host, and of rules with the same key the last. Urls that no rule fits get `default`. A null or empty url or one without :// has an
    empty host and path and gets the default; the work grows with a url's length alone, however many labels it has. Repeated rows and ids stay as they are; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = pages.sparkSession
    known = {(r.host, r.path): r.verdict for r in rules}
    rows = pages.select(F.col(id_column).alias(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    if not known:
        return rows.select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("n_levels"))
    fits = candidates(F.col("host"), F.col("path"), {(h.count(".") + 1, len(p)) for h, p in known})
    universe = rows.select(F.explode(fits).alias("c")).select("c.key")
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades: dict[str, list[Level]] = {}
    for verdict in sorted(set(known.values())):
        keys = [(f"{h}\0{p}",) for (h, p), v in known.items() if v == verdict]
        cascades[verdict] = build_cascade(universe, spark.createDataFrame(keys, "key string"), len(keys), n_universe)
    verdict_of = lambda key: F.coalesce(*[F.when(is_listed(key, levels), F.lit(v)) for v, levels in cascades.items()])
    judged = F.filter(F.transform(fits, lambda c: F.struct(c.getField("name").alias("name"), verdict_of(c.getField("key")).alias("verdict"))), lambda c: c.verdict.isNotNull())
    best = rows.withColumn("best", F.try_element_at(judged, F.lit(1)))
    n_levels = sum(map(len, cascades.values()))
    return best.select(id_column, "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.lit(n_levels).alias("n_levels"))
