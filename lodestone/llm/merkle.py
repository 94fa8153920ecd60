"""A Merkle manifest of a dataset: a digest for each row, one tree over all, and for each row the path that proves it.

Rows stand in order within their group; every eight neighbours have one parent, level by level, until a group has one node, and the groups' nodes make up a tree of their own. Ranks come from a range-partitioned sort (a group is cut
anywhere, so none is too large), and a tree is worked on in aligned blocks of FAN ** DEPTH nodes, all blocks side by side. The roots of the blocks are the nodes of the next round, which is so much smaller. Then the rounds are walked
back: each block gets the path above it, its nodes append their own. Within a block the path of the next leaf comes from the one before: each level has the run of nodes that it is in, and a treehash stack that builds
the run after it from one leaf at each step, so it is ready when the leaves get there.

Digests are 64 hex digits, as text, in all inputs of H.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.llm.exchange import partitions, tune, written

#: Children of a node; levels of a block; digits of a digest.
FAN, DEPTH, DIGEST = 8, 3, 64

Path = list[tuple[bytes, bytes]]


def H(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


class Treehash:
    """Builds the nodes of one level from leaves that come one by one; of each level below only an open run is held."""

    def __init__(self, level: int):
        self.stacks: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def add(self, node: bytes, level: int = 0) -> None:
        for stack in self.stacks[level:]:
            stack.append(node)
            if len(stack) < FAN:
                return
            node = H(b"".join(stack))
            stack.clear()
        self.nodes.append(node)

    def finish(self) -> list[bytes]:
        """The nodes, those of runs that have ended short among them."""
        for level, stack in enumerate(self.stacks):
            if stack:
                node = H(b"".join(stack))
                stack.clear()
                self.add(node, level + 1)
        return self.nodes


def block_root(leaves: Iterator[bytes] | Sequence[bytes], depth: int) -> bytes:
    tree = Treehash(depth)
    for leaf in leaves:
        tree.add(leaf)
    return tree.finish()[0]


def traverse(leaves: Sequence[bytes], depth: int) -> Iterator[Path]:
    """The path of each leaf within its block, from the bottom up: the siblings before and after its node. Besides the leaves it holds two runs and a stack for each level."""

    def first_run(level: int) -> list[bytes]:
        tree = Treehash(level)
        for leaf in leaves[: FAN ** (level + 1)]:
            tree.add(leaf)
        return tree.finish()

    now, ahead = [first_run(level) for level in range(depth)], [Treehash(level) for level in range(depth)]
    for i in range(len(leaves)):
        path = []
        for level in range(depth):
            run = FAN ** (level + 1)
            if i and i % run == 0:
                now[level], ahead[level] = ahead[level].finish(), Treehash(level)
            if i + run < len(leaves):
                ahead[level].add(leaves[i + run])
            at = i % run // FAN**level
            path.append((b"".join(now[level][:at]), b"".join(now[level][at + 1 :])))
        yield path


def folded(node: bytes, path: Path) -> bytes:
    """The root that a node and its path give."""
    for before, after in path:
        node = H(before + node + after)
    return node


def levels_of(n: int) -> int:
    """Levels above n leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def pack(path: Path) -> str:
    return "|".join(f"{b.decode()},{a.decode()}" for b, a in path)


def unpack(packed: str) -> Path:
    return [tuple(x.encode() for x in step.split(",")) for step in packed.split("|")] if packed else []


def leaf_of(columns: Sequence[Column]) -> Column:
    """H of the values one after another: `-` for null, else the number of its bytes, a colon and the value."""
    each = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*each), 256)


def placed(rows: DataFrame, order: Sequence[str], parts: int, name: str) -> DataFrame:
    """The rows in a global order, with the part that they are in and their place in that order (numbers with gaps). They are written as they come first, so that rows that are equal in all of `order` can be parted too."""
    by = [F.col(c).asc_nulls_first() for c in (*order, "row")]
    told = written(rows.withColumn("row", F.monotonically_increasing_id()), name)
    inside = told.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("row").withColumn("place", F.monotonically_increasing_id())
    return written(inside, f"{name}-placed").withColumn("part", F.shiftright("place", 33))


def runs_of(rows: DataFrame, group: str) -> DataFrame:
    """A row for each part and each group in it: (g, p, first place, size, before: rows of the group in earlier parts, n: its rows in all)."""
    runs = rows.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("*", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("g")).alias("n"))


def numbered(groups: DataFrame, parts: int) -> DataFrame:
    """groups (g) -> (g, key): their places in order, from 0 and without gaps."""
    rows = placed(groups, ["g"], parts, "groups").withColumn("all", F.lit(0))
    runs = runs_of(rows, "all").select("p", "first", "before")
    return rows.join(runs, F.col("part") == F.col("p")).select("g", (F.col("before") + F.col("place") - F.col("first")).alias("key"))


def _by_block(df: DataFrame, parts: int, work: Callable[[tuple, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """work(key, rows) for the rows of each block (key, block), those with the smaller kind first, then by rank. A task holds one block of FAN ** DEPTH rows at a time."""
    dealt = df.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "kind", "rank")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            out.extend(work((held[0]["key"], held[0]["block"]), held))
            held.clear()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)
                out.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["key"], held[0]["block"]) != (row["key"], row["block"]):
                    yield from done()
                held.append(row)
        if held:
            yield from done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def _depth(n: int) -> int:
    return min(DEPTH, levels_of(n))


def _roots(key: tuple, rows: list[dict]) -> Iterator[dict]:
    n = rows[0]["n"]
    yield {"key": key[0], "rank": key[1], "n": -(-n // FAN**DEPTH), "node": block_root((r["node"].encode() for r in rows), _depth(n)).decode()}


def _proofs(key: tuple, rows: list[dict]) -> Iterator[dict]:
    """The proof of each node of a block: its own path, then the one above the block, which all share."""
    head = rows.pop(0)
    above = head["proof"]
    for r, path in zip(rows, traverse([r["node"].encode() for r in rows], _depth(rows[0]["n"])) if rows else (), strict=True):
        own = pack(path)
        yield {"key": key[0], "rank": r["rank"], "proof": f"{own}|{above}" if own and above else own or above, "node": r["node"], "carried": r["carried"], "subroot": head["subroot"]}


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / FAN**DEPTH).cast("long"))


def tops(nodes: DataFrame, parts: int) -> list[DataFrame]:
    """Rounds of (key, rank, n, node): the nodes, then the roots of their blocks, and so on; the last has one node for each key. A small tree's root stays a node by itself while larger trees are not done."""
    rounds = [nodes]
    while True:
        now = _blocks(rounds[-1].select("key", "rank", "n", "node")).withColumn("kind", F.lit(1))
        rounds.append(written(_by_block(now, parts, _roots, "key long, rank long, n long, node string"), "roots"))
        if rounds[-1].where("n > 1").isEmpty():
            return rounds


def proofs(rounds: list[DataFrame], above: DataFrame, parts: int) -> DataFrame:
    """(key, rank, proof, node, carried, subroot) of the nodes of the first round. above (key, proof, subroot) has the path above each key's tree, and its root; `carried` is a column that the first round may have."""
    heads = above.select("key", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), "proof", "subroot")
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        here = _blocks(nodes).withColumn("kind", F.lit(1))
        here = here if "carried" in nodes.columns else here.withColumn("carried", F.lit(None).cast("string"))
        out = _by_block(here.unionByName(heads, allowMissingColumns=True), parts, _proofs, "key long, rank long, proof string, node string, carried string, subroot string")
        if i:
            heads = written(out, "proofs").select("key", F.col("rank").alias("block"), F.lit(0).alias("kind"), "proof", "subroot")
    return out


@F.pandas_udf(StringType())
def fold(leaf: pd.Series, proof: pd.Series) -> pd.Series:
    """The root that a leaf and a proof give."""
    return pd.Series([folded(node.encode(), unpack(path)).decode() for node, path in zip(leaf, proof, strict=True)], dtype=object)


def siblings(proof: Column) -> Column:
    """The digests of a proof one after another, from the bottom to the root and from left to right."""
    return F.translate(proof, ",|", "")


def merkle_manifest(rows: DataFrame, columns: Sequence[str], group: str, order: str, claim: Column | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof (read by `fold` and `siblings`) and claim for every row of a table.

    A leaf is the digest of `columns`; leaves ascend by `order` (a column of numbers or strings) within each value of `group`, null being a value of its own; null comes first in either. Rows with equal order stand in the order of their
    leaves; wholly equal rows have a leaf each. A tree over the roots of the groups, in the bytewise order of their values as strings, joins all. `claim` is the leaf that another state of a row would have (null: the same), and is carried
    along: claims that are not in the dataset fold to another root. Null and empty values differ; texts may be very long, as only digests travel; an empty table gives no rows; other columns are left behind, whatever their names.
    """
    spark = rows.sparkSession
    tune(spark)
    parts = partitions(spark)
    claimed = claim if claim is not None else F.lit(None).cast("string")
    told = rows.select(F.col(group).cast("string").alias("g0"), F.col(order).alias("o"), leaf_of([F.col(c) for c in columns]).alias("node"), claimed.alias("claim"))
    leaves = placed(told, ["g0", "o", "node"], parts, "leaves")
    runs = written(runs_of(leaves, "g0"), "runs")
    keys = written(numbered(runs.select("g").distinct(), parts).select(F.col("g").alias("g1"), "key"), "keys")
    starts = written(runs.join(keys, F.col("g").eqNullSafe(F.col("g1"))).select("g", "key", "p", "first", "before", "n"), "starts")
    # Each part and group meet in a row of their own, so a large group is spread over its parts.
    met = leaves.join(starts, (F.col("part") == F.col("p")) & F.col("g0").eqNullSafe(F.col("g")))
    carried = F.to_json(F.struct("o", "claim"))
    nodes = written(met.select("key", (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "n", "node", carried.alias("carried")), "nodes")
    trees = tops(nodes, parts)
    count = F.lit(keys.count()).cast("long")
    forest = tops(trees[-1].select(F.lit(0).cast("long").alias("key"), F.col("key").alias("rank"), count.alias("n"), "node"), parts)
    top = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    above = written(proofs(forest, top, parts).select(F.col("rank").alias("key"), "proof", F.col("node").alias("subroot")), "above")
    kind = told.schema["o"].dataType.simpleString()
    back = F.from_json("carried", f"o {kind}, claim string")
    out = proofs(trees, above, parts).select(back.alias("c"), "node", "subroot", "proof")
    return out.select(F.col("c.o").alias(order), F.col("node").alias("leaf"), "subroot", forest[-1].select("node").scalar().alias("root"), "proof", F.coalesce("c.claim", "node").alias("claim"))
