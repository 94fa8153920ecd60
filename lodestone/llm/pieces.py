"""SentencePiece encoding and decoding, giant texts by a max-plus parallel scan.

The model is a BPE one with byte fallback, so the score to be maximal is not a sum of piece scores: a sequence of pieces is the encoding of
a text exactly if every two neighbours are the encoding of their own concatenation. In max-plus terms a step from a piece to the next weighs 0 if the pair is such a
pair and minus infinity if not, and the encoding is the one path of weight 0.

A text longer than a chunk is cut at fixed places. The state at a cut is the piece that lies across it or ends at it (how much of it stands left of the cut, and which piece). Each
chunk yields the transfer matrix from the states at its left cut to those at its right: kept as sparse rows, a matrix has its 0 entries only. The matrices are combined associatively (a prefix product over the
chunks of a text), which fixes the state at every cut; each chunk then backtraces on its own. All three steps run on executors, a chunk at a time; only matrices meet, in the one row of their text.

No piece of the model goes on beyond a space (a space mark stands only at the beginning of a piece, or in a run of marks), so all that lies between the first and the last such place of a
chunk does not depend on its states and is encoded by the library. Texts of one chunk have one state on either side, and are the library's call.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import tune

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk. A model file is at most so large, which bounds what is sent to executors.
CHUNK, MAX_MODEL = 1 << 16, 64 << 20
MARK = "▁"
State = tuple[int, str]


class Pieces:
    """A model's vocabulary with the test for pairs."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.lib.get_piece_size()
        special = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i) for i in range(n)]
        self.text = [self.lib.id_to_piece(i) for i in range(n)]
        self.score = [self.lib.get_score(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if self.lib.is_byte(i)}
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of this model go on beyond spaces, so chunks have no safe places")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.proper: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE as the library does it: join the neighbours with the highest score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
        return found

    def nodes(self, text: str, at: int) -> list[str]:
        """All pieces of the text that end at a place and encode to themselves; a character outside the vocabulary counts as one."""
        out = [text[at - 1]]
        for n in range(2, min(self.longest, at) + 1):
            q = text[at - n : at]
            if q in self.id:
                proper = self.proper.get(q)
                if proper is None:
                    proper = self.proper[q] = self.merge(q) == [q]
                if proper:
                    out.append(q)
        return out

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.id:
                out.append(self.id[p])
            else:
                out += [self.byte[b] for b in p.encode()] if self.byte else [self.lib.unk_id()]
        return out

    def marked(self, text: str) -> str:
        """The text as the model sees it: a mark before it and for each space."""
        return MARK + text.replace(" ", MARK) if text else ""


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def safe(text: str, at: int) -> bool:
    """No piece goes across a place before a mark that follows another character, nor across the ends of the text."""
    return at in (0, len(text)) or text[at] == MARK != text[at - 1]


def states(p: Pieces, text: str, cut: int) -> list[State]:
    """The states at a cut, (where its piece ends, piece): one with no piece if the cut is safe, else all pieces that end there or lie across."""
    if safe(text, cut):
        return [(cut, "")]
    out = []
    for end in range(cut, min(len(text), cut + p.longest - 1) + 1):
        out += [(end, q) for q in p.nodes(text, end) if end - len(q) < cut]
    return out


def stretch(p: Pieces, text: str, low: int, high: int, enter: list[State]) -> list[dict[str, int]]:
    """Forward from the entering states: for each place from low to high, the pieces that end there, each with the bit set of the
    states from which a path of weight 0 leads to it."""
    reach: list[dict[str, int]] = [{} for _ in range(high - low + 1)]
    for i, (end, piece) in enumerate(enter):
        if end <= high:
            reach[end - low][piece] = reach[end - low].get(piece, 0) | 1 << i
    for at in range(low + 1, high + 1):
        here = reach[at - low]
        for piece in p.nodes(text, at):
            begin = at - len(piece)
            if begin < low:
                continue
            bits = 0
            for before, b in reach[begin - low].items():
                if b & ~bits and (before == "" or p.fits(before, piece)):
                    bits |= b
            if bits:
                here[piece] = here.get(piece, 0) | bits
    return reach


def transfer(p: Pieces, text: str, low: int, enter: list[State], leave: list[State]) -> list[int]:
    """The transfer matrix: for each entering state the bit set of the leaving states that it reaches with weight 0."""
    reach = stretch(p, text, low, max(e for e, _ in leave), enter)
    rows = [0] * len(enter)
    for j, (end, piece) in enumerate(leave):
        there = reach[end - low]
        bits = there.get(piece, 0)
        if not piece:
            for b in there.values():
                bits |= b
        for i in range(len(enter)):
            rows[i] |= (bits >> i & 1) << j
    return rows


def backtrace(p: Pieces, text: str, low: int, enter: State, leave: State) -> list[str]:
    """The pieces of the path from enter to leave: without enter's, with leave's."""
    if enter == leave:
        return []
    reach = stretch(p, text, low, leave[0], [enter])
    end, piece = leave[0], leave[1] or next(q for q in reach[leave[0] - low] if q)
    out: list[str] = []
    while (end, piece) != enter:
        out.append(piece)
        end -= len(piece)
        piece = next(q for q in reach[end - low] if q == "" or p.fits(q, piece))
    return out[::-1]


def combine(a: list[int], b: list[int]) -> list[int]:
    """The max-plus product of two transfer matrices of zeros and minus infinities."""
    out = []
    for row in a:
        bits, j = 0, 0
        while row >> j:
            if row >> j & 1:
                bits |= b[j]
            j += 1
        out.append(bits)
    return out


def prefix_products(matrices: list[list[int]]) -> list[list[int]]:
    """All products from the first matrix on: neighbours are combined, the half as many scanned alike, and the rest filled in."""
    if len(matrices) < 2:
        return matrices
    pairs = prefix_products([combine(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    return [matrices[0]] + [pairs[i // 2] if i % 2 else combine(pairs[i // 2 - 1], matrices[i]) for i in range(1, len(matrices))]


def choose_states(matrices: list[list[int]]) -> list[int]:
    """The number of the state after each chunk on the one path from the beginning to the end."""
    prefix = prefix_products(matrices)
    if not prefix[-1][0] & 1:
        raise ValueError("no sequence of pieces leads to the end; the model's pairs do not describe its encodings")
    chosen = [0]
    for k in range(len(matrices) - 1, 0, -1):
        fit = [u for u, row in enumerate(matrices[k]) if prefix[k - 1][0] >> u & 1 and row >> chosen[-1] & 1]
        chosen.append(fit[0])
    return chosen[::-1]


class Chunk:
    """A chunk of a marked text, seen with some context: the text from `start` on, of which [low, high) is the chunk."""

    def __init__(self, p: Pieces, text: str, low: int, high: int):
        self.p, self.text, self.low, self.high = p, text, low, high
        self.enter, self.leave = states(p, text, low), states(p, text, high)
        data = np.frombuffer(text[low : high + 1].encode("utf-32-le"), np.uint32)
        found = np.flatnonzero((data[1:] == ord(MARK)) & (data[:-1] != ord(MARK))) + 1
        places = [low] * (self.enter == [(low, "")]) + (found + low).tolist() + [high] * (self.leave == [(high, "")])
        self.safe = (places[0], places[-1]) if places else None

    def matrix(self) -> list[int]:
        if not self.safe:
            return transfer(self.p, self.text, self.low, self.enter, self.leave)
        a, b = self.safe
        head = transfer(self.p, self.text, self.low, self.enter, [(a, "")])
        tail = transfer(self.p, self.text, b, [(b, "")], self.leave)
        return combine(head, tail)

    def ids(self, enter: int, leave: int) -> list[int]:
        p, first, last = self.p, self.enter[enter], self.leave[leave]
        if not self.safe:
            return p.ids(backtrace(p, self.text, self.low, first, last))
        a, b = self.safe
        # The library puts the first mark itself.
        inner = p.lib.encode(self.text[a + 1 : b]) if b > a + 1 else p.ids([MARK] * (b - a))
        return p.ids(backtrace(p, self.text, self.low, first, (a, ""))) + inner + p.ids(backtrace(p, self.text, b, (b, ""), last))


def cut(p: Pieces, text: str, chunk: int) -> list[tuple[str, int, int]]:
    """(context, low, high) of each chunk of a text, in the marked text. Contexts overlap by what states and safe places need."""
    marked, margin = p.marked(text), 2 * p.longest
    out = []
    for low in range(0, len(marked), chunk):
        high = min(low + chunk, len(marked))
        begin, end = max(0, low - margin), min(len(marked), high + margin)
        out.append((marked[begin:end], low - begin, high - begin))
    return out


def encode_in_chunks(p: Pieces, text: str, chunk: int) -> list[int]:
    """The whole scan in one place, as the distributed one does it."""
    chunks = [Chunk(p, *c) for c in cut(p, text, chunk)]
    if not chunks:
        return []
    after = choose_states([c.matrix() for c in chunks])
    return [i for c, a, b in zip(chunks, [0, *after], after, strict=False) for i in c.ids(a, b)]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        out = f.read(MAX_MODEL + 1)
    if len(out) > MAX_MODEL:
        raise ValueError(f"{path} has more than {MAX_MODEL} bytes")
    return out


class Words:
    """Encodes texts by their stretches between safe places, of which each different one is encoded once by the library.

    A stretch begins with the space after a word (at the beginning of a text, with the mark that the model puts there), so it encodes as its bytes without that space do as a text of their own.
    """

    LIMIT = 1 << 18

    def __init__(self, p: Pieces):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.keys, self.rank = np.zeros(0, tb.U64), np.zeros(0, np.int64)
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        found = [ids if t else self.p.ids([MARK]) for t, ids in zip(texts, self.p.lib.encode([t.decode() for t in texts], num_threads=1), strict=True)]
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found])])
        keys, rank = np.concatenate([self.keys, keys]), np.concatenate([self.rank, len(self.rank) + np.arange(len(keys))])
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has. The texts hold no mark themselves."""
        space = data == 0x20
        first = np.zeros(len(data) + 1, bool)
        full = offsets[1:] > offsets[:-1]
        first[offsets[:-1][full]] = True
        begin = first[:-1].copy()
        begin[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
        start = np.flatnonzero(begin)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        inner = start + ~first[start]
        length = end - inner
        # The first byte of each stretch that is not its own space has power 0; an empty stretch hashes to its length.
        power = tb.powers(int(length.max()) + 1)[np.maximum(np.arange(len(data)) - np.repeat(inner, end - start), 0)]
        power[start[inner > start]] = 0
        hashed = tb.mix(np.add.reduceat(tb.BYTE[data] * power, start) + length.astype(tb.U64))
        keys, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        if (new := ~self.has(keys)).any():
            if len(self.rank) + int(new.sum()) > self.LIMIT:
                self.clear()
                new = np.ones(len(keys), bool)
            raw = data.tobytes()
            self.learn(keys[new], [raw[inner[i] : end[i]] for i in at[new]])
        which = self.rank[np.searchsorted(self.keys, keys)][back]
        n = (self.start[1:] - self.start[:-1])[which]
        total = int(n.sum())
        out = self.ids[np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(total)]
        return out, np.bincount(np.searchsorted(offsets, start, "right") - 1, n, minlength=len(offsets) - 1).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


@lru_cache(maxsize=2)
def words_of(model: bytes) -> Words:
    return Words(pieces(model))


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((i for v in values for i in v), np.int32, int(ends[-1]))))


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids, n_chunks: the library's own encoding of each whole text; with `decoded`, also the text that the ids give back (in the same pass, by the same worker).

    Null texts are taken as empty and give no ids; repeated rows come out as often as they went in, null ids too; texts of a chunk or more are scanned, however long; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    tune(spark)
    if chunk < 64:
        raise ValueError("a chunk has 64 characters at least")
    sent = spark.sparkContext.broadcast(model_bytes(model))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short, giant = rows.where(F.length("text") < chunk), rows.where(F.length("text") >= chunk).withColumn("of", F.xxhash64("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, by_word = pieces(sent.value), words_of(sent.value)
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                if MARK.encode() in part.tobytes():
                    ids = _lists(p.lib.encode(batch.column(1).slice(low, high - low).to_pylist(), num_threads=1))
                else:
                    found, n = by_word.encode(part, at)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(found))
                columns = [batch.column(0).slice(low, high - low), ids, pa.array(np.ones(high - low, np.int32))] + ([texts_of(p, ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_chunks", "decoded"][: len(columns)])
                low = high

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                found = cut(p, batch.column(1)[i].as_py(), chunk)
                same = pa.array(np.zeros(len(found), np.int64))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0).take(same), one.column(2).take(same), pa.array(range(len(found)), pa.int32()), pa.array([c[0] for c in found]), pa.array([c[1] for c in found], pa.int32()), pa.array([c[2] for c in found], pa.int32())], names=["doc_id", "of", "chunk", "context", "low", "high"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            made = [",".join(f"{r:x}" for r in Chunk(p, *(batch.column(j)[i].as_py() for j in (3, 4, 5))).matrix()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["doc_id", "of", "chunk", "matrix"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = [choose_states([[int(r, 16) for r in m["matrix"].split(",")] for m in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists([[0, *a] for a in after])], names=["doc_id", "of", "states"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            ids = [Chunk(p, *(batch.column(j)[i].as_py() for j in (3, 4, 5))).ids(batch.column(6)[i].as_py(), batch.column(7)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(ids)], names=["doc_id", "of", "chunk", "ids"])

    key = f"doc_id {kind}, of long"
    # Equal giant texts of one id are scanned once. The chunks of a text go to many tasks.
    chunks = giant.dropDuplicates(["doc_id", "of"]).mapInArrow(cut_up, f"{key}, chunk int, context string, low int, high int").repartition("of", "chunk")
    made = chunks.mapInArrow(matrices, f"{key}, chunk int, matrix string")
    chosen = made.groupBy("doc_id", "of").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("m")).mapInArrow(paths, f"{key}, states array<int>")
    chosen = chosen.select(F.col("doc_id").alias("d"), F.col("of").alias("o"), F.posexplode("states").alias("n", "enter"), "states").where("n < size(states) - 1")
    traced = chunks.join(chosen, (F.col("of") == F.col("o")) & (F.col("chunk") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "of", "chunk", "context", "low", "high", "enter", F.col("states")[F.col("n") + 1].alias("leave")).mapInArrow(trace, f"{key}, chunk int, ids array<int>")
    joined = traced.groupBy(F.col("doc_id").alias("d"), F.col("of").alias("o")).agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    long_ones = giant.select("doc_id", "of").join(joined, (F.col("of") == F.col("o")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", F.flatten(F.transform("c", lambda c: c.ids)).alias("ids"), F.size("c").alias("n_chunks"))
    schema = f"doc_id {kind}, ids array<int>, n_chunks int"
    if decoded:
        return short.mapInArrow(whole, f"{schema}, decoded string").unionByName(decode(long_ones, model))
    return short.mapInArrow(whole, schema).unionByName(long_ones)


def texts_of(p: Pieces, column: pa.Array) -> pa.Array:
    """The texts of lists of ids; null for null."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    there = np.flatnonzero(np.asarray(column.is_valid()))
    found = dict(zip(there.tolist(), p.lib.decode([values[at[i] : at[i + 1]].tolist() for i in there], num_threads=1), strict=True))
    return pa.array([found.get(i) for i in range(len(column))], pa.string())


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of `encoded` (with ids) and `decoded`, the text that the ids stand for. Null ids give null."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(model_bytes(model))
    place = encoded.columns.index("ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(p, part.column(place))], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(texts, f"{schema}, decoded string")
