"""SentencePiece encoding and decoding, with a max-plus scan for giant texts.

Between two characters that no piece of the model holds side by side, every
segmentation has a cut. Texts are therefore encoded segment by segment, and
segments seen before come from a cache.

A giant text is dealt out in chunks, which may begin inside a segment. The
state at a chunk's edge is the unit (piece, or character in byte fallback)
that starts last before it. For a unigram model a path weighs the sum of its
pieces' scores. For a BPE model it weighs 0, or minus infinity if two
neighbours aren't what BPE makes of their concatenation: just one path is
left, and it is the BPE encoding. A chunk yields its transfer matrix, the
greatest weight of a path between each state at its left edge and each at its
right edge. The matrices of a text, a few numbers per chunk, are multiplied
in the (max, +) semiring, whose product is associative: in rounds each task
multiplies FAN neighbours at most, until a text has one matrix; then the
states at the edges are handed down the same tree, and each chunk traces its
own path back.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from recallgrid.llm._spark import Scratch, bounded_batches, map_rows

BPE, UNIGRAM = 2, 1
BLANK = "▁"
GIANT_CHARS = 32_768
CHUNK_CHARS = 16_384
CACHE_MOST = 100_000
FAN = 64

State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


class Model:
    """A BPE or unigram model with byte fallback and identity normalization,
    read from the bytes of its file."""

    def __init__(self, proto: bytes):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        self.kind = spec.trainer_spec.model_type
        plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        if self.kind not in (BPE, UNIGRAM) or not spec.trainer_spec.byte_fallback or not plain or any(p.type == 4 for p in spec.pieces):
            raise ValueError("the model must be BPE or unigram, with byte fallback, identity normalization and no user-defined pieces")
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        spec.normalizer_spec.add_dummy_prefix = False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        pieces = {p.piece.replace(BLANK, " "): (k, p.score) for k, p in enumerate(spec.pieces) if p.type == 1}
        self.score = {piece: score for piece, (_, score) in pieces.items()}
        self.unknown_score = min(self.score.values()) - 10.0
        self.longest = max(map(len, pieces))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.bytes_of = []
        for p in spec.pieces:
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", p.piece) if p.type == 6 else None
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else b" \xe2\x81\x87 " if p.type == 2 else b"" if p.type == 3 else p.piece.replace(BLANK, " ").encode())
        # a blank after anything else, and a line's end, cut if the vocabulary lets them
        blank_cuts = not any(pair[1] == " " and pair[0] != " " for pair in self.inside)
        line_cuts = not any("\n" in pair for pair in self.inside)
        rest = "[^ \n]" if line_cuts else "[^ ]"
        self.segment = re.compile(rf" +{rest}*|{rest}+" + ("|\n+" if line_cuts else "")) if blank_cuts else re.compile(r"[\s\S]+")
        self.cache: dict[str, bytes] = {}
        self.units: dict[str, list[int] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def input(self, text: str) -> str:
        """What is encoded: the text with the model's prefix. The library
        takes U+2581 for a blank, too."""
        return self.prefix + text.replace(BLANK, " ") if text else ""

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """int32 ids of each text, as input() gives it."""
        parts = [self.segments(t) for t in texts]
        if len(self.cache) > CACHE_MOST:
            self.cache.clear()
        if new := list({s for segments in parts for s in segments if s not in self.cache}):
            for segment, ids in zip(new, self.raw.encode(new, num_threads=1), strict=True):
                self.cache[segment] = np.asarray(ids, dtype=np.int32).tobytes()
        return [b"".join(map(self.cache.__getitem__, segments)) for segments in parts]

    def unit(self, text: str) -> list[int] | None:
        """The ids of a string that can be a unit, else None."""
        if text not in self.units:
            if len(self.units) > CACHE_MOST:
                self.units.clear()
            ids = None
            if text in self.score:
                ids = [self.raw.piece_to_id(text.replace(" ", BLANK))]
                if self.kind == BPE and self.raw.encode(text) != ids:
                    ids = None  # no merges lead to this piece
            elif len(text) == 1:
                ids = self.raw.encode(text)
            self.units[text] = ids
        return self.units[text]

    def follows(self, a: str, b: str) -> bool:
        if self.kind == UNIGRAM:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > CACHE_MOST:
                self.pairs.clear()
            self.pairs[a, b] = self.raw.encode(a + b) == self.unit(a) + self.unit(b)
        return self.pairs[a, b]

    def weight(self, unit: str) -> float:
        return 0.0 if self.kind == BPE else self.score.get(unit, self.unknown_score)


class Chunk:
    """The characters text[begin:end], with up to model.longest more on both
    sides; at_start, at_end: text begins or ends where the whole text does."""

    def __init__(self, model: Model, text: str, begin: int, end: int, at_start: bool, at_end: bool):
        self.model, self.text, self.begin, self.end, self.at_start, self.at_end = model, text, begin, end, at_start, at_end

    def cut(self, x: int) -> bool:
        if x in (0, len(self.text)):
            return self.at_start if x == 0 else self.at_end
        return self.text[x - 1 : x + 1] not in self.model.inside

    def states(self, x: int) -> list[State]:
        """Units over the edge x, as places relative to it; (0, 0): a cut."""
        if self.cut(x):
            return [(0, 0)]
        most = self.model.longest
        return [(s - x, e - x) for s in range(max(0, x - most), x) for e in range(x, min(len(self.text), s + most) + 1) if self.model.unit(self.text[s:e]) is not None]

    def spread(self, start: int, entry: State, stop: int) -> dict[tuple[int, int], tuple[float, tuple[int, int] | None]]:
        """The best weight of each unit that a path from the entry reaches
        and that starts before stop, and the unit before it."""
        text, model = self.text, self.model
        at = start + entry[1]
        found: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        first = None if entry == (0, 0) else (start + entry[0], at)
        if at >= stop:
            return {first: (0.0, None)} if first else {}
        todo = {at}
        while todo:
            here = min(todo)
            todo.remove(here)
            before = ending.get(here) or [first]
            for e in range(here + 1, min(len(text), here + model.longest) + 1):
                if e - 1 > here and text[e - 2 : e] not in model.inside:
                    break
                unit = text[here:e]
                if model.unit(unit) is None:
                    continue
                best = None
                for prior in before:
                    if prior is None or prior[1] != here or model.follows(text[prior[0] : prior[1]], unit):
                        weight = (found[prior][0] if prior in found else 0.0) + model.weight(unit)
                        if best is None or weight > best[0]:
                            best = (weight, prior if prior in found else None)
                if best is not None:
                    found[here, e] = best
                    ending.setdefault(e, []).append((here, e))
                    if e < stop:
                        todo.add(e)
        return found

    def reached(self, start: int, entry: State, stop: int) -> dict[State, float]:
        """Weights of the states at stop."""
        if start == stop and entry == (0, 0):
            return {(0, 0): 0.0}
        cut = self.cut(stop)
        out: dict[State, float] = {}
        for (s, e), (weight, _) in self.spread(start, entry, stop).items():
            if e >= stop and (not cut or e == stop):
                state = (0, 0) if cut else (s - stop, e - stop)
                out[state] = max(weight, out.get(state, -np.inf))
        return out

    def path(self, start: int, entry: State, stop: int, exit_: State) -> list[int]:
        """Ids of the best path's units that start from start on."""
        if start == stop:
            return []
        found = self.spread(start, entry, stop)
        ends = [(w, u) for u, (w, _) in found.items() if u[1] >= stop and (exit_ == (0, 0) or u == (stop + exit_[0], stop + exit_[1]))]
        if not ends:
            return []
        unit, ids = max(ends)[1], []
        while unit is not None and unit[0] >= start:
            ids.append(self.model.unit(self.text[unit[0] : unit[1]]))
            unit = found[unit][1]
        return [k for one in reversed(ids) for k in one]

    def cuts(self) -> tuple[int, int] | None:
        """The first and the last cut of begin..end."""
        first = next((x for x in range(self.begin, self.end + 1) if self.cut(x)), None)
        return None if first is None else (first, next(x for x in range(self.end, self.begin - 1, -1) if self.cut(x)))

    def matrix(self) -> Matrix:
        """All weights between cuts inside the chunk are the same for every
        path, so they are left out."""
        inner = self.cuts()
        if inner is None:
            return {entry: self.reached(self.begin, entry, self.end) for entry in self.states(self.begin)}
        leaving = self.reached(inner[1], (0, 0), self.end)
        entering = {entry: self.reached(self.begin, entry, inner[0]).get((0, 0)) for entry in self.states(self.begin)}
        return {entry: {state: w + v for state, v in leaving.items()} for entry, w in entering.items() if w is not None}

    def trace(self, entry: State, exit_: State) -> bytes:
        """Ids of the units that start inside the chunk."""
        inner = self.cuts()
        if inner is None:
            return np.asarray(self.path(self.begin, entry, self.end, exit_), dtype=np.int32).tobytes()
        head = self.path(self.begin, entry, inner[0], (0, 0))
        tail = self.path(inner[1], (0, 0), self.end, exit_)
        middle = self.model.encode([self.text[inner[0] : inner[1]]])[0]
        return np.asarray(head, dtype=np.int32).tobytes() + middle + np.asarray(tail, dtype=np.int32).tobytes()


def product(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product: first a, then b."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, float] = {}
        for k, w in row.items():
            for j, v in b.get(k, {}).items():
                best[j] = max(best.get(j, -np.inf), w + v)
        if best:
            out[i] = best
    return out


def products(matrices: list[Matrix]) -> Matrix:
    """The product of all, taken pair by pair, and pairs of those, and so on."""
    while len(matrices) > 1:
        pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0]


def edge_states(matrices: list[Matrix], entry: State = (0, 0), exit_: State = (0, 0)) -> list[State]:
    """The state at every edge of some consecutive chunks (or runs of chunks),
    of the best path through them from entry to exit_: a state halfway splits
    the path in two, and so on."""
    if len(matrices) == 1:
        return [entry, exit_]
    half = len(matrices) // 2
    left, right = products(matrices[:half]), products(matrices[half:])
    ways = [(w + right[s][exit_], s) for s, w in left.get(entry, {}).items() if exit_ in right.get(s, {})]
    middle = max(ways)[1]
    return edge_states(matrices[:half], entry, middle)[:-1] + edge_states(matrices[half:], middle, exit_)


def chunks_of(model: Model, text: str, size: int) -> list[tuple[str, int, int, bool, bool]]:
    """The arguments of the Chunks of a text, as input() gives it."""
    out = []
    for b in range(0, len(text), size):
        e = min(b + size, len(text))
        a, z = max(0, b - model.longest), min(len(text), e + model.longest)
        out.append((text[a:z], b - a, e - a, a == 0, z == len(text)))
    return out


def encode_by_chunks(model: Model, text: str, size: int) -> list[int]:
    """The ids of one text by the scan, all in this process."""
    if not text:
        return []
    chunks = [Chunk(model, *c) for c in chunks_of(model, model.input(text), size)]
    states = edge_states([c.matrix() for c in chunks])
    return np.frombuffer(b"".join(c.trace(states[k], states[k + 1]) for k, c in enumerate(chunks)), dtype=np.int32).tolist()


def _ids(encoded: list[bytes]) -> pa.Array:
    sizes = np.array([0] + [len(x) // 4 for x in encoded], dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum(sizes)), pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))).cast(pa.list_(pa.int32()))


def _whole(proto: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = _ids(model.encode([model.input(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["doc_id", "text", "ids"])

    return run


def _deal(proto: bytes, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = chunks_of(model, model.input(text.as_py()), size)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    columns = [[row] * len(some), list(range(i, i + len(some))), *map(list, zip(*some, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], names=["row", "part", "chunk", "begin", "stop", "at_start", "at_end"])

    return run


CHUNKS = "row long, part int, chunk string, begin int, stop int, at_start boolean, at_end boolean"


def _cells(matrix: Matrix) -> list[list[float]]:
    return [[*i, *j, w] for i, row in matrix.items() for j, w in row.items()]


def _matrix(cells: list[list[float]]) -> Matrix:
    matrix: Matrix = {}
    for a, b, c, d, w in cells:
        matrix.setdefault((int(a), int(b)), {})[int(c), int(d)] = w
    return matrix


CELLS = "row long, part int, cells array<array<double>>"
EDGES = "row long, part int, edges array<int>"


def _transfer(proto: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        for batch in batches:
            cells = [_cells(Chunk(model, *args).matrix()) for _, _, *args in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.list_(pa.float64())))], names=["row", "part", "cells"])

    return run


def _in_order(parts: list[dict]) -> tuple[list[int], list[Matrix]]:
    parts = sorted(parts, key=lambda p: p["part"])
    return [p["part"] for p in parts], [_matrix(p["cells"]) for p in parts]


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, group, parts) to the product of each group's matrices."""
    for batch in batches:
        cells = [_cells(products(_in_order(parts)[1])) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.list_(pa.float64())))], names=["row", "part", "cells"])


def _hand_down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, group, parts, edges), edges being the states before and after the
    group, to those before and after each of its parts."""
    for batch in batches:
        for row, parts, (a, b, c, d) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            numbers, matrices = _in_order(parts)
            states = edge_states(matrices, (a, b), (c, d))
            edges = [[*x, *y] for x, y in zip(states, states[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(edges), pa.int64()), pa.array(numbers, pa.int32()), pa.array(edges, pa.list_(pa.int32()))], names=["row", "part", "edges"])


def _scan(scratch: Scratch, matrices: DataFrame, most: int, fan: int) -> DataFrame:
    """(row, part, edges): the states before and after each part. The scan
    goes up in rounds, in which each task multiplies fan neighbours of a text
    at most, until a text has one matrix, and hands states down again.
    most: the greatest part."""
    levels, n = [], most + 1
    while n > 1:
        group = F.floor(F.col("part") / fan).cast("int").alias("group")
        levels.append(scratch.keep(matrices.groupBy("row", group).agg(F.collect_list(F.struct("part", "cells")).alias("parts"))))
        n = -(-n // fan)
        matrices = levels[-1].mapInArrow(_combine, CELLS)
    edges = matrices.select("row", "part", F.array(*[F.lit(0)] * 4).alias("edges"))
    for level in reversed(levels):
        edges = level.join(edges.withColumnRenamed("part", "group"), ["row", "group"]).select("row", "group", "parts", "edges").mapInArrow(_hand_down, EDGES)
    return edges


def _trace(proto: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        for batch in batches:
            found = []
            for _, _, *args, (a, b, c, d) in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.append(Chunk(model, *args).trace((a, b), (c, d)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ids(found)], names=["row", "part", "ids"])

    return run


def encode(docs: DataFrame, model_file: str, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: doc_id, text, n_tokens, ids, the ids
    being those the SentencePiece library gives for the whole text.

    The model's file is read here and sent with the code. Texts of over
    giant_chars characters are dealt out by chunks of chunk_chars. Null and
    empty texts have no ids. Repeated rows and null doc_ids are kept; columns
    besides doc_id and text are not read; an empty table gives no rows.
    """
    with open(model_file, "rb") as file:
        proto = file.read()
    Model(proto)  # refuses what it can't serve
    scratch = Scratch(docs.sparkSession, "sentencepiece")
    rows = docs.select("doc_id", "text")
    big = F.length("text") > giant_chars
    whole = rows.where(F.coalesce(~big, F.lit(True))).mapInArrow(_whole(proto), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")
    giants = scratch.keep(rows.where(big).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    chunks = scratch.keep(giants.select("row", "text").mapInArrow(_deal(proto, chunk_chars), CHUNKS).repartition("row", "part"))
    matrices = chunks.repartition("row", "part").mapInArrow(_transfer(proto), CELLS)
    edges = _scan(scratch, matrices, chunks.agg(F.max("part")).first()[0] or 0, fan)
    traced = chunks.join(edges, ["row", "part"]).select(*chunks.columns, "edges").mapInArrow(_trace(proto), "row long, part int, ids array<int>")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    dealt = giants.join(joined, "row").select("doc_id", "text", "ids")
    return whole.unionByName(dealt).select("doc_id", "text", F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded, a table with a column ids, and its column decoded (replaced, if
    there is one): the text of the ids; null ids give an empty text, bytes
    that aren't UTF-8 U+FFFD."""
    bounded_batches(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    with open(model_file, "rb") as file:
        proto = file.read()
    at = encoded.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        table = np.array(model.bytes_of, dtype=object)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = part.column(at)
                values = table[ids.flatten().to_numpy(zero_copy_only=False)]
                stop = np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                texts = [b"".join(values[a:b]).decode("utf-8", "replace") for a, b in zip(np.concatenate([[0], stop[:-1]]), stop, strict=True)]
                if model.prefix:
                    texts = [t.removeprefix(" ") for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_rows(encoded, run, "decoded string")
