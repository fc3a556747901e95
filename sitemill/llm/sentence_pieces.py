"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

Results equal the library's own encoding of the whole text with the given model (a public BPE model; nothing is
trained). Documents of up to GIANT characters are encoded whole by the library inside a task. Larger ones are
split into chunks that are encoded in parallel:

* A BPE encoding is the one path through the lattice of pieces in which every piece is its own encoding and
  every two neighbours encode to themselves. As weights: 0 for such neighbours, minus infinity otherwise.
* The state at a chunk's boundary is the piece that holds the character before it (its reach to both sides). A
  chunk yields the max-plus matrix from its left states to its right states. Where no piece of the model holds
  two neighbouring characters together, every path has a cut, and the boundary has one state; chunk ends are
  moved to such a cut if one is near.
* Matrices are multiplied in order (max-plus, associative): prefixes forward, suffixes backward. At each boundary
  the state on the best path is where both add up to the maximum.
* Each chunk is then backtraced alone between its two states: by the lattice up to its first cut and from its
  last one, by the library in between.

Null texts give null ids; empty texts give no ids. decode(encode(text)) is the text, but U+2581, which the model
cannot tell from a space, becomes one. Rows are independent, also repeated ones; other columns are kept."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a document is split, characters of a chunk, and how far a chunk's end may move to a cut.
GIANT, CHUNK, NEAR = 1 << 16, 1 << 14, 256
_LOST = -np.inf
_BREAK = "\n"  # in no piece, so what stands after it is encoded as if alone
State = tuple[int, int]  # a piece around a boundary: characters before it (negative) and after it


class Pieces:
    """A model with what the lattice needs: its pieces, the neighbours they hold, and which pieces may follow which."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(self.library.get_piece_size())
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte, self.library.is_unused)
        self.ids = {self.library.id_to_piece(i): i for i in known if not any(f(i) for f in special)}
        self.longest = max(map(len, self.ids))
        self.held = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if any(_BREAK in piece for piece in self.ids):
            raise ValueError("a model with pieces across lines has no neutral break")
        self.alone = lru_cache(1 << 18)(self._alone)
        self.fits = lru_cache(1 << 18)(self._fits)

    def encode(self, text: str) -> list[int]:
        """The encoding of text inside a document, without the space that begins one."""
        return self.library.encode(_BREAK + text)[self._skip() :] if text else []

    @lru_cache(1)  # noqa: B019  one model a worker
    def _skip(self) -> int:
        return len(self.library.encode(_BREAK))

    def _alone(self, piece: str) -> tuple[int, ...] | None:
        """The ids of a piece if it is its own encoding (a single character outside the model is its bytes)."""
        if len(piece) > 1:
            found = self.ids.get(piece)
            return (found,) if found is not None and self.encode(piece) == [found] else None
        return tuple(self.encode(piece))

    def _fits(self, a: str, b: str) -> bool:
        return a[-1] + b[0] not in self.held or tuple(self.encode(a + b)) == self.alone(a) + self.alone(b)

    def cut(self, text: str, at: int) -> bool:
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in self.held


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def boundaries(pieces: Pieces, text: str, chunk: int, near: int = NEAR) -> list[int]:
    """Where the chunks of text begin (one more at the end), at a cut if there is one near."""
    out = [0]
    while out[-1] + chunk < len(text):
        at = out[-1] + chunk
        out.append(next((p for p in range(at, min(at + near, len(text))) if pieces.cut(text, p)), at))
    out.append(len(text))
    return [p for k, p in enumerate(out) if k == 0 or p > out[k - 1]]


def states_at(pieces: Pieces, text: str, at: int) -> list[State]:
    """The pieces that may hold the character before at; a cut is the one state (0, 0)."""
    if pieces.cut(text, at):
        return [(0, 0)]
    low, high = max(0, at - pieces.longest), min(len(text), at + pieces.longest)
    return [(q - at, e - at) for q in range(low, at) for e in range(at, min(high, q + pieces.longest) + 1) if pieces.alone(text[q:e]) is not None]


def lattice(pieces: Pieces, text: str, low: int, high: int, entries: list[State]) -> tuple[list[State], np.ndarray, dict]:
    """All pieces that may be passed from low to high: the states at high, the matrix from entries to them, and each
    piece's possible predecessors. A piece is (start, end); at a cut it is (at, at)."""
    exits = states_at(pieces, text, high)
    done = [(high, high)] if exits == [(0, 0)] else [(q + high, e + high) for q, e in exits]
    index = {piece: k for k, piece in enumerate(done)}
    reach: dict[tuple[int, int], set[int]] = {}
    before: dict[tuple[int, int], set[tuple[int, int]]] = {}
    at_end: dict[int, set[tuple[int, int]]] = {}
    for k, (q, e) in enumerate(entries):
        piece = (low + q, low + e)
        reach.setdefault(piece, set()).add(k)
        at_end.setdefault(piece[1], set()).add(piece)
    closed = len(done) == 1 and done[0] == (high, high)

    def arrive(piece: tuple[int, int], source: tuple[int, int]) -> None:
        reach.setdefault(piece, set()).update(reach[source])
        before.setdefault(piece, set()).add(source)

    for at in range(low, high + 1):
        for piece in at_end.pop(at, ()):
            if at == high and closed and piece != (high, high):
                arrive((high, high), piece)
            if at >= high:
                continue
            last = text[piece[0] : piece[1]]
            for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
                if closed and end > high:
                    break
                word = text[at:end]
                if pieces.alone(word) is not None and (not last or pieces.fits(last, word)):
                    arrive((at, end), piece)
                    if end <= high:
                        at_end.setdefault(end, set()).add((at, end))
    matrix = np.full((len(entries), len(done)), _LOST)
    for piece, sources in reach.items():
        if piece in index:
            matrix[list(sources), index[piece]] = 0.0
    return exits, matrix, before


def cuts_within(pieces: Pieces, text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and the last cut of a chunk, if it has any."""
    first = next((p for p in range(low, high + 1) if pieces.cut(text, p)), None)
    return None if first is None else (first, next(p for p in range(high, low - 1, -1) if pieces.cut(text, p)))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), _LOST)


def transfer(pieces: Pieces, text: str, low: int, high: int) -> tuple[list[State], list[State], np.ndarray]:
    """The states at both ends of a chunk and its matrix. text reaches a piece's length beyond the chunk."""
    entries, cuts = states_at(pieces, text, low), cuts_within(pieces, text, low, high)
    if cuts is None:
        exits, matrix, _ = lattice(pieces, text, low, high, entries)
        return entries, exits, matrix
    _, left, _ = lattice(pieces, text, low, cuts[0], entries)
    exits, right, _ = lattice(pieces, text, cuts[1], high, [(0, 0)])
    return entries, exits, max_plus(left, right)


def best_states(chunks: list[tuple[list[State], list[State], np.ndarray]]) -> list[tuple[State, State]]:
    """The left and right state of each chunk on the best path of the document."""
    forward = [np.zeros((1, 1))]
    for _, _, matrix in chunks:
        forward.append(max_plus(forward[-1], matrix))
    backward = [np.zeros((1, 1))]
    for _, _, matrix in reversed(chunks):
        backward.append(max_plus(matrix, backward[-1]))
    at = [int((f[0] + b[:, 0]).argmax()) for f, b in zip(forward, reversed(backward), strict=True)]
    return [(entries[at[k]], exits[at[k + 1]]) for k, (entries, exits, _) in enumerate(chunks)]


def _path(pieces: Pieces, text: str, low: int, high: int, entry: State, leave: State) -> list[int]:
    """The ids of the pieces that begin between low and high, from one state to the other."""
    _, _, before = lattice(pieces, text, low, high, [entry])
    start, piece = (low + entry[0], low + entry[1]), (high + leave[0], high + leave[1])
    found: list[tuple[int, int]] = []
    while piece != start:
        if piece[0] < piece[1]:
            found.append(piece)
        piece = min(before[piece])
    return [i for q, e in reversed(found) for i in pieces.alone(text[q:e])]


def backtrace(pieces: Pieces, text: str, low: int, high: int, entry: State, leave: State) -> list[int]:
    """The ids of the pieces that begin in a chunk."""
    cuts = cuts_within(pieces, text, low, high)
    if cuts is None:
        return _path(pieces, text, low, high, entry, leave)
    first, last = cuts
    return _path(pieces, text, low, first, entry, (0, 0)) + pieces.encode(text[first:last]) + _path(pieces, text, last, high, (0, 0), leave)


def normal(text: str) -> str:
    """The text as the model's pieces spell it."""
    return "▁" + text.replace(" ", "▁") if text else ""


def encode_in_chunks(pieces: Pieces, text: str, chunk: int = CHUNK, near: int = NEAR) -> list[int]:
    """The parallel scheme on one text, chunk after chunk; for tests."""
    spelled = normal(text)
    edges = boundaries(pieces, spelled, chunk, near)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    states = best_states([transfer(pieces, spelled, a, b) for a, b in spans])
    return reduce(list.__add__, (backtrace(pieces, spelled, a, b, *s) for (a, b), s in zip(spans, states, strict=True)), [])


def _encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                found = library.encode([x or "" for x in texts], num_threads=1)
                ids = [np.array(x, np.int32) if text is not None else None for x, text in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), pa.array(ids, pa.list_(pa.int32()))], ["rest", "text", "ids"])

    return run


def _split(path: str, chunk: int):
    """Chunks with a piece's length of text on both sides: key, k, low and high in that text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spelled = normal(text)
                edges = boundaries(pieces, spelled, chunk)
                rows = []
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    left, right = max(0, a - 2 * pieces.longest), min(len(spelled), b + 2 * pieces.longest)
                    rows.append((key, k, spelled[left:right], a - left, b - left))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["key", "k", "part", "low", "high"])

    return run


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            out = [transfer(pieces, part, low, high) for part, low, high in zip(*(batch.column(x).to_pylist() for x in ("part", "low", "high")), strict=True)]
            flat = [pa.array([np.array(x[k], np.int32).ravel() for x in out], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), *flat, pa.array([x[2].ravel() for x in out], pa.list_(pa.float64()))], ["key", "k", "entries", "exits", "matrix"])

    return run


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """The states of a document's chunks; a chunk has a small matrix only."""
    group = group.sort_values("k")
    pairs = lambda flat: [(int(a), int(b)) for a, b in np.reshape(flat, (-1, 2))]
    chunks = []
    for entries, exits, matrix in zip(group["entries"], group["exits"], group["matrix"], strict=True):
        a, b = pairs(entries), pairs(exits)
        chunks.append((a, b, np.reshape(matrix, (len(a), len(b)))))
    states = np.array([(*a, *b) for a, b in best_states(chunks)], np.int32)
    return pd.DataFrame({"key": group["key"].to_numpy(), "k": group["k"].to_numpy(), "e0": states[:, 0], "e1": states[:, 1], "x0": states[:, 2], "x1": states[:, 3]})


def _backtraces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("part", "low", "high", "e0", "e1", "x0", "x1")), strict=True)
            ids = [np.array(backtrace(pieces, part, low, high, (e0, e1), (x0, x1)), np.int32) for part, low, high, e0, e1, x0, x1 in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["key", "k", "ids"])

    return run


def encode_giants(texts: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """key and ids of each distinct key of texts(key, text), by the parallel scan."""
    chunks = texts.mapInArrow(_split(path, chunk), "key string, k int, part string, low int, high int").repartition("key", "k")
    matrices = chunks.mapInArrow(_transfers(path), "key string, k int, entries array<int>, exits array<int>, matrix array<double>")
    states = matrices.groupBy("key").applyInPandas(_scan, "key string, k int, e0 int, e1 int, x0 int, x1 int")
    parts = chunks.join(states, ["key", "k"]).mapInArrow(_backtraces(path), "key string, k int, ids array<int>")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))  # one document's chunks
    return whole.select("key", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs with ids, the encoding of text; a column ids of docs is replaced."""
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string").alias("text"))
    schema = packed.withColumn("ids", F.lit(None).cast("array<int>")).schema
    large = F.coalesce(F.length("text") > giant, F.lit(False))
    whole = packed.where(~large).mapInArrow(_encode_whole(path), schema)
    keyed = packed.where(large).withColumn("key", F.sha2("text", 256))
    found = encode_giants(keyed.select("key", "text").dropDuplicates(["key"]), path, chunk)
    split = keyed.join(found, "key").select("rest", "text", "ids")
    out = whole.unionByName(split)
    order = [c for c in docs.columns if c != "ids"]
    return out.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in order), "ids")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("ids").to_pylist()
                texts = library.decode([x or [] for x in ids], num_threads=1) if ids else []
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array([t if x is not None else None for t, x in zip(texts, ids, strict=True)], pa.string())], ["rest", "text"])

    return run


def decode(rows: DataFrame, path: str = MODEL, into: str = "decoded") -> DataFrame:
    """rows with the texts of their ids in the column into."""
    rest = [c for c in rows.columns if c != into]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), "ids")
    out = packed.mapInArrow(_decode(path), packed.select("rest", F.lit(None).cast("string").alias("text")).schema)
    return out.select(*(F.col("rest").getField(c).alias(c) for c in rest), F.col("text").alias(into))


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            counts, sums, same = [], [], []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("ids")
                flat, sizes = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(ids.offsets.to_numpy())
                lists = np.split(flat, np.cumsum(sizes)[:-1])
                back = library.decode([x.tolist() for x in lists], num_threads=1)
                for text, known, decoded, x in zip(part.column("text").to_pylist(), ids.is_valid().to_pylist(), back, lists, strict=True):
                    counts.append(len(x) if known else None)
                    sums.append(zlib.crc32(x.tobytes()) if known else None)
                    same.append(decoded == text if known else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc", "round_trip"])

    return run


def digest(docs: DataFrame, path: str = MODEL, doc_id: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc (CRC-32 of the ids as 4-byte little-endian numbers) and round_trip (decoding gives the text)."""
    rows = encode(docs.select("doc_id", "text"), path)
    return rows.select(F.col("doc_id").cast("long"), "text", "ids").mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_crc long, round_trip boolean")
