"""Token ids of documents in files of patched frame-of-reference blocks (token_blocks.py), written and read by Spark tasks.

A file: the blocks' bytes, the table of blocks, the table of documents (doc_id, whether it is null, first id in the file, number of ids),
and a trailer with the two tables' lengths and a mark. Documents are dealt to files by ranges of doc_id, so files in order
hold ascending doc_ids (null first; rows that share one by a hash of their text, and alike rows in any order). A task
writes under another name and renames at the end, so a task that runs again leaves the same file.

Texts are cut before a space or line break that follows a visible ASCII character, and between a letter and a mark: the vocabulary's pieces never reach over
such a place, so the ids of the parts, joined, are those of the text. Each distinct part of some megabytes of text is given to
the tokenizer once, and a worker keeps what it has met (KEPT parts at most, which changes no id). Very long texts are worked on in runs of parts, so memory follows GROUP_BYTES, not the text
(unless it has no such place). Null and empty texts have the end id alone. Strings of special tokens in a text are ordinary text."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm import token_blocks
from sitemill.llm.shared_files import new_folder, open_array, replace_file
from sitemill.llm.spans import GROUP_BYTES, Spans
from sitemill.llm.words import text_bytes

END_ID = 2
#: Bytes of text a file holds about, at most; small inputs make as many files as there are cores.
FILE_BYTES = 256 << 20
#: Blocks that are encoded or decoded at once.
RUN = 512
MARK = b"tokens01"
DOCUMENTS = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("ids", "<u8"), ("null", "u1")])
TRAILER = np.dtype([("blocks", "<u8"), ("documents", "<u8"), ("mark", "S8")])


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where texts or parts begin: text starts, a space or line break after a visible ASCII character, such a character
    after a line break that is one, and a mark after an ASCII letter."""
    here = np.zeros(len(data) + 1, bool)
    here[1:-1] = _LETTER[data[:-1]] & _POINT[data[1:]]
    seen = (data > 0x20) & (data < 0x7F)
    here[1:-1] |= ((data[1:] == 0x20) | (data[1:] == 0x0A)) & seen[:-1]
    here[2:-1] |= seen[2:] & (data[1:-1] == 0x0A) & seen[:-2]
    here[offsets] = True
    here[-1] = False
    return np.flatnonzero(here)


_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT[list(b".,;:!?\"()")] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
# bytes that begin a character which is surely no white space
_OPENS = _VISIBLE.copy()
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False
# bytes of ASCII letters and of characters from U+00C0 to U+027F
_LATIN = _LETTER.copy()
_LATIN[0x80:0xC0] = _LATIN[0xC3:0xCA] = True
WORD, WIDE, JOINT, OTHER = range(4)
#: Parts that are given to the tokenizer in one text, with line breaks between them.
JOINED = 4096
#: Parts whose ids a worker keeps for the texts that follow; when there are more it starts anew.
KEPT = 1_000_000


def _encoded(path: str, parts: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts, joined, and each part's number of ids. plain: a line break beside any of the parts is an id of its own that
    stands in none of them, so they are encoded many at a time and told apart by it."""
    tokenizer = _tokenizer(path)
    mark = tokenizer.encode("\n", add_special_tokens=False).ids
    plain &= len(mark) == 1
    texts = [b"\n".join([*parts[k : k + JOINED], b""]).decode() for k in range(0, len(parts), JOINED)] if plain else [part.decode() for part in parts]
    encoded = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    flat = np.concatenate([np.empty(0, np.uint32), *encoded])
    if not plain:
        return flat, np.array([len(e) for e in encoded], np.int64)
    at = np.flatnonzero(flat == mark[0])
    return flat[flat != mark[0]], np.diff(at, prepend=-1) - 1


# how byte-level vocabularies write the bytes of a text: printable ones as themselves, the rest as the characters from 256 on
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {byte: 256 + n for n, byte in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def _words(path: str, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As _encoded, for parts that are letters after at most one space: each is one piece of the vocabulary's pattern, so the model
    merges it without looking for pieces first."""
    merge = _tokenizer(path).model.tokenize
    together = b"\n".join(parts)
    written = together.decode("latin-1").translate(_WRITTEN | {10: "\n"}) if not together.isascii() else together.decode().replace(" ", chr(_WRITTEN[0x20]))
    ids = [[token.id for token in merge(part)] for part in written.split("\n")]
    return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


class _Known:
    """The ids of the parts that this worker has met, by the parts themselves."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.begins, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, parts: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """The places of distinct parts in begins and sizes; kinds: WORD, WIDE (a word not all ASCII), JOINT (may be joined by
        line breaks) or OTHER."""
        if len(self.place) + len(parts) > KEPT:
            self.forget()
        get = self.place.get
        found = np.array([get(part, -1) for part in parts], np.int64)
        for kind in (WORD, WIDE, JOINT, OTHER):
            new = np.flatnonzero((found < 0) & (kinds == kind))
            if not len(new):
                continue
            fresh = [parts[k] for k in new.tolist()]
            ids, sizes = _words(self.path, fresh) if kind in (WORD, WIDE) else _encoded(self.path, fresh, kind == JOINT)
            found[new] = len(self.place) + np.arange(len(new))
            self.place.update(zip(fresh, found[new].tolist(), strict=True))
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))
        return found


_known = cache(_Known)


def _ids(path: str, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts of data, joined, and each part's number of ids."""
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    ends = np.append(starts[1:], len(data))
    spans = Spans(data, starts, ends)
    owner = spans.first_equal(spans.hashes())
    own = owner == np.arange(len(owner))
    first, which = np.flatnonzero(own), (np.cumsum(own) - 1)[owner]
    a, b = starts[first], ends[first]
    # a line break beside these stays an id of its own: they have none, end visibly, and begin so but for one space
    sums = lambda where: np.concatenate((np.zeros(1, np.int32), np.cumsum(where, dtype=np.int32)))
    breaks = sums(data == 0x0A)
    begin = a + ((data[a] == 0x20) & (a < b - 1))
    kinds = np.where((breaks[b] == breaks[a]) & _VISIBLE[data[b - 1]] & _OPENS[data[begin]], JOINT, OTHER)
    odd, high = sums(~_LATIN[data]), sums(data >= 0x80)
    letters, wide = odd[b] == odd[begin], high[b] > high[a]
    whole, known = data.tobytes(), _known(path)
    parts = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    kinds[letters & ~wide] = WORD
    for k in np.flatnonzero(letters & wide).tolist():
        if parts[k].decode().removeprefix(" ").isalpha():
            kinds[k] = WIDE
    places = known.find(parts, kinds)[which]
    sizes = known.sizes[places]
    at = np.repeat(known.begins[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return known.flat[at], sizes


def encode_texts(column: pa.Array, path: str, end_id: int | None = END_ID, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, ids, ids of each row, whether the last row is complete) for consecutive texts; a text longer than most bytes comes in several runs."""
    data, offsets = text_bytes(column)
    cuts = _cuts(data, offsets) if len(data) else np.empty(0, np.int64)
    row, place, rows = 0, 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, place + most, "right")) - 1)
        stop, whole = int(offsets[last]), True
        if stop - place > most:  # one long text: up to the last cut within reach, or the first beyond
            nearest = int(np.searchsorted(cuts, place + most, "right")) - 1
            if cuts[nearest] <= place:
                nearest += 1
            if nearest < len(cuts) and cuts[nearest] < stop:
                stop, whole = int(cuts[nearest]), False
        parts = cuts[np.searchsorted(cuts, place) : np.searchsorted(cuts, stop)]
        ids, sizes = _ids(path, data[place:stop], parts - place)
        begins = np.maximum(offsets[row:last], place)
        total = np.concatenate(([0], np.cumsum(sizes)))[np.append(np.searchsorted(parts, begins), len(parts))]
        counts = np.diff(total)
        if end_id is not None:
            closed = last - row if whole else last - row - 1
            joined = np.full(len(ids) + closed, end_id, np.uint32)
            inside = np.ones(len(joined), bool)
            inside[total[1 : closed + 1] + np.arange(closed)] = False
            joined[inside] = ids
            ids = joined
            counts[:closed] += 1
        yield row, ids, counts, whole
        row, place = (last, stop) if whole else (last - 1, stop)


def _write(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        tables, names, held, many, at, total, open_ = [], [], [], 0, 0, 0, 0
        with replace_file(folder, f"ids-{number}") as out:
            for batch in batches:
                counted = np.zeros(batch.num_rows, np.int64)
                for row, ids, counts, _ in encode_texts(batch.column("text"), path):
                    counted[row : row + len(counts)] += counts
                    held.append(ids)
                    many += len(ids)
                    while many >= RUN * token_blocks.BLOCK:
                        ids = np.concatenate(held)
                        table, data = token_blocks.encode(ids[: RUN * token_blocks.BLOCK], at)
                        out.write(data)
                        tables.append(table)
                        held, many, at = [ids[RUN * token_blocks.BLOCK :]], many - RUN * token_blocks.BLOCK, at + len(data)
                known = np.zeros(batch.num_rows, DOCUMENTS)
                known["null"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                known["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
                known["ids"] = counted
                known["start"] = total + np.cumsum(counted) - counted
                total += int(counted.sum())
                names.append(known)
            table, data = token_blocks.encode(np.concatenate([np.empty(0, np.uint32), *held]), at)
            out.write(data)
            blocks = np.concatenate([*tables, table])
            documents = np.concatenate([np.empty(0, DOCUMENTS), *names])
            for part in (blocks, documents, np.array([(len(blocks), len(documents), MARK)], TRAILER)):
                out.write(part.tobytes())
        yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "ids": pa.array([total], pa.int64()), "documents": pa.array([len(documents)], pa.int64())})

    return run


class TokenFile:
    """Reads one file: its tables, and any run of its ids."""

    def __init__(self, folder: str, name: str):
        self._input = open_array(folder, name)
        size = self._input.size()
        blocks, documents, mark = np.frombuffer(self._input.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if mark != MARK:
            raise ValueError(f"{folder}/{name} is no whole file of token ids")
        at = size - TRAILER.itemsize - int(documents) * DOCUMENTS.itemsize
        self.documents = np.frombuffer(self._input.read_at(int(documents) * DOCUMENTS.itemsize, at), DOCUMENTS)
        self.end = at - int(blocks) * token_blocks.INDEX.itemsize
        self.blocks = np.frombuffer(self._input.read_at(int(blocks) * token_blocks.INDEX.itemsize, self.end), token_blocks.INDEX)

    def close(self) -> None:
        self._input.close()

    def _decode(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b."""
        if a >= b:
            return np.empty(0, np.uint32)
        low = int(self.blocks["start"][a])
        high = int(self.blocks["start"][b]) if b < len(self.blocks) else self.end
        return token_blocks.decode(self.blocks[a:b], np.frombuffer(self._input.read_at(high - low, low), np.uint8), low)

    def ids(self, first: int, many: int) -> np.ndarray:
        """many ids from place first on; only their blocks are read."""
        a = first // token_blocks.BLOCK
        b = min(len(self.blocks), -(-(first + many) // token_blocks.BLOCK))
        return self._decode(a, b)[first - a * token_blocks.BLOCK :][:many]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """All ids in order, RUN blocks at a time, with the place of the first."""
        for a in range(0, len(self.blocks), RUN):
            yield a * token_blocks.BLOCK, self._decode(a, min(a + RUN, len(self.blocks)))


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: (file, ids before it, ids, documents) in order."""

    folder: str
    files: tuple[tuple[int, int, int, int], ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        found = spark.createDataFrame(list(self.files), "file long, before long, ids long, documents long")
        return found.repartition(max(1, len(self.files)), "file")


def write_documents(docs: DataFrame, path: str, folder: str | None = None) -> TokenFiles:
    """Encodes every row of docs(doc_id, text) with the tokenizer in path and writes the files. The driver gets one row a file."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    files = max(1, math.ceil(size / FILE_BYTES), min(4 * spark.sparkContext.defaultParallelism, math.ceil(size / GROUP_BYTES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share a doc_id and a text are told apart by their place, so that a range never has to hold all of them
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("place")]
    dealt = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    written = dealt.mapInArrow(_write(folder, path), "file long, ids long, documents long").collect()
    before, out = 0, []
    for row in sorted(written):
        out.append((row["file"], before, row["ids"], row["documents"]))
        before += row["ids"]
    return TokenFiles(folder, tuple(out))


def _digest(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(folder, f"ids-{number}")
                docs = file.documents
                sums = np.zeros(len(docs), np.int64)
                starts, stops = docs["start"].astype(np.int64), (docs["start"] + docs["ids"]).astype(np.int64)
                for at, ids in file.runs():
                    data = memoryview(ids.astype("<u4").tobytes())
                    for k in range(int(np.searchsorted(stops, at, "right")), int(np.searchsorted(starts, at + len(ids)))):
                        sums[k] = zlib.crc32(data[4 * max(0, starts[k] - at) : 4 * (min(stops[k], at + len(ids)) - at)], int(sums[k]))
                file.close()
                ids = pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + before), pa.array(docs["ids"].astype(np.int64)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def digests(spark: SparkSession, written: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: a file is read run by run."""
    return written.rows(spark).mapInArrow(_digest(written.folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(folder, f"ids-{number}")
                docs, k = file.documents, 0
                while k < len(docs):  # documents of about a run of ids at a time, a longer one alone
                    low = int(docs["start"][k])
                    end = max(k + 1, int(np.searchsorted(docs["start"] + docs["ids"], low + RUN * token_blocks.BLOCK, "right")))
                    part = docs[k:end]
                    ids = file.ids(low, int(part["ids"].sum()))
                    offsets = pa.array(np.append(part["start"] - low, len(ids)).astype(np.int64))
                    lists = pa.LargeListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(part["start"].astype(np.int64) + before), lists], ["doc_id", "start", "ids"])
                    k = end
                file.close()

    return run


def read_documents(spark: SparkSession, written: TokenFiles) -> DataFrame:
    """doc_id, start and ids (array of long, with the end id) of every document, from the files."""
    return written.rows(spark).mapInArrow(_read(written.folder), "doc_id long, start long, ids array<long>")
