"""Substring dedup by sliding sentence spans.

A sentence ends at a word ending in . ! or ? (closing quotes and brackets after it count to it) or at a line
break; one of more than SENTENCE_WORDS words is divided at words ending in , ; or : and after SENTENCE_WORDS words. A span is a run of at least SPAN consecutive sentences that has at least SPAN_WORDS
words: from each sentence on, and up to each sentence, the shortest such run. Spans are compared by a 64-bit
hash of their words (A-Z folded, white space ignored). The first place of a span is the smallest (doc_id, place
in the text); every sentence covered by a span that is not in its first place is removed, within a document too.

Where sentences begin depends on what stands around a passage, so texts are divided a second time, wherever a hash of two
adjacent words is the least of those up to NEAR words away: the words of a passage alone decide this, except for NEAR words
at its ends. From each such place to the first one SPAN_WORDS words on is a span too. So a repeated passage is found wherever
it stands, without marks as well, but for some words at its ends.

Spans meet in buckets of their hash. A pack of texts sends a span once, so a passage in a third of all
documents gives a bucket one row a pack. Removals come back as word ranges and are cut from the whole text.

Null texts stay null; texts with fewer sentences or words have no span. Rows with equal doc_id and text are one
document and are treated alike; a null doc_id comes after all others. Other columns are kept as they are."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words

SENTENCE_WORDS, SPAN, SPAN_WORDS = 12, 3, 20
PACK_BYTES = 4 << 20
#: Bytes of text for a bucket; they give about a million spans. Smaller buckets need less memory, and give more rows, as a document's
#: removals come back once a bucket that has any.
PER_BUCKET = 32 << 20
_LAST_ID = (1 << 63) - 1
#: Words on either side that decide whether a text is divided at a place.
NEAR = 2
#: Sentence marks of other scripts: Devanagari, Arabic, Urdu, Chinese and Japanese, Ethiopic, Armenian, Khmer, Burmese, Tibetan.
_MARKS = "।॥؟۔。！？．｡።፧։។៕။།"
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLAUSES = np.zeros(256, bool)
_CLAUSES[list(b",;:")] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b"\"')]")] = True


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The index of each sentence's first word."""
    last = data[ends - 1]
    stop = _ENDS[last] | (_CLOSES[last] & _ENDS[data[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
    for mark in _MARKS:
        code = mark.encode()
        at = np.flatnonzero((last == code[-1]) & (ends - starts >= len(code)))
        for k in range(1, len(code)):
            at = at[data[ends[at] - 1 - k] == code[-1 - k]]
        stop[at] = True
    lines = np.flatnonzero(data == 10)
    if len(starts) > 1:
        stop[:-1] |= np.searchsorted(lines, ends[:-1]) < np.searchsorted(lines, starts[1:])
    begins = np.zeros(len(starts), bool)
    begins[first[first < len(starts)]] = True
    begins[1:] |= stop[:-1]
    at = np.flatnonzero(begins)
    sizes = np.diff(np.append(at, len(starts)))
    # long sentences end at their clause marks too, so that copies changed in one place meet again soon after it
    begins[1:] |= (_CLAUSES[last] & np.repeat(sizes > SENTENCE_WORDS, sizes))[:-1]
    at = np.flatnonzero(begins)
    since = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    return np.flatnonzero(since % SENTENCE_WORDS == 0)


def spans(at: np.ndarray, count: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every span. at: sentences' first words; count: words; first: texts' first words (one more at the end)."""
    begin, end = at, np.append(at[1:], count)
    text = np.searchsorted(first, begin, "right") - 1
    low, high = np.searchsorted(begin, first[text]), np.searchsorted(begin, first[text + 1])
    index = np.arange(len(at))
    to = np.maximum(index + SPAN - 1, np.searchsorted(end, begin + SPAN_WORDS))
    back = np.minimum(index - SPAN + 1, np.searchsorted(begin, end - SPAN_WORDS, "right") - 1)
    onward, backward = to < high, back >= low
    a = np.concatenate([begin[onward], begin[back[backward]]])
    b = np.concatenate([end[to[onward]], end[backward]])
    both = np.unique(a * (count + 1) + b) if len(a) else np.empty(0, np.int64)
    return both // (count + 1), both % (count + 1)


def content_spans(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the spans between places chosen by their words. hashes: words' hashes; first: texts' first words (one more at the end)."""
    count = len(hashes)
    pairs = np.zeros(count + 2 * NEAR, np.uint64)
    if count:
        pairs[NEAR + 1 : NEAR + count] = words.mix(words.mix(hashes[:-1]) + hashes[1:]) | np.uint64(1)
        pairs[NEAR + first[first < count]] = 0  # a text has no place at its first word
    own = pairs[NEAR : NEAR + count]
    least = own > 0
    for k in range(1, NEAR + 1):
        least &= (own < pairs[NEAR - k : NEAR - k + count]) | (pairs[NEAR - k : NEAR - k + count] == 0)
        least &= (own <= pairs[NEAR + k : NEAR + k + count]) | (pairs[NEAR + k : NEAR + k + count] == 0)
    return _onward(np.flatnonzero(least), first)


def _onward(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each place to the first SPAN_WORDS words on, within a text."""
    to = np.searchsorted(at, at + SPAN_WORDS)
    inside = to < len(at)
    a, b = at[inside], at[to[inside]]
    same = np.searchsorted(first, a, "right") == np.searchsorted(first, b, "right")
    return a[same], b[same]


def run_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words of each run a..b."""
    up, down = words._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return words.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _first_places(hashes: np.ndarray, ids: np.ndarray, marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a span is in its first place among those given."""
    order = np.lexsort((begins, marks, ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    out = np.empty(len(order), bool)
    out[order] = new
    return out


_FIELDS = ["bucket", "hashes", "begins", "lengths", "ids", "marks", "counts", "gone"]
_SHIPPED = "bucket long, hashes binary, begins binary, lengths binary, ids binary, marks binary, counts binary, gone array<struct<id:bigint,mark:bigint,ranges:binary>>"
_GONE = pa.list_(pa.struct([("id", pa.int64()), ("mark", pa.int64()), ("ranges", pa.binary())]))


def _ranges(rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> list[dict]:
    """The word ranges to remove, by document. rows: the document of each range, in order."""
    found, at = np.unique(rows, return_index=True)
    pairs = np.stack([begins, begins + lengths], 1).astype(np.int64)
    return [{"id": int(ids[r]), "mark": int(marks[r]), "ranges": part.tobytes()} for r, part in zip(found, np.split(pairs, at[1:]), strict=True)] if len(found) else []


def _ship(buckets: int, anywhere: bool):
    def send(pack: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, marks = np.array([p[0] for p in pack], np.int64), np.array([p[1] for p in pack], np.int64)
        rows = np.repeat(np.arange(len(pack)), [len(p[2]) for p in pack])
        hashes, begins, lengths = (np.concatenate([p[k] for p in pack]) for k in (2, 3, 4))
        first = _first_places(hashes, ids[rows], marks[rows], begins)
        gone = _ranges(rows[~first], begins[~first], lengths[~first], ids, marks)
        rows, hashes, begins, lengths = rows[first], hashes[first], begins[first], lengths[first]
        order, found, at = words.by_bucket(hashes, buckets)
        out: list[list] = [[] for _ in _FIELDS]
        for bucket, a, b in zip(found, at[:-1], at[1:], strict=True):
            part = order[a:b]
            who, many = np.unique(rows[part], return_counts=True)
            values = (int(bucket), hashes[part].tobytes(), begins[part].astype(np.int32).tobytes(), lengths[part].astype(np.int32).tobytes(), ids[who].tobytes(), marks[who].tobytes(), many.astype(np.int32).tobytes(), [])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        for k in range(min(len(found), len(gone))):
            out[7][k] = gone[k :: len(found)]
        kinds = [pa.int64(), *[pa.binary()] * 6, _GONE]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, seen = [], 0, set()
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            row = 0
            for data, starts, ends, first in grouped_words(batch.column("text")):
                hashes = words.word_hashes(data, starts, ends)
                a, b = spans(sentences(data, starts, ends, first), len(starts), first)
                if anywhere:
                    more, to = content_spans(hashes, first)
                    both = np.unique(np.concatenate([a, more]) * (len(starts) + 1) + np.concatenate([b, to]))
                    a, b = both // (len(starts) + 1), both % (len(starts) + 1)
                keys = run_hashes(hashes, a, b)
                at = np.searchsorted(a, first)
                for k in range(len(first) - 1):
                    key = (ids[row + k], marks[row + k])
                    if at[k] < at[k + 1] and key not in seen:
                        part = slice(at[k], at[k + 1])
                        seen.add(key)
                        pack.append((*key, keys[part], a[part] - first[k], b[part] - a[part]))
                        held += (at[k + 1] - at[k]) * 32
                row += len(first) - 1
                if held > PACK_BYTES:
                    yield send(pack)
                    pack, held, seen = [], 0, set()
        if pack:
            yield send(pack)

    return run


def grouped_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, word starts, word ends and first-word indexes of consecutive groups of whole texts of a few megabytes."""
    data, offsets = words.text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4 * words.BYTES_AT_ONCE, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        yield part, *word_spans_of(part, offsets[row : end + 1] - offsets[row])
        row = end


word_spans_of = words.word_spans


def _answer(group: pa.Table) -> pa.Table:
    """The removals known from a bucket: spans not in their first place, and those that packs found themselves."""
    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.empty(0, kind)] + [np.frombuffer(x, kind) for x in group.column(name).to_pylist()])

    hashes, begins, lengths = joined("hashes", np.uint64), joined("begins", np.int32), joined("lengths", np.int32)
    ids, marks = joined("ids", np.int64), joined("marks", np.int64)
    rows = np.repeat(np.arange(len(ids)), joined("counts", np.int32))
    # a document that came in two packs has its own spans twice: these are one place
    first = _first_places(hashes, ids[rows], marks[rows], begins)
    again = np.flatnonzero(~first)
    order = np.lexsort((begins, marks[rows], ids[rows], hashes))
    same = np.zeros(len(order), bool)
    h, i, m, b = hashes[order], ids[rows][order], marks[rows][order], begins[order]
    same[1:] = (h[1:] == h[:-1]) & (i[1:] == i[:-1]) & (m[1:] == m[:-1]) & (b[1:] == b[:-1])
    lead = np.maximum.accumulate(np.where(first[order], np.arange(len(order)), 0))
    twin = np.zeros(len(order), bool)
    twin[order] = (i == i[lead]) & (m == m[lead]) & (b == b[lead]) if len(order) else np.empty(0, bool)
    again = again[~twin[again]]
    found = _ranges(rows[again], begins[again], lengths[again], ids, marks)
    for more in group.column("gone").to_pylist():
        found += more
    return pa.Table.from_pylist(found, pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("ranges", pa.binary())]))


def removals(docs: DataFrame, anywhere: bool = True, per_bucket: int = PER_BUCKET) -> DataFrame:
    """id (doc_id, or the largest long), mark (hash of the text) and ranges: pieces of word ranges to remove, by document."""
    keyed = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / per_bucket))
    # as many tasks as buckets: a task's share does not grow with the input
    shipped = keyed.mapInArrow(_ship(buckets, anywhere), _SHIPPED).repartition(buckets, "bucket")
    answers = shipped.groupBy("bucket").applyInArrow(_answer, "id long, mark long, ranges binary")
    return answers.groupBy("id", "mark").agg(F.collect_list("ranges").alias("ranges"))  # a document's own spans


def cut_text(text: str, ranges: np.ndarray) -> tuple[str, int]:
    """text without the words in the ranges (pairs of first and end), and how many words went."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words.word_spans(data, np.array([0, len(data)]))
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, ranges[:, 0], 1)
    np.add.at(change, ranges[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))).reshape(-1, 2)
    parts = [data[0 if a == 0 else starts[a] : len(data) if b == len(starts) else starts[b]] for a, b in edges]
    out = b"".join(x.tobytes() for x in parts).decode()
    return (out if len(edges) and edges[-1][1] == len(starts) else out.rstrip(" \t\n\x0b\f\r")), int(len(starts) - keep.sum())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = batch.column("text").to_pylist(), []
        for k, pieces in enumerate(batch.column("ranges").to_pylist()):
            removed = 0
            if pieces:
                texts[k], removed = cut_text(texts[k], np.frombuffer(b"".join(pieces), np.int64).reshape(-1, 2))
            gone.append(removed)
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["rest", "text", "removed"])


def dedup_substrings(docs: DataFrame, count: str | None = None, anywhere: bool = True, per_bucket: int = PER_BUCKET) -> DataFrame:
    """docs without its repeated sentences; n_chars, if there, is made anew. count: a column for the words removed.
    anywhere: whether texts are divided by their words as well; without it only spans of sentences are found."""
    found = removals(docs, anywhere, per_bucket)
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id"), F.xxhash64("text").alias("mark"))
    joined = packed.join(found, ["id", "mark"], "left").select("rest", "text", "ranges")
    schema = joined.select("rest", "text", F.lit(0).cast("long").alias("removed")).schema
    cut = joined.mapInArrow(_cut, schema)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [made[c].alias(c) if c in made else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return cut.select(*columns, *([F.col("removed").alias(count)] if count else []))
