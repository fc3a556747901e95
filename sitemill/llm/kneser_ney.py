"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

1. Words: packs of training texts send their distinct word hashes with counts to buckets by hash range; each
   bucket writes its sorted hashes and counts. A word's id is its place in that order (0: start, 1: end of a text).
2. Bigrams: packs send their distinct bigrams (two ids, exact) with counts to buckets by hash; each bucket
   writes them sorted with their counts, and sends on what it knows of each context (tokens, and bigrams
   counted once, twice, more often) and of each word (contexts it follows).
3. These sums are written as dense arrays by id. The driver gets a few numbers a bucket: totals and counts of
   counts, from which the discounts follow.
4. Scoring maps the arrays (whole texts, no shuffle): workers look up each pack's distinct bigrams.

p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w), g(v) = (D1 N1 + D2 N2 + D3 N3+) / c(v);
p(w) = max(k(w) - E(k), 0) / K + (mass kept back) / (V + 1), k(w): contexts that w follows, K: distinct bigrams.
Discounts D, E for counts 1, 2, 3+ as in the modified form. Unknown contexts give p(w), unknown words the last term.

Files go to a new folder below the checkpoint folder and grow with the distinct bigrams (12 bytes each). Null and
empty texts have one token, the end. Rows that repeat a doc_id count each. A null doc_id is a training text. With
no training text every word is unknown and has probability 1 / (V + 1) with V = 0."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words
from sitemill.llm.shared_files import forget, map_array, new_folder, write_array

START, END, FIRST_WORD = 0, 1, 2
PACK_BYTES = 8 << 20
#: Bytes of training text for each bucket.
PER_BUCKET = 16 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of some megabytes of text, and each text's first word (one more at the end)."""
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    many = 0
    for batch in batches:
        for hashes, first in words.hashed_texts(batch.column("text")):
            held.append(hashes)
            sizes.append(np.diff(first))
            many += len(hashes) + len(first)
            if many * 8 > PACK_BYTES:
                yield np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
                held, sizes, many = [], [], 0
    if sizes:
        yield np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _joined(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind)] + [np.frombuffer(x, kind) for x in group.column(name).to_pylist() if x is not None])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else np.empty(0, counts.dtype)


def _ship_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in _packs(batches):
            found, counts = np.unique(hashes, return_counts=True)
            place = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
            buckets, at = np.unique(place, return_index=True)
            parts = [slice(a, b) for a, b in zip(at, np.append(at[1:], len(found)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([found[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.int64).tobytes() for p in parts], pa.binary())], ["bucket", "keys", "counts"])

    return run


def _write_words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, counts = _summed(_joined(group, "keys", np.uint64), _joined(group, "counts", np.int64))
        write_array(folder, f"words-{bucket}", keys)
        write_array(folder, f"counts-{bucket}", counts)
        return pa.table({"bucket": [bucket], "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes in buckets by hash range; bases holds each bucket's first id (one more at the end)."""

    folder: str
    bits: int
    bases: tuple[int, ...]
    texts: int
    tokens: int

    @property
    def size(self) -> int:
        return self.bases[-1]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct hashes (-1: unknown) and their training counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(place, np.arange((1 << self.bits) + 1))
        for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b and self.bases[bucket] < self.bases[bucket + 1]:
                known = map_array(self.folder, f"words-{bucket}", np.uint64)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                hit = known[at] == hashes[a:b]
                ids[a:b] = np.where(hit, at + self.bases[bucket], -1)
                counts[a:b] = np.where(hit, map_array(self.folder, f"counts-{bucket}", np.int64)[at], 0)
        return ids, counts

    def sequences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all tokens of a pack: contexts, ids, training counts; and each text's first token."""
        found, inverse = np.unique(hashes, return_inverse=True)
        ids, counts = self.find(found)
        ends = first[1:] + np.arange(len(first) - 1)  # the place of each text's end
        is_end = np.zeros(len(hashes) + len(first) - 1, bool)
        is_end[ends] = True
        token, count = np.full(len(is_end), END, np.int64), np.full(len(is_end), self.texts, np.int64)
        token[~is_end], count[~is_end] = ids[inverse], counts[inverse]
        starts = first[:-1] + np.arange(len(first) - 1)
        context = np.empty(len(token), np.int64)
        context[1:] = token[:-1]
        context[starts] = START
        return context, token, count, starts


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64)


def _ship_pairs(vocabulary: Vocabulary, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(vocabulary.folder)
        for hashes, first in _packs(batches):
            context, token, _, _ = vocabulary.sequences(hashes, first)
            keys, counts = np.unique(_pair(context, token), return_counts=True)
            order, found, at = words.by_bucket(words.mix(keys), buckets)
            parts = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.int32).tobytes() for p in parts], pa.binary())], ["bucket", "keys", "counts"])

    return run


_SUMS = ["total", "once", "twice", "more", "follows"]


def _write_pairs(folder: str, per: int):
    """Writes a bucket's bigrams; sends, by id range, ids with their sums, and once the bucket's counts of counts."""
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, counts = _summed(_joined(group, "keys", np.uint64), _joined(group, "counts", np.int32).astype(np.int64))
        write_array(folder, f"pairs-{bucket}", keys)
        write_array(folder, f"seen-{bucket}", counts.astype(np.uint32))
        context, token = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        left = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        right, many = np.unique(token, return_counts=True)
        ids = np.concatenate([context[at], right])
        sums = np.zeros((len(ids), 5), np.int64)
        sums[: len(at), :4] = np.stack(left, 1)
        sums[len(at) :, 4] = many
        # rows of one id range together; each is as small as its numbers allow once compressed
        order = np.argsort(ids // per, kind="stable")
        ids, sums = ids[order], sums[order]
        ranges, cuts = np.unique(ids // per, return_index=True)
        cuts = np.append(cuts, len(ids))
        rows = [(int(r), ids[a:b].astype(np.uint32).tobytes(), np.ascontiguousarray(sums[a:b].T.astype(np.int32 if sums[a:b].max() < 1 << 31 else np.int64)).tobytes()) for r, a, b in zip(ranges, cuts[:-1], cuts[1:], strict=True)]
        known = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        stats = [[*known, len(keys)]] + [None] * (len(rows) - 1)
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary()), "sums": pa.array([r[2] for r in rows], pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})

    return run


def _write_sums(folder: str, per: int, size: int):
    """Writes the dense sums of a range of ids; gives its counts of counts with those that came to it."""
    def run(group: pa.Table) -> pa.Table:
        place = group.column("range")[0].as_py()
        table = np.zeros((5, min(per, size - place * per)), np.int64)
        for ids, sums in zip(group.column("ids").to_pylist(), group.column("sums").to_pylist(), strict=True):
            at = np.frombuffer(ids, np.uint32).astype(np.int64) - place * per
            kind = np.int32 if len(sums) == 20 * len(at) else np.int64
            np.add.at(table, (slice(None), at), np.frombuffer(sums, kind).reshape(5, -1))
        for name, values in zip(_SUMS, table, strict=True):
            write_array(folder, f"{name}-{place}", values)
        came = [x for x in group.column("stats").to_pylist() if x is not None]
        pairs = np.array(came, np.int64).sum(0) if came else np.zeros(5, np.int64)
        follows = table[4]
        out = [*pairs.tolist(), *(int((follows == k).sum()) for k in (1, 2, 3, 4)), int((follows > 0).sum())]
        return pa.table({"stats": pa.array([out], pa.list_(pa.int64()))})

    return run


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """The discounts for counts of 1, 2 and 3 or more from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    buckets: int
    per: int
    pairs: int
    types: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    kept_back: float

    def _dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The sums called name of sorted ids; unknown ids (-1) give 0."""
        out = np.zeros(len(ids), np.int64)
        known = ids >= 0
        place = ids // self.per
        for p in np.unique(place[known]):
            a, b = np.searchsorted(place, [p, p + 1])
            table = map_array(self.vocabulary.folder, f"{name}-{p}", np.int64)
            if len(table):  # a model without any training text has no tables
                out[a:b] = table[ids[a:b] - p * self.per]
        return out

    def _seen(self, keys: np.ndarray) -> np.ndarray:
        """The training counts of distinct bigrams."""
        order, found, at = words.by_bucket(words.mix(keys), self.buckets)
        out = np.zeros(len(keys), np.int64)
        for bucket, a, b in zip(found, at[:-1], at[1:], strict=True):
            known = map_array(self.vocabulary.folder, f"pairs-{bucket}", np.uint64)
            if len(known):
                part = order[a:b]
                spot = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                out[part] = np.where(known[spot] == keys[part], map_array(self.vocabulary.folder, f"seen-{bucket}", np.uint32)[spot], 0)
        return out

    def lower_probability(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted distinct ids."""
        follows = self._dense("follows", ids)
        off = np.array([0.0, *self.lower])[np.minimum(follows, 3)]
        return (follows - off) / max(self.pairs, 1) + self.kept_back / (self.types + 1)

    def log10(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log10 p(token | context) of each token; ids, -1 for unknown words."""
        ids, inverse = np.unique(np.concatenate([context, token]), return_inverse=True)
        total, once, twice, more = (self._dense(x, ids) for x in _SUMS[:4])
        back = self.discounts[0] * once + self.discounts[1] * twice + self.discounts[2] * more
        gamma = np.where(total > 0, back / np.maximum(total, 1), 1.0)
        plain = self.lower_probability(ids)
        c, w = inverse[: len(context)], inverse[len(context) :]
        # the probability of each distinct bigram, then of its tokens
        keys, at = np.unique(c * len(ids) + w, return_inverse=True)
        c, w = keys // len(ids), keys % len(ids)
        seen = np.zeros(len(keys), np.int64)
        known = (ids[c] >= 0) & (ids[w] >= 0)
        seen[known] = self._seen(_pair(ids[c[known]], ids[w[known]]))
        off = np.array([0.0, *self.discounts])[np.minimum(seen, 3)]
        return np.log10((seen - off) / np.maximum(total[c], 1) + gamma[c] * plain[w])[at]


def train(texts: DataFrame) -> Model:
    """Counts a model over all rows of texts(text)."""
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    folder = new_folder(spark, "kneser-ney")
    rows, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(1, math.ceil((size or 0) / PER_BUCKET))
    bits = math.ceil(math.log2(buckets))
    sent = texts.mapInArrow(_ship_words(bits), "bucket long, keys binary, counts binary")
    written = sent.groupBy("bucket").applyInArrow(_write_words(folder), "bucket long, size long, tokens long").collect()  # one row a bucket
    sizes = np.zeros(1 << bits, np.int64)
    for row in written:
        sizes[row["bucket"]] = row["size"]
    vocabulary = Vocabulary(folder, bits, tuple(int(x) for x in FIRST_WORD + np.concatenate(([0], np.cumsum(sizes)))), rows, rows + sum(row["tokens"] for row in written))
    per = max(1, math.ceil(vocabulary.size / buckets))
    pairs = texts.mapInArrow(_ship_pairs(vocabulary, buckets), "bucket long, keys binary, counts binary")
    parts = pairs.groupBy("bucket").applyInArrow(_write_pairs(folder, per), "range long, ids binary, sums binary, stats array<long>")
    stats = parts.groupBy("range").applyInArrow(_write_sums(folder, per, vocabulary.size), "stats array<long>").collect()  # one row a range
    n = np.array([row["stats"] for row in stats], np.int64).sum(0) if stats else np.zeros(10, np.int64)
    upper, lower = discounts(n[:4].tolist()), discounts(n[5:9].tolist())
    high = n[9] - n[5] - n[6]
    kept_back = (lower[0] * n[5] + lower[1] * n[6] + lower[2] * high) / n[4] if n[4] else 1.0
    return Model(vocabulary, buckets, per, int(n[4]), int(n[9]), upper, lower, float(kept_back))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(model.vocabulary.folder)
        total, types = model.vocabulary.tokens, model.types
        for batch in batches:
            parts = []
            for hashes, first in words.hashed_texts(batch.column("text")):
                context, token, count, starts = model.vocabulary.sequences(hashes, first)
                base = np.log10((count + 0.5) / (total + 0.5 * (types + 1)))
                chosen = np.stack([np.add.reduceat(x, starts) for x in (base, model.log10(context, token), (count > 0).astype(float))]) if len(starts) else np.empty((3, 0))
                parts.append((np.diff(np.append(starts, len(token))), *chosen))
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(columns[0].astype(np.int64)), pa.array(columns[3].astype(np.int64)), pa.array(np.full(batch.num_rows, total, np.int64)), pa.array(columns[1].astype(float)), pa.array(columns[2].astype(float))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text, held_out)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("held_out").cast("boolean"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out and scores all; see score. perplexity = 10 ** (-score / n_tokens)."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(marked, train(marked.where("NOT held_out")))
