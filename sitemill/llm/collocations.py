"""Phrase collocations: sequences of two or three words that come together more often than their parts would by chance.

Count streams are kept in prefix order (by first words) and in suffix order (by last words) and merged in step:

1. Packs of some megabytes of text send their distinct windows of three words (shorter at the end of a piece) with counts, as
   small numbers into a dictionary of the pack's words, to buckets by the first two words. So a
   bucket has whole contexts, and a frequent word is spread over as many buckets as it has followers.
2. A bucket sorts its windows in prefix order. One pass over the sorted stream gives f(w1 w2 w3), and by sums over runs of equal
   prefixes f(w1 w2), its share of f(w1), and of each pair the most frequent extension to the right. Phrases below the least count go:
   no part of a candidate is rarer than the candidate.
3. The streams of three, two and one words meet by sort-merge joins: in suffix order f(w2 w3) for f(w1 w2 w3), and for each pair
   the most frequent extension to the left; then the counts of first and last words.

Words are compared as strings, never by hashes alone; scores are exact decimals.

Null and empty texts have no words; null languages are `und`. Rows are counted whatever their doc_id, repeated rows each
time. Ties at the limit go by count, then by the phrase's bytes. Tables without a frequent phrase give no rows. Very long texts
are divided between pieces, so a task's memory follows the longest piece, if that has over 4 MB."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.spans import GROUP_BYTES, Spans
from sitemill.llm.words import by_bucket, mix, text_bytes
from sitemill.session import cut_lineage

LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text for each bucket, and parts of a language that are ranked before the whole.
PER_BUCKET, PARTS = 16 << 20, 64
INNER, BLANK, MARK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = MARK
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes of some megabytes of text, the places where runs of one text begin (one more at the end), and each run's language."""
    held: list[tuple[np.ndarray, str]] = []
    many = 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            while a < b:
                stop = b
                if b - a > GROUP_BYTES:  # up to the last mark within reach, or the first beyond
                    near = np.flatnonzero(KIND[data[a : a + GROUP_BYTES]] == MARK)
                    if len(near):
                        stop = a + int(near[-1]) + 1
                    else:
                        beyond = np.flatnonzero(KIND[data[a + GROUP_BYTES : b]] == MARK)
                        stop = a + GROUP_BYTES + int(beyond[0]) + 1 if len(beyond) else b
                held.append((data[a:stop], lang))
                many += stop - a
                a = stop
                if many > GROUP_BYTES:
                    yield _joined(held)
                    held, many = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    return np.concatenate([d for d, _ in held]), np.concatenate(([0], np.cumsum([len(d) for d, _ in held]))), [lang for _, lang in held]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, the run of text each is in, and a number that differs between pieces."""
    kind = KIND[data]
    inner = kind == INNER
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    edges = offsets[1:-1]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(inner & ~after) + 1
    run = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, run, np.cumsum(kind == MARK)[starts] + run


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row in sorted order, and the number of rows alike; numbers below 2**32."""
    code = columns[0].astype(np.uint64)
    for column in columns[1:-1]:  # ranks keep the products within 64 bits
        code = np.unique(code * np.uint64(int(column.max(initial=0)) + 1) + column.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    last = columns[-1]
    _, at, many = np.unique(code * np.uint64(int(last.max(initial=0)) + 1) + last.astype(np.uint64), return_index=True, return_counts=True)
    return at, many


def _spelled(spans: Spans, which: np.ndarray) -> pa.StringArray:
    """The texts of some spans."""
    lengths = spans.lengths[which]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    places = np.repeat(spans.starts[which] - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(spans.data[places].tobytes()))


def _ship(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, run_langs in _packs(batches):
            data = FOLD[raw]
            starts, ends, text, piece = _words(data, offsets)
            if not len(starts):
                continue
            langs = sorted(set(run_langs))
            lang = np.array([langs.index(x) for x in run_langs])[text] if len(langs) < 50 else np.unique(np.array(run_langs, object), return_inverse=True)[1][text]
            spans = Spans(data, starts, ends)
            hashes = spans.hashes()
            known, word = np.unique(spans.first_equal(hashes, lang), return_inverse=True)
            codes, word_lang = np.concatenate((np.zeros(1, np.uint64), hashes[known])), lang[known]
            names = _spelled(spans, known)
            word = (word + 1).astype(np.int32)  # 0: no word
            second, third = np.zeros_like(word), np.zeros_like(word)
            near = piece[:-1] == piece[1:]
            del hashes, lang, text, piece, spans
            second[:-1][near] = word[1:][near]
            third[:-1][near] = second[1:][near]
            at, counts = _distinct(word, second, third)
            windows = np.stack([word[at], second[at], third[at]], 1)
            del word, second, third, near
            context = mix(codes[windows[:, 0]] + mix(codes[windows[:, 1]] + np.uint64(1)))
            window_lang = word_lang[windows[:, 0] - 1]
            out: list[tuple] = []
            lists: list[np.ndarray] = []
            for code in np.unique(window_lang):
                mine = np.flatnonzero(window_lang == code)
                order, found, cuts = by_bucket(context[mine], buckets)
                for bucket, a, b in zip(found, cuts[:-1], cuts[1:], strict=True):
                    rows = mine[order[a:b]]
                    used, local = np.unique(windows[rows], return_inverse=True)
                    if used[0] != 0:
                        used, local = np.concatenate(([0], used)), local + 1
                    local = local.reshape(-1, 3)
                    small = np.uint16 if len(used) <= 1 << 16 else np.uint32
                    many = counts[rows]
                    lists.append(used[1:] - 1)
                    out.append((langs[code], int(bucket), np.ascontiguousarray(local.T.astype(small)).tobytes(), many.astype(np.uint8 if many.max() < 256 else np.int64).tobytes(), len(rows)))
            lang_column, bucket_column, windows_column, counts_column, many_column = zip(*out, strict=True)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
            words = pa.ListArray.from_arrays(offsets, names.take(pa.array(np.concatenate(lists))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang_column, pa.string()), pa.array(bucket_column, pa.int64()), words, pa.array(windows_column, pa.binary()), pa.array(counts_column, pa.binary()), pa.array(many_column, pa.int64())],
                ["lang", "bucket", "words", "windows", "counts", "many"],
            )

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _count(least: int):
    """One bucket of one language in prefix order: rows of one word (its share), two words (f, most frequent right extension) and three
    words (f, f of the first two)."""
    def run(group: pa.Table) -> pa.Table:
        lists = group.column("words").combine_chunks()
        rows = group.column("many").to_pylist()
        sizes = pc.list_value_length(lists).to_numpy()
        encoded = pc.dictionary_encode(lists.flatten())
        names = encoded.dictionary
        rank = np.empty(len(names) + 1, np.int64)
        in_order = pc.array_sort_indices(names).to_numpy()
        rank[1 + in_order] = np.arange(1, len(names) + 1)
        rank[0] = 0
        places = encoded.indices.to_numpy() + 1
        first = np.cumsum(sizes) - sizes
        parts, counts = [], []
        for w, c, many, a, n in zip(group.column("windows").to_pylist(), group.column("counts").to_pylist(), rows, first, sizes, strict=True):
            local = np.frombuffer(w, np.uint16 if len(w) == 6 * many else np.uint32).reshape(3, many)
            parts.append(rank[np.concatenate(([0], places[a : a + n]))][local])
            counts.append(np.frombuffer(c, np.uint8 if len(c) == many else np.int64).astype(np.int64))
        w1, w2, w3 = np.concatenate(parts, 1)
        f = np.concatenate(counts)
        order = np.lexsort((w3, w2, w1))
        w1, w2, w3, f = w1[order], w2[order], w3[order], f[order]
        at = _runs(w1, w2, w3)
        w1, w2, w3, f = w1[at], w2[at], w3[at], np.add.reduceat(f, at)
        pairs, firsts = _runs(w1, w2), _runs(w1)
        f2 = np.add.reduceat(f, pairs)
        right = np.maximum.reduceat(np.where((w3 > 0) & (f >= least), f, 0), pairs)
        f2_each = np.repeat(f2, np.diff(np.append(pairs, len(f))))
        two = np.flatnonzero((f2 >= least) & (w2[pairs] > 0))
        three = np.flatnonzero((f >= least) & (w3 > 0))
        spell = pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(in_order)).cast(pa.string())])
        take = lambda ranks: spell.take(pa.array(ranks))
        none = lambda n: np.zeros(n, np.int64)
        joined = lambda *x: np.concatenate(x)
        size = joined(np.full(len(firsts), 1), np.full(len(two), 2), np.full(len(three), 3))
        return pa.table({
            "lang": pa.array([group.column("lang")[0].as_py()] * len(size), pa.string()), "size": pa.array(size.astype(np.int32)),
            "w1": take(joined(w1[firsts], w1[pairs[two]], w1[three])), "w2": take(joined(none(len(firsts)), w2[pairs[two]], w2[three])),
            "w3": take(joined(none(len(firsts) + len(two)), w3[three])), "f": pa.array(joined(np.add.reduceat(f, firsts), f2[two], f[three])),
            "near": pa.array(joined(none(len(firsts)), right[two], f2_each[three])),
        })

    return run


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size (1, 2, 3), w1, w2, w3, f and near of docs(text, lang). size 1: shares of a word's count, to be added up. size 2: near is
    the most frequent right extension. size 3: near is the count of the first two words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = rows.mapInArrow(_ship(max(1, math.ceil(size / PER_BUCKET))), "lang string, bucket long, words array<string>, windows binary, counts binary, many long")
    found = sent.groupBy("lang", "bucket").applyInArrow(_count(least), "lang string, size int, w1 string, w2 string, w3 string, f long, near long")
    return cut_lineage(found)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    whole = lambda c: c.cast("decimal(18,0)")
    product = F.lit(1000000).cast("decimal(7,0)") * (whole(a) * whole(a)).cast("decimal(31,0)")
    return F.call_function("div", product, whole(left) * whole(right)).cast("long")


def candidates(found: DataFrame, least: int = LEAST, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals) from counts(): lang, phrase, a, l, r, score of every phrase of the least count that no longer one covers; lang, n."""
    single = cut_lineage(found.where("size = 1").groupBy("lang", "w1").agg(F.sum("f").alias("f")))
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = single.where(F.col("f") >= least)
    pairs = found.where("size = 2").select("lang", "w1", "w2", F.col("f").alias("a"), F.col("near").alias("right"))
    triples = found.where("size = 3").select("lang", "w1", "w2", "w3", F.col("f").alias("a"), F.col("near").alias("f12"))
    # suffix order: triples beside the pair of their last two words
    left = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("left"))
    pairs = pairs.join(left.hint("merge"), ["lang", "w1", "w2"], "left").withColumn("covered", F.greatest("right", F.coalesce("left", F.lit(0))))
    ending = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    triples = triples.join(ending.hint("merge"), ["lang", "w2", "w3"])
    rows = pairs.where(F.lit(100) * F.col("covered") < share * F.col("a")).select("lang", F.col("w1").alias("first"), F.col("w2").alias("last"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.lit(None).cast("long").alias("f12"), F.lit(None).cast("long").alias("f23"))
    rows = rows.unionByName(triples.select("lang", F.col("w1").alias("first"), F.col("w3").alias("last"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "f12", "f23"))
    rows = rows.join(frequent.select("lang", F.col("w1").alias("first"), F.col("f").alias("f_first")).hint("merge"), ["lang", "first"])
    rows = rows.join(frequent.select("lang", F.col("w1").alias("last"), F.col("f").alias("f_last")).hint("merge"), ["lang", "last"])
    a = F.col("a")
    early = F.struct(_score(a, F.col("f_first"), F.coalesce("f23", "f_last")).alias("score"), F.lit(1).alias("k"), F.col("f_first").alias("l"), F.coalesce("f23", "f_last").alias("r"))
    late = F.when(F.col("f12").isNotNull(), F.struct(_score(a, F.col("f12"), F.col("f_last")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f_last").alias("r")))
    cut = F.least(early, late)
    return rows.select("lang", "phrase", "a", cut["l"].alias("l"), cut["r"].alias("r"), cut["score"].alias("score")), totals


def mine(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language of docs(text, lang)."""
    phrases, totals = candidates(counts(docs, least), least, share)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
