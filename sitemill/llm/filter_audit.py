"""Filter interaction audit: what each filter removes, alone and behind others, over every order of the filters.

1. A table-driven transducer reads the UTF-8 bytes of some megabytes of texts once: the class of a byte and the state
   before it (in a word or not) give the emissions: word start, capital, code point, symbol. The state after a byte
   depends on that byte's class alone, so the table is applied to all bytes at once. Word spans go into a hash
   table per text that compares bytes (spans.py), which gives the distinct words.
2. Rows become a pattern of failed filters. Whether a text repeats that of a smaller doc_id follows from minima per SHA-256
   digest: rows that agree in everything are added up first, so a text with very many copies is a few rows a task.
3. Rows are counted by part and pattern (sums before the shuffle). A filter set keeps the rows whose pattern does not meet
   it, so each part has one count a set, and each step of each order is the difference of two of them.

Null texts are empty texts; null languages are part ''. A row with a null doc_id never fails E, makes no other row fail it
and has no labels. Rows that repeat a doc_id each count; they fail E only beside a row of a smaller doc_id. A document has
a label if any of its label rows has it. No documents give no rows. A text is read whole in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.spans import Spans, text_groups

LETTERS = "ABCDE"
REPEATED = "E"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3

# the transducer: byte classes, the state after each class, and what a byte emits by state before it and class
SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, FOLLOWING = range(6)
OUTSIDE, INSIDE = 0, 1
WORD_START, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASS[0x80:0xC0] = FOLLOWING
CLASS[0xC0:] = LEAD
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
_OF_CLASS = np.array([IS_POINT, IS_POINT | IS_CAPITAL, IS_POINT | IS_SYMBOL, IS_POINT, IS_POINT, 0], np.uint8)
EMITS = np.stack([_OF_CLASS | np.where(NEXT == INSIDE, WORD_START, 0).astype(np.uint8), _OF_CLASS])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text in one pass of the transducer."""
    kind = CLASS[data]
    after = NEXT[kind]
    before = np.zeros(len(data), np.uint8)
    before[1:] = after[:-1]
    inner = offsets[offsets < len(data)]
    before[inner] = OUTSIDE  # each text starts anew
    emitted = EMITS[before, kind]
    starts = np.flatnonzero(emitted & WORD_START)
    closes = np.ones(len(data), bool)
    closes[:-1] = after[1:] == OUTSIDE
    closes[inner[inner > 0] - 1] = True
    ends = np.flatnonzero((after == INSIDE) & closes) + 1
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    spans = Spans(data, starts, ends)
    new = spans.first_equal(spans.hashes(), text) == np.arange(len(starts))
    counted = {name: _per_text(emitted & flag > 0, offsets) for name, flag in (("capitals", IS_CAPITAL), ("points", IS_POINT), ("symbols", IS_SYMBOL))}
    return {"words": np.diff(first), "distinct": np.bincount(text[new], minlength=len(offsets) - 1), **counted}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails, digests, counts = [], [], []
        for _, data, offsets in text_groups(batch.column("text")):
            m = measure(data, offsets)
            failed = [m["words"] < LEAST_WORDS, 100 * m["distinct"] < DISTINCT_PERCENT * m["words"], 100 * m["capitals"] > CAPITAL_PERCENT * m["points"], m["symbols"] > 0]
            fails.append(sum(f.astype(np.int32) << k for k, f in enumerate(failed)))
            counts.append(np.stack(list(m.values())))
            digests += [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if digests:
            all_counts = np.concatenate(counts, 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(np.concatenate(fails)), *map(pa.array, all_counts)], ["doc_id", "part", "digest", "fails", "words", "distinct", "capitals", "points", "symbols"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), fails (filters A to D, A the lowest bit) and the counts of every row of docs(doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge, "doc_id long, part string, digest binary, fails int, words long, distinct long, capitals long, points long, symbols long")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of LETTERS), good, toxic and n: the number of documents."""
    rows = judge(docs).groupBy("digest", "part", "fails", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    has = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    rows = rows.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # one row a text, part and labels: all rows, those without a doc_id, and the smallest doc_id with its rows
    alike = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("new", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    repeat = 1 << LETTERS.index(REPEATED)
    both = F.array(F.struct("fails", F.col("new").alias("n")), F.struct(F.col("fails").bitwiseOR(repeat).alias("fails"), (F.col("n") - F.col("new")).alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(both).alias("b")).select("part", "good", "toxic", "b.fails", "b.n").where("n > 0")
    return split.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counted(part, fails, good, toxic, n)."""
    sets = range(1 << len(letters))
    kept = lambda m, rows: F.sum(F.when(F.col("fails").bitwiseAND(m) == 0, rows).otherwise(0))
    n = F.col("n")
    kinds = {"all": n, "good": F.when(F.col("good"), n).otherwise(0), "toxic": F.when(F.col("toxic"), n).otherwise(0)}
    each = counted.groupBy("part").agg(
        *(F.array(*(kept(m, rows) for m in sets)).alias(name) for name, rows in kinds.items()),
        F.array(*(F.sum(F.when(F.col("fails") == 1 << k, n).otherwise(0)) for k in range(len(letters)))).alias("only"),
    )
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(f"('{''.join(letters[x] for x in order)}', {step}, {k}, {before}, {before | 1 << k})")
            before |= 1 << k
    rows = each.select("*", F.expr(f"inline(array({', '.join(steps)}))").alias("filter_order", "step", "filter", "before", "after"))
    at = lambda name, m: F.get(F.col(name), F.col(m))
    lost = lambda name: at(name, "before") - at(name, "after")
    return rows.select(
        "part", "filter_order", "step", at("all", "after").alias("kept"), lost("all").alias("removed"),
        (F.get("all", F.lit(0)) - F.get("all", F.expr("shiftleft(1, filter)")) - lost("all")).alias("redundant"),
        at("only", "filter").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.sum(lost("all")).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over docs(doc_id, text, lang) and labels(doc_id, quality, toxic); see interactions."""
    return interactions(patterns(docs, labels))
