"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are taken of every whole text. The rules then run as one CASE expression, which stops at the
first rule that rejects; their order is by rejected share per second, both estimated on a bounded sample, so
that cheap rules that reject much come first. The order changes the work, never the verdict: a document is
kept if no rule rejects it. Windows and words are compared by 64-bit hashes.

Null and empty texts count zero everywhere and fail the base rules (fewer than 10 words). Each row is judged by
itself, so repeated rows get equal verdicts; other columns of docs do not matter. An empty table gives none."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
#: Rows of the sample that orders the rules; it takes no part in any verdict.
SAMPLE_ROWS = 1000
WINDOW = 5


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _text, _words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    trimmed = F.btrim("_text", F.lit(BLANK))
    out = out.withColumn("_words", F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0))
    at = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    out = out.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, window).otherwise(F.array().cast("array<long>")))
    # most texts repeat no window; only the others are sorted
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(repeats, placed).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    twin = F.filter("_sorted", lambda e, j: (F.get("_sorted", j - 1)["x"] == e["x"]) | (F.get("_sorted", j + 1)["x"] == e["x"]))
    out = out.withColumn("_starts", F.sort_array(F.transform(twin, lambda e: e["i"])))
    step = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    n_words, repeated = F.size("_words").cast("long"), F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)
    counts = F.struct(
        "_words",
        n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    # the generator keeps the optimizer from putting these expressions into later filters and lambdas again
    out = out.select(*docs.columns, "_text", F.explode(F.array(counts)).alias("_base")).select(*docs.columns, "_text", "_base.*")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A rule over the base counts, _text and _words; reject is true for documents to go."""

    name: str
    reject: Column


def _occurs(pattern: str) -> Column:
    return F.size(F.split("_text", pattern, -1)) - 1


def default_rules() -> list[Rule]:
    """Rules for prose in any of the usual European languages; each is far from what clean prose reaches."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("word_length", (chars < 2 * words) | (chars > 15 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("capitals", 2 * _occurs(r"\p{Lu}") > chars),
        Rule("letters", 10 * _occurs(r"\p{L}") < 4 * chars),
        Rule("shouting", 3 * _occurs("!") > words),
        Rule("stutter", 4 * F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))) > words),
        Rule("longest_word", F.col("_text").rlike(r"[^\x20\x09-\x0D]{300}")),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share rejected per second, estimated on the first rows rows of docs(text) that Spark finds: it
    reads no more partitions than these need, and nothing is shuffled."""
    texts = docs.select("text").take(rows)
    if not texts:
        return list(rules)
    sample = base_counts(docs.sparkSession.createDataFrame(texts, docs.select("text").schema)).persist()
    try:
        def timed(condition: Column) -> tuple[float, int]:
            began = time.monotonic()
            hits = sample.agg(F.count_if(condition)).first()[0]
            return time.monotonic() - began, hits

        sample.count()
        idle = min(timed(F.col("n_words") < 0)[0] for _ in range(2))
        rate = {}
        for rule in rules:
            seconds, hits = timed(rule.reject)
            rate[rule.name] = hits / max(seconds - idle, 1e-3)
        return sorted(rules, key=lambda rule: -rate[rule.name])
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.reject, F.lit(rule.name))
    return verdict


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base counts, rejected_by (the first rejecting rule in the order chosen, else null) and kept."""
    counted = base_counts(docs)
    ordered = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    return counted.withColumn("rejected_by", cascade(ordered)).withColumn("kept", F.col("rejected_by").isNull()).drop("_text", "_words")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns only. docs may have any further columns."""
    inner = docs.select(F.col("text").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    return judge(inner).where("kept").select("_row.*")
