"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from sitemill.llm import quality_rules, sentence_pieces, substring_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output rows over documents, written and read again between stages."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs.collect(), after.collect(), docs.columns, after.columns
        docs = after
    return out


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(before == after for _, _, before, after in list(stages.values())[:-1])


def test_quality(spark, stages):
    before, after, *_ = stages["quality rules"]
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] not in kept for r in before if brute.base_counts(r["text"])[5])
    clean = [r for r in before if not brute.base_counts(r["text"])[5] and brute.base_counts(r["text"])[2] == 0 and "!!" not in r["text"]]
    assert sum(r["doc_id"] in kept for r in clean) >= 0.97 * len(clean)
    table = spark.createDataFrame(before)
    assert kept == {r["doc_id"] for r in quality_rules.judge(table.select("doc_id", "text")).where("kept").collect()}
    assert set(after) <= set(before)


def test_near_duplicates(stages):
    before, after, *_ = stages["n-gram Jaccard join"]
    groups = brute.jaccard_components([(r["doc_id"], r["text"]) for r in before])
    assert Counter(after) == Counter(r for r in before if groups[r["doc_id"]][1] == r["doc_id"])


def test_passages(stages):
    before, after, *_ = stages["substring dedup"]
    left = brute.without_repeats([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: brute.WORD.findall(r["text"]) for r in after} == left and len(after) == len(before)


def test_passages_are_those_of_the_operator(spark, stages):
    before, after, *_ = stages["substring dedup"]
    assert Counter(after) == Counter(substring_dedup.dedup_substrings(spark.createDataFrame(before)).collect())
    say = " ".join(f"word{k}" for k in range(70))
    docs = spark.createDataFrame([(1, "start of it " + say + " and on"), (2, "another thing before " + say + " goes on here")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert "word30" in left[1] and "word30" not in left[2] and "another thing" in left[2]  # a passage in the middle of a line


def test_texts_that_share_an_id(spark):
    say = lambda tag, n=40: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, say("a"), "s"), (1, say("b"), "s"), (2, say("a") + " x", "s"), (3, say("c"), "s"), (3, say("c"), "t"), (3, say("c"), "s"), (None, say("a"), "s"), (None, None, "s"), (4, None, "s"), (5, "", "s"), (6, say("b") + " y", "s")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        out = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()))
        assert out == Counter([(1, say("a")), (1, say("b")), (3, say("c")), (None, say("a")), (None, None), (4, None), (5, "")])
    assert len({tuple(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, source string"), "").where("doc_id = 3").first()) for order in (rows, rows[::-1])}) == 1


def test_equal_rows_of_two_sources_keep_their_quotas(spark):
    texts = [" ".join(f"w{n}x{k}" for k in range(200)) for n in range(6)]
    rows = [(n, t, s) for n, t in enumerate(texts) for s in ("a", "b")]
    mixed = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        sums = Counter()
        found = corpus_pipeline.mixture(spark, docs, "").collect()
        for r in found:
            sums[r["source"]] += len(r["text"].split())
        want = brute.targets(Counter({"a": 1200, "b": 1200}))
        assert all(abs(sums[s] - want[s]) <= 100 for s in "ab"), sums
        mixed.append(Counter(found))
    assert mixed[0] == mixed[1]


def test_mix(stages):
    before, after, *_ = stages["mixing sources to target weights"]
    size, text, source = {}, {}, {}
    for r in before:
        size[r["doc_id"]], text[r["doc_id"]], source[r["doc_id"]] = len(brute.WORD.findall(r["text"])), r["text"], r["source"]
    totals, taken, by_source = Counter(), Counter(), Counter()
    for doc, n in size.items():
        totals[source[doc]] += n
    for r in after:
        words = brute.WORD.findall(r["text"])
        taken[r["doc_id"]] += len(words)
        by_source[r["source"]] += len(words)
        assert set(words) <= set(brute.WORD.findall(text[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert all(taken[d] <= 2 * size[d] for d in size)
    for s, want in brute.targets(totals).items():
        assert abs(by_source[s] - want) <= 100


def test_encoding(stages):
    before, after, *_ = stages["SentencePiece encoding and decoding"]
    library = sentence_pieces.model(sentence_pieces.MODEL).library
    want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in before)
    assert want == Counter((r["doc_id"], tuple(r["ids"])) for r in after) and all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_and_empty_table(spark, sf, stages, tmp_path):
    last = list(stages.values())[-1][1]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in last)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
