"""Token files, phrase collocations and the filter audit against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from sitemill.llm import collocations, filter_audit, plans, spans, token_blocks, token_files
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, rank long"


def say(rng: random.Random, words: int, letters: str = "abcdé") -> str:
    return "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) + rng.choice([" "] * 12 + ["\t", "  ", ". ", "\n", ", ", " \x0b"]) for _ in range(words))


def test_spans_with_one_hash_stay_apart():
    words = [b"a", b"b", b"a", b"", b"x" * 300, b"x" * 299 + b"y", b"x" * 300, b"12345678", b"123456789", b"12345678"]
    ends = np.cumsum([len(w) for w in words])
    found = spans.Spans(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    for hashes in (found.hashes(), np.zeros(len(words), np.uint64), np.arange(len(words), dtype=np.uint64) % 2 * np.uint64(0)):
        assert [words[k] for k in found.first_equal(hashes)] == words and list(found.first_equal(hashes)) == [words.index(w) for w in words]
    group = np.array([0, 0, 1, 0, 0, 0, 0, 0, 0, 1])
    assert list(found.first_equal(np.zeros(len(words), np.uint64), group)) == [0, 1, 2, 3, 4, 5, 4, 7, 8, 9]


@pytest.mark.parametrize("kind", ["small", "wide", "same", "outliers", "ramp"])
@pytest.mark.parametrize("many", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(kind, many):
    rng = np.random.default_rng(many)
    values = {"small": rng.integers(0, 5, many), "wide": rng.integers(0, 1 << 32, many), "same": np.full(many, 4_294_967_295), "outliers": np.where(rng.random(many) < 0.05, rng.integers(0, 1 << 32, many), 7), "ramp": np.arange(many)}[kind].astype(np.uint32)
    table, data = token_blocks.encode(values, 100)
    assert (token_blocks.decode(table, np.frombuffer(data, np.uint8), 100) == values).all() and len(table) == -(-many // token_blocks.BLOCK)
    for a in range(len(table)):  # any block by itself
        stop = int(table["start"][a + 1]) - 100 if a + 1 < len(table) else len(data)
        part = np.frombuffer(data[int(table["start"][a]) - 100 : stop], np.uint8)
        assert (token_blocks.decode(table[a : a + 1], part, int(table["start"][a])) == values[1024 * a : 1024 * (a + 1)]).all()
    if kind == "outliers" and many == 5000:
        assert len(data) < 5000  # a few wide values do not widen the rest


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "\n\n", "a", "it's  don't 'll x　y  z", "x" * 700, "naïve 日本語 текст 12 345!!\r\n\tend ", "<|endoftext|> a<|endoftext|>", "a \n b\n c  \n\n d", "\x00\x01 \x1c \x85 a", "😀 😀😀 é"]


@pytest.mark.parametrize("most", [1, 7, 50, 1 << 20])
def test_ids_of_cut_texts_are_the_library_s(most):
    import public_tokenizers

    rng = random.Random(most)
    texts = ODD + [say(rng, rng.randint(0, 60)) + rng.choice(ODD) for _ in range(40)]
    got = defaultdict(list)
    for row, ids, counts, _ in token_files.encode_texts(pa.array([None, *texts]), public_tokenizers.path("byte_bpe_50k.json"), most=most):
        for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            got[row + k] += part.tolist()
    assert [got[k] for k in range(len(texts) + 1)] == [[2]] + [ids + [2] for ids in library(texts)]


def test_token_files(spark, monkeypatch):
    import public_tokenizers

    rng = random.Random(3)
    rows = [(k * 7 % 211, t, "en", k) for k, t in enumerate(ODD + [say(rng, rng.randint(0, 400)) for _ in range(150)])]
    rows += [(None, "no name", None, None), (5, None, "en", 1), (5, "again", "en", 1), (5, "again", "en", 2), (300, say(rng, 30000), "en", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    written = token_files.write_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert len(written.files) > 3 and sum(f[3] for f in written.files) == len(rows)
    read = sorted(token_files.read_documents(spark, written).collect(), key=lambda r: r["start"])
    ids = library([r[1] or "" for r in rows])
    want = Counter((r[0], tuple(i + [2])) for r, i in zip(rows, ids, strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in read) == want
    names = [-1 if r["doc_id"] is None else r["doc_id"] for r in read]
    assert names == sorted(names) and [r["start"] for r in read] == np.cumsum([0] + [len(r["ids"]) for r in read])[:-1].tolist()
    sums = {r["start"]: (r["doc_id"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in read}
    assert {r["start"]: (r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, written).collect()} == sums
    number, before, many, _ = max(written.files, key=lambda f: f[2])
    file = token_files.TokenFile(written.folder, f"ids-{number}")
    flat = [i for r in read for i in r["ids"]][before : before + many]
    for a, b in [(0, 1), (1000, 1100), (many - 5, many), (0, many)]:
        assert file.ids(a, b - a).tolist() == flat[a:b]
    # the same rows again give the same files
    again = token_files.write_documents(docs.repartition(3), public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter(map(tuple, token_files.digests(spark, again).collect())) == Counter(map(tuple, token_files.digests(spark, written).collect()))
    empty = token_files.write_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.digests(spark, empty).count() == 0 and token_files.read_documents(spark, empty).count() == 0


def test_a_torn_file_is_refused(spark, tmp_path):
    (tmp_path / "ids-0").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="no whole file"):
        token_files.TokenFile(str(tmp_path), "ids-0")


def plain_collocations(rows, least=10, share=50, top=2000):
    counts, out = defaultdict(Counter), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        found = [x for x in f if len(x) > 1 and f[x] >= least]
        kept = []
        for x in found:
            if len(x) == 2 and any(len(y) == 3 and x in (y[:2], y[1:]) and 100 * f[y] >= share * f[x] for y in found):
                continue
            score, k = min((1000000 * f[x] ** 2 // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
            kept.append((-score, -f[x], " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        n = sum(c for x, c in f.items() if len(x) == 1)
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, monkeypatch, top):
    rng = random.Random(8)
    monkeypatch.setattr(collocations, "PER_BUCKET", 3000)
    monkeypatch.setattr(collocations, "GROUP_BYTES", 2000)
    rows = [(say(rng, rng.randint(0, 120), rng.choice(["ab", "abcÉé", "AaB"])), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [("the one of the one of", "en")] * 30 + [("a b", "fr"), (None, "en"), ("", "xx"), ("x x x x x x x x x x x x", "rep"), ("q" * 5000 + " r " * 20 + "q" * 5000, "long")]
    docs = spark.createDataFrame([(1, *r, 5) for r in rows], DOCS).repartition(4)
    want = plain_collocations(rows, top=top)
    got = [tuple(r) for r in collocations.mine(docs, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert Counter(got) == Counter(want) and len(want) > 20 and any(" ".join(["x"] * 3) == r[2] for r in want)


def test_scores_beyond_64_bits(spark):
    big = [(10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 9), (10**12, 10**12, 10**12), (11, 10**13, 10**13)]
    rows = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in rows.select(collocations._score(*(rows[c] for c in "alr"))).collect()]
    assert got == [1000000 * a * a // (left * r) for a, left, r in big]


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1), (2, " . ", "en", 1)], DOCS)).count() == 0


def plain_audit(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    parts = defaultdict(list)
    for doc, text, lang in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > least[text]}
        parts[lang or ""].append((doc, {k for k, v in fails.items() if v}))
    out = {}
    for part, found in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before, failing = set(order[: step - 1]), [x for x in found if f in x[1]]
                here = [doc for doc, x in failing if not x & before]
                total[f] += len(here)
                out[part, order, step] = [sum(not x & set(order[:step]) for _, x in found), len(here), len(failing) - len(here), sum(x == {f} for _, x in failing), sum(d in good for d in here), sum(d in toxic for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        text = say(rng, rng.choice([3, 150, 260]), rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé日"])) + rng.choice(["", "", "", "#", "|"]) + "A" * rng.choice([0, 0, 60])
        rows.append((k * 11 % 97, text, rng.choice(["en", "de", None, ""])))
    rows += [(rng.randint(0, 300), rows[k % 20][1], "en") for k in range(120)] + [(None, rows[0][1], "en"), (None, None, None), (400, None, "en"), (401, "", "en"), (402, "", "fr"), rows[3], rows[3]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(6)
    want = plain_audit(rows, labels)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want
    assert len(got) == len(want) == 4 * 600
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    bare = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert bare.count() == 2400 and bare.where("good_lost + toxic_lost > 0").count() == 0


def test_one_pass_counts_of_given_documents(spark, sf):
    for r, found in zip(*(sorted(x, key=lambda r: r["doc_id"]) for x in (spark.read.parquet(f"{sf}/documents.parquet").collect(), filter_audit.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect())), strict=True):
        words = brute.WORD.findall(r["text"])
        assert [found[c] for c in ("words", "distinct", "capitals", "points", "symbols")] == [len(words), len(set(words)), len(re.findall("[A-Z]", r["text"])), len(r["text"]), len(re.findall(r"[#$%&*|]", r["text"]))]


def test_token_files_of_given_documents(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, want = 0, []
    for (doc, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        want.append((doc, start, len(ids) + 1, zlib.crc32(np.array(ids + [2], "<u4").tobytes())))
        start += len(ids) + 1
    got = plans.op11_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
