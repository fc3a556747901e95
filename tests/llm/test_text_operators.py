"""Substring dedup, page extraction, neighbours, SentencePiece scan and Kneser-Ney scoring against plain versions."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from sitemill.llm import html_extract, kneser_ney, neighbours, sentence_pieces, substring_dedup
from tests.llm import brute


def prose(rng: random.Random, sentences: int) -> str:
    out = []
    for _ in range(sentences):
        out.append(" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) + rng.choice([""] * 9 + [","]) for _ in range(rng.choice([1, 3, 9, 20, 40]))) + rng.choice([".", "!", '."', "", "?\n", "\n\n"]))
    return " ".join(out)


def test_substring_dedup(spark):
    rng = random.Random(1)
    passages = [prose(rng, 5) for _ in range(4)]
    texts = ["", " ", "One. Two. Three.", prose(rng, 3000)]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 4)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), "\n" + rng.choice(passages) + "\n")
        texts.append("".join(parts))
    texts += texts[5:8] + [passages[0] + "\n" + passages[0]]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, len(r[1]), "x") for r in rows], "doc_id long, text string, n_chars long, removed string").repartition(5)
    out = substring_dedup.dedup_substrings(docs, count="gone")
    assert out.columns == [*docs.columns, "gone"]
    want, before = brute.without_repeats(rows), dict(rows)
    for r in out.collect():
        left = brute.WORD.findall(r["text"])
        assert left == want[r["doc_id"]] and r["gone"] == len(brute.WORD.findall(before[r["doc_id"]])) - len(left) and r["n_chars"] == len(r["text"])
        assert r["gone"] or r["text"] == before[r["doc_id"]]


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (1, "short")]
    out = sorted((str(r["doc_id"]), r["text"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"] is not None)
    assert out == sorted([("1", text), ("1", text), ("None", ""), ("1", "short")])
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_dedup_finds_passages_without_marks_at_all_offsets(spark):
    rng = random.Random(4)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    passage = say(60)
    rows = [(0, " ".join(say(30) + passage + say(30)))] + [(k + 1, " ".join(say(k) + passage + say(25))) for k in range(40)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), count="gone").collect()
    for r in out:
        left = set(r["text"].split())
        assert r["gone"] == 0 if r["doc_id"] == 0 else r["gone"] >= 40 and left >= set(dict(rows)[r["doc_id"]].split()) - set(passage), r["doc_id"]


def test_sentences_end_at_marks_of_other_scripts():
    for text in ("एक दो। तीन चार॥ पाँच", "واحد اثنان؟ ثلاثة أربعة۔ خمسة", "一 二。 三 四！ 五"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert list(substring_dedup.sentences(data, *substring_dedup.word_spans_of(data, np.array([0, len(data)])))) == [0, 2, 4]


def layout(rng: random.Random, number: int) -> tuple[str, str]:
    """A page and its main text."""
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    blocks = [say(rng.randint(20, 80)) + "." for _ in range(rng.randint(2, 6))]
    title = say(5)
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b[:30]}<b>{b[30:]}</b>" for b in blocks)
    around = [f"<nav><ul>{''.join(f'<li><a href=/{k}>{say(1)}</a>' for k in range(6))}</ul></nav>", f"<div class='ad'>{say(8)}</div>", f"<footer>&copy; {say(4)}</footer>", f"<div class='comments'><p>{say(12)}</p></div>", f"<form><label>{say(2)}</label><input></form>", "<script>if (a<b) { '</p>' }</script>", f"<!-- {say(3)} > -->"]
    rng.shuffle(around)
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>")])
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(around[:3])}{open_}{body}{close}{''.join(around[3:])}", "\n".join([title, *blocks])


def test_extraction_on_unseen_layouts(spark):
    rng = random.Random(3)
    made = [layout(rng, k) for k in range(120)]
    pages = spark.createDataFrame([(k, f"u{k}", h, "x") for k, (h, _) in enumerate(made)], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in html_extract.extract(pages, sample_pages=40).collect()}
    right = sum(out[k]["text"] == text for k, (_, text) in enumerate(made))
    assert right >= 0.95 * len(made) and all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_extraction_of_given_pages(spark, sf):
    import html
    import re

    rows = html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", sources[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split(" ")).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(re.sub(r"\s+", " ", b) for b in blocks if b), r["page_id"]


def test_extraction_of_odd_pages(spark):
    odd = [None, "", "<", "<p", "a<b", "<p>x</div></p>y", "<div>" * 3000 + "deep", "<ul><li>a<li>b", "<!-- never ends", "<script>never ends", "&#x41;&nbsp;&bogus;"]
    out = html_extract.extract(spark.createDataFrame([(1, None, h) for h in odd], "page_id long, url string, html string")).collect()
    assert len(out) == len(odd) and out[0]["text"] == "" and all(r["text"] is not None for r in out)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_parts_inside_articles(spark, sf):
    long_ = "One fairly long sentence, with a comma, about nothing in particular and yet with many words in it. " * 2
    probes = [
        ("<nav><a href=/>x</a></nav><article><h1>Hi</h1><p>Short.</p></article><footer>f</footer>", "Hi\nShort."),
        (f"<article><h1>T</h1><p>{long_}</p><div class=ad>Buy this thing now</div><p>{long_}</p></article>", f"T\n{long_}\n{long_}"),
        (f"<article><h1>T</h1><p>{long_}</p><aside>{long_[:150]}</aside><p>After it.</p></article>", f"T\n{long_}\nAfter it."),
        (f"<article><h1>T</h1><p>{long_}</p><div id=comments><p>{long_}</p><p>{long_}</p></div></article>", f"T\n{long_}"),
        (f"<article><h1>T</h1><p>{long_}</p><div class=legal><p>{long_}</p></div></article><div class=legal><p>All rights.</p></div>", f"T\n{long_}\n{long_}"),
        ("<header><p>Site</p></header><main><p>One.</p></main>", "One."),
    ]
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    made = spark.createDataFrame([(10**9 + k, "u", f"<html><body>{h}</body></html>") for k, (h, _) in enumerate(probes)], "page_id long, url string, html string")
    out = {r["page_id"] - 10**9: r["text"] for r in html_extract.extract(given.unionByName(made)).collect()}
    for k, (_, text) in enumerate(probes):
        assert out[k].split() == text.split(), k


def test_decoding_is_the_best_labelling():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        page = html_extract.Page(["div"] * n, [-1, *(int(rng.integers(k)) for k in range(1, n))], [0] * n, [0] * n, [0] * n, [])
        margin = rng.normal(0, 2, n)
        score = lambda taken: sum(-np.logaddexp(0, -m if t else m) for t, m in zip(taken, margin, strict=True))  # noqa: B023, E731
        legal = [t for t in product([False, True], repeat=n) if t[0] and all(t[page.parents[k]] or not t[k] for k in range(1, n))]
        assert tuple(html_extract.decode(page, margin)) == max(legal, key=score)


STRAY = [
    "<p title=it's>", '<img alt="5" tall"><p>', "<p title='it's'>", '<p ="x>', '<p class=a"b>', "<p title=a='b>", "<p it's>", '<p title="it\'s > 1">', "<p title= 'a > b' id=x>", "<p title=>", '<p title="5>',
]


@pytest.mark.parametrize("tag", STRAY)
def test_stray_quotes_take_no_text(tag):
    for rest in ("tail words</p><p>last words</p>", "tail words</p><p>it's said last words</p>"):
        read = " ".join(text for _, text, _ in html_extract.read_page(f"<div>first words{tag}{rest}").blocks)
        assert read.startswith("first words tail words") and read.endswith("last words"), read


def test_tags_end_where_browsers_end_them():
    words = lambda source: [text for _, text, _ in html_extract.read_page(source).blocks]
    assert words('<p>a</p><p alt="5" tall">b</p><p title="x">c</p>') == ["a", "b", "c"]
    assert words("<p>a</p><p title=it's>b</p><p>it's c</p>") == ["a", "b", "it's c"]
    assert words('<p>a</p><p title="x > y">b</p><p') == ["a", "b"]


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    page = html_extract.read_page("<div><p>a</p><div><p>b<p>c</div></div><nav>d</nav>" * 5)
    for _ in range(50):
        taken = html_extract.decode(page, rng.normal(0, 3, len(page.tags)))
        assert all(taken[p] for k, p in enumerate(page.parents) if k and taken[k])


@pytest.mark.parametrize("count", [5, 15, 150, 900, 3000])
def test_neighbours_of_small_groups_of_near_copies(spark, count):
    rng = np.random.default_rng(count)
    vectors = rng.standard_normal((count, 16))
    for k in range(0, count - 4, 100):  # a query and up to 4 near copies
        vectors[k + 1 : k + 5] = vectors[k] + 1e-9 * rng.standard_normal((4, 16))
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in neighbours.search_table(table).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, count, 100):
        distance = ((vectors - vectors[q]) ** 2).sum(1)
        best = [int(k) for k in np.argsort(distance, kind="stable") if k != q][:10]
        assert len(set(found[q])) == len(found[q]) == min(10, count - 1)
        hits += len(set(best) & set(found[q]))
        if count <= 900:
            assert set(best) == set(found[q])
    assert hits >= 0.95 * min(10, count - 1) * len(range(0, count, 100))


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((20, 24))[rng.integers(0, 20, 3000)]
    vectors[1000:1500] = vectors[7]
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(vectors)]
    odd = [(5000, None), (5100, []), (5200, [0.0] * 24), (5300, [math.nan] * 24), (5400, [None] * 24), (5500, [math.inf] * 24), (None, rows[0][1]), (5600, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>")
    found: dict[int, list] = {}
    for r in neighbours.search_table(table, shard=700, block=13).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = np.array([v for _, v in rows], np.float64)
    hits = 0
    for q in range(0, 3000, 100):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        best = [int(k) for k in np.lexsort((np.arange(3000), distance)) if k != q][:10]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(s == pytest.approx(distance[v], rel=1e-12) for _, v, s in got)
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        hits += len(set(best) & {v for _, v, _ in got})
    assert hits >= 0.9 * 300 and set(found) == set(range(0, 3000, 100))
    assert neighbours.search_table(table.limit(0)).count() == 0


def test_equal_vectors_come_by_id(spark):
    table = spark.createDataFrame([(k, [1.0, 0.5]) for k in range(0, 250)], "vec_id long, embedding array<float>")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.search_table(table, shard=60).collect()}
    assert [out[100, k][0] for k in range(1, 11)] == list(range(10)) and [out[0, k][0] for k in range(1, 11)] == list(range(1, 11)) and out[0, 1][1] == 0


ODD = ["", " ", "  ", "a", "▁", "a▁b", "\n", "\x00", "<s>", "😀", "x" * 3000, "=" * 500, " " * 300, "ab" * 400, "　é" * 50]


def test_chunks_equal_the_library():
    pieces, rng = sentence_pieces.model(sentence_pieces.MODEL), random.Random(5)
    texts = ODD + ["".join(rng.choice("aeinrst") for _ in range(200)) for _ in range(40)] + ["".join(rng.choice(["in", "the ", "é", " ", "\n", "ing", "==", "7", "梦"]) for _ in range(120)) for _ in range(40)]
    for text in texts:
        for chunk, near in ((23, 0), (61, 9)):
            assert sentence_pieces.encode_in_chunks(pieces, text, chunk, near) == pieces.library.encode(text), (text[:40], chunk)


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, 0.0) for _ in range(3))
    assert np.array_equal(sentence_pieces.max_plus(sentence_pieces.max_plus(a, b), c), sentence_pieces.max_plus(a, sentence_pieces.max_plus(b, c)))


def test_encode_and_decode(spark):
    rng = random.Random(6)
    long = ["".join(rng.choice("aeinrst") for _ in range(3000)), " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(2000))]
    texts = [None, *ODD, *long, long[0]]
    docs = spark.createDataFrame([(k % 7, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, rest string")
    rows = sentence_pieces.encode(docs, giant=1000, chunk=400)
    assert rows.columns == ["doc_id", "text", "rest", "ids"]
    library = sentence_pieces.model(sentence_pieces.MODEL).library
    got = sentence_pieces.decode(rows).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == (None if r["text"] is None else library.encode(r["text"]))
        assert r["decoded"] == (r["text"] and r["text"].replace("▁", " "))
    assert sentence_pieces.encode(docs.limit(0)).count() == 0
    digests = {(r["doc_id"], r["n_tokens"], r["ids_crc"]): r["round_trip"] for r in sentence_pieces.digest(docs).collect()}
    assert (0, None, None) in digests and sum(x is False for x in digests.values()) == sum("▁" in (t or "") for t in texts)


def test_kneser_ney(spark):
    rng = random.Random(7)
    words = ["The", "the", "of", "é", *(f"w{k}" for k in range(60))]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 8, 40])))) for k in range(150)] + [(500, None), (None, "of the"), (3, "of the of"), (501, "never seen here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(4)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    model = brute.Bigrams([t for k, t in rows if not held(k)])
    total, kinds = sum(model.words.values()), len(model.words)
    assert sum(map(model.word, model.words)) + model.kept / (kinds + 1) == pytest.approx(1)
    want = []
    for k, text in rows:
        tokens = model.tokens(text)
        base = sum(math.log10((model.words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        score = sum(math.log10(model.probability(v, w)) for v, w in zip(["<s>", *tokens[:-1]], tokens, strict=True))
        want.append((str(k), held(k), len(tokens), sum(w in model.words for w in tokens), total, round(base, 6), round(score, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in kneser_ney.score_documents(docs).collect()]
    assert sorted(got) == sorted(want)


def test_kneser_ney_beats_words_on_held_out_text(spark, sf):
    rows = kneser_ney.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_kneser_ney_without_training_text(spark):
    assert kneser_ney.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = [r for r in kneser_ney.score_documents(spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1][:1], "doc_id long, text string")).collect()]
    assert row["train_tokens"] == 0 and row["score"] == pytest.approx(0)
