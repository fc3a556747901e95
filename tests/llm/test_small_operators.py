"""Quality rules, URL filter, mixing and preference pairs against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitemill.llm import mixing, preference_format, quality_rules, url_filter
from tests.llm import brute

TEXTS = [
    None, "", " \n ", "one", "a b a b a b a b a b a b", "line one here\nline one here\nline two\n\n line two", "# | <x> $5 &amp; 100%\n", "the cat sat on the mat " * 3, "Ñandú über 梦 😀 ok",
    "  non breaking　space \x0bvt\x0cff\rcr", "x" * 5000, "plain words that follow one another without any repetition at all in here", "SHOUT!! " * 20, "be be be be be be the the the the the the of of of of",
]


def test_base_counts(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_rules.judge(rows).collect()}
    for k, text in enumerate(TEXTS):
        row = found[k]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.base_counts(text), text
        assert not (row["base_failed"] and row["kept"])
    assert found[11]["kept"] and not found[12]["kept"]


def test_order_never_changes_the_verdict(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    rules = quality_rules.default_rules()
    counted = quality_rules.base_counts(rows)
    kept = [sorted(r["doc_id"] for r in counted.where(quality_rules.cascade(order).isNull()).collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    assert {r.name for r in quality_rules.order_rules(rows, rules)} == {r.name for r in rules}


def test_filter_keeps_columns_and_takes_any(spark):
    rows = spark.createDataFrame([(1, TEXTS[11], "a", 5), (2, "bad", "b", None)], "doc_id long, text string, _text string, n_words int")
    out = quality_rules.filter_documents(rows)
    assert out.columns == rows.columns and [tuple(r) for r in out.collect()] == [(1, TEXTS[11], "a", 5)]
    assert quality_rules.filter_documents(rows.limit(0)).count() == 0


URLS = ["http://A.b.NET/x?y", "https://example.net/en/1", "https://sub.example.net/en", "http://example.com/de/", "http://x.example.com/fr/q", "http://q.org/fr/1", "ftp://q.org", "no url", None, "http://", "http://net/", "http://evil.com/", "http://good.com/#a/b", "://h/p"]


def plain_rule(host: str, path: str):
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string")
    for row in url_filter.judge_urls(pages).collect():
        url = URLS[row["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (row["host"], row["path"]) == (brute.lower(rest[:cut]), path), url
        rule = plain_rule(row["host"], path)
        assert (row["rule"], row["verdict"]) == (rule or (None, "allow")), url


def plain_rank(links: Counter, seeds: set[str], rounds: int = url_filter.ROUNDS) -> dict[str, float]:
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    start = {s: 0.15 / len(seeds) for s in seeds}
    rank = Counter(start)
    for _ in range(rounds):
        new = Counter(start)
        for (a, b), n in links.items():
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    return rank


def test_propagation(spark):
    page = lambda *hosts: "".join(f'<a class="l" href="https://{h}/x">y</a>' for h in hosts)
    rows = [("http://bad.net/", page("bad2.com")), ("http://spam.com/", page("bad.net", "bad.net", "farm.com")), ("http://farm.com/", page("spam.com")), ("http://q.org/fr/1", page("good.com")), ("http://good.com/", page("bad.net", "fine.com")), ("http://fine.com/", page("good.com")), ("http://lone.com/", "<a href=/x>"), ("http://lone.com/", None)]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    found = {r["host"]: r for r in url_filter.judge_urls(pages).collect()}
    links = Counter({("bad.net", "bad2.com"): 1, ("spam.com", "bad.net"): 2, ("spam.com", "farm.com"): 1, ("farm.com", "spam.com"): 1, ("q.org", "good.com"): 1, ("good.com", "bad.net"): 1, ("good.com", "fine.com"): 1, ("fine.com", "good.com"): 1})
    trust, distrust = plain_rank(links, {"q.org"}), plain_rank(Counter({(b, a): n for (a, b), n in links.items()}), {"bad.net"})
    for host, row in found.items():
        assert row["trust"] == pytest.approx(trust.get(host, 0), abs=1e-5) and row["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-5), host
    assert {h: r["verdict"] for h, r in found.items()} == {"bad.net": "block", "spam.com": "block", "farm.com": "block", "q.org": "allow", "good.com": "allow", "fine.com": "allow", "lone.com": "allow"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seeds", [1, 200_000])
def test_propagation_to_the_end_of_a_long_chain(spark, seeds):
    links = spark.createDataFrame([(f"c{k}", f"c{k + 1}", 1) for k in range(40)], "src string, dst string, weight long").repartition(2)
    many = spark.range(1, seeds).selectExpr("concat('s', id) AS host").unionByName(spark.createDataFrame([("c0",)], "host string"))
    found = {r["host"]: r["rank"] for r in url_filter.personalised_rank(links, many).where("host LIKE 'c%'").collect()}
    assert set(found) == {f"c{k}" for k in range(41)}
    for k in range(41):
        assert found[f"c{k}"] * seeds == pytest.approx(0.15 * 0.85**k, rel=1e-9)


def test_rank_of_a_loop_settles_under_many_seeds(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, weight long")
    seeds = spark.range(1, 200_000).selectExpr("concat('s', id) AS host").unionByName(spark.createDataFrame([("a",)], "host string"))
    found = {r["host"]: r["rank"] * 200_000 for r in url_filter.personalised_rank(links, seeds).where("host IN ('a', 'b')").collect()}
    assert found["a"] == pytest.approx(0.15 / (1 - 0.85**2), rel=0.01) and found["b"] == pytest.approx(0.85 * found["a"], rel=0.01)


def mixture_rows(seed: int):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        source = "big" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "z", None])
        text = None if rng.random() < 0.02 else " ".join(f"w{k}x{j}" for j in range(rng.choice([0, 1, 5, 60, 700])))
        rows.append((k if rng.random() < 0.95 else None, text, source))
    return rows + rows[:5]


def test_mixture(spark):
    rows = mixture_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.WORD.findall(text or ""))
    want, taken = brute.targets(sizes), Counter()
    by_size = {(sizes[s], round(want[s], 6)): s for s in sizes}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[by_size[r["source_size"], round(r["target"], 6)]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK_WORDS, s
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("mixed", [mixing.mix, mixing.mixed_documents])
def test_blocks_of_the_mix_are_not_broadcast(spark, mixed):
    """The choice of blocks grows with the words, so no side of a join that the driver collects may be made of them."""
    docs = spark.createDataFrame(mixture_rows(3), "doc_id long, text string, source string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "256k")
    try:
        plan = mixed(docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset(limit)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = [x for n, x in enumerate(plan) if n > k and all(depth(y) > depth(line) for y in plan[k + 1 : n + 1])]
            assert not any("Generate explode" in x for x in below), "\n".join(below)


def test_drawn_blocks(spark):
    """A shard takes all its blocks as often as its quota allows and the rest in the seeded order."""
    docs = spark.createDataFrame(mixture_rows(4), "doc_id long, text string, source string")
    rows, pieces = mixing.mix_blocks(docs, block_words=16, shard_words=3_000)
    found = rows.join(pieces, ["place", "shard", "row"]).select("place", "shard", "row", "size", "first", "words", "times").collect()
    sizes = {(r["place"], r["shard"], r["row"]): r["size"] for r in rows.where("size > 0").collect()}
    shards: dict[tuple, list] = {}
    for (place, shard, row), size in sorted(sizes.items()):
        shards.setdefault((place, shard), []).append((row, size))
    taken = {(r["place"], r["shard"], r["row"], r["first"] + k): r["times"] for r in found for k in range(r["words"])}
    assert len(shards) > 5
    for (place, shard), held in shards.items():
        words = [(place, shard, row, k) for row, size in held for k in range(size)]
        n = max(1, int(len(words) / 16 + 0.5))
        times = []
        for b in range(n):
            each = {taken.get(w, 0) for w in words[b * len(words) // n : (b + 1) * len(words) // n]}
            assert len(each) == 1
            times += each
        passes, order = min(times), [r["b"] for r in spark.range(n).select(F.col("id").alias("b")).orderBy(F.xxhash64(F.lit(mixing.SEED + 2), F.lit(place), F.lit(shard).cast("long"), "b"), "b").collect()]
        extra = sum(times) - passes * n
        assert [times[b] for b in order] == [passes + 1] * extra + [passes] * (n - extra)


def test_mixed_texts(spark):
    rows = [(k, t, s, f"r{k}", 1) for k, t, s in mixture_rows(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, runs string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, words = out.collect(), Counter()
    texts = {}
    for k, t, *_ in rows:
        texts.setdefault(k, []).append(t or "")
    for r in got:
        words[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(" ".join(texts[r["doc_id"]]).split())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken


@pytest.mark.parametrize("seed", range(3))
def test_apportion(spark, seed):
    rng = random.Random(seed)
    votes = {k: float(rng.choice([1, 5, 7, 100, 1000, 12345]) * rng.randint(1, 9)) for k in range(rng.randint(1, 30))}
    total = rng.choice([0, 1, 10, 500])
    most = {k: rng.choice([0, 3, 10_000]) if seed == 2 else 10_000 for k in votes}
    df = spark.createDataFrame([(0, k, v, total, most[k]) for k, v in votes.items()], "g int, k int, v double, seats long, most long")
    found = {r["k"]: r["quota"] for r in mixing.apportion(df, ["g"], "k", "v", "seats", "most").collect()}
    if seed < 2:
        assert found == brute.seats(votes, total, most)
    assert all(0 <= found[k] <= most[k] for k in votes)


TURNS = "pair long, turn long, role string, text string"


def test_preference_pairs(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes 😀"), (1, 2, "user", None), (1, 3, "assistant", "end"), (2, 0, "user", "q"), (3, 0, None, "x"), (None, 0, "user", "z"), (4, None, "user", "b"), (4, 0, "user", "a")]
    rejected = [(1, 3, "assistant", "other"), (1, 0, "user", "hi"), (1, 2, "user", None), (1, 1, "assistant", "yes 😀"), (2, 0, "user", "q"), (2, 1, "assistant", "more"), (4, 0, "user", "a")]
    out = {r["pair"]: r for r in preference_format.format_pairs(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1]["n_common"] == 3 and out[1]["prompt"] == "<|user|>\nhi\n<|assistant|>\nyes 😀\n<|user|>\n\n" and out[1]["chosen"] == "<|assistant|>\nend\n" and out[1]["rejected"] == "<|assistant|>\nother\n"
    (mask,) = out[1]["chosen_mask"]
    assert out[1]["chosen"][mask["start"] : mask["end"]] == "end\n"
    assert out[2]["n_common"] == 1 and out[2]["chosen"] == "" and out[2]["chosen_mask"] == [] and out[2]["rejected"] == "<|assistant|>\nmore\n"
    assert out[3]["n_common"] == 0 and out[3]["chosen"] == "<|user|>\nx\n" and out[3]["rejected"] == ""
    assert out[4]["n_common"] == 1 and out[4]["chosen"] == "<|user|>\nb\n"


def test_pairs_of_table(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a1"), (2, 0, "user", "v"), (2, 1, "assistant", "a2"), (5, 0, "user", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair", F.lit("clash"))
    out = {r["pair"]: r for r in preference_format.format_pairs(*preference_format.pairs_of_table(table)).collect()}
    assert out[1]["chosen"] == "<|assistant|>\na1\n" and out[1]["rejected"] == "<|assistant|>\na2\n" and out[2]["rejected"] == "<|assistant|>\n\n" and out[5]["n_common"] == 1
    assert preference_format.format_pairs(*preference_format.pairs_of_table(table.limit(0))).count() == 0
