from __future__ import annotations

import random

import pytest

from sitemill.llm import jaccard_join as jj
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))


def changed(rng, words, share):
    return [word(rng) if rng.random() < share else w for w in words]


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Prose with exact and near copies in groups, short texts that differ in a word, and a passage many texts share."""
    rng = random.Random(seed)
    rows: list[str | None] = [None, "", " \t\n", "One", "one", "one two three four", "a b c d e", "A B C D E"]
    passage = [word(rng) for _ in range(30)]
    for _ in range(25):
        base = [word(rng) for _ in range(rng.choice([6, 9, 14, 18, 24, 60, 200]))]
        if rng.random() < 0.4:
            base = passage + base
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 6])):
            near = changed(rng, base, rng.choice([0, 0.005, 0.02, 0.03]))
            near = near[: len(near) - rng.choice([0, 0, 1, 3])] + [word(rng)] * rng.choice([0, 0, 1])
            rows.append("  ".join(near).upper() if rng.random() < 0.3 else "\n".join(near))
    long = [word(rng) for _ in range(20_000)]
    rows += [" ".join(long), " ".join(changed(rng, long, 0.01)), " ".join(passage), " ".join(passage[:-1])]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute.jaccard_components(rows)


def test_every_boundary_gives_the_same_links(spark, monkeypatch):
    rows = [r for r in corpus(3) if r[1] is None or len(r[1]) < 3000]
    want = brute.jaccard_components(rows)
    for boundary in (0, 9):
        monkeypatch.setattr(jj, "choose_boundary", lambda *_, b=boundary: b)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert found == want, boundary


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [word(rng) for _ in range(120)]
    rows = [(k, " ".join(changed(rng, base, 0.012))) for k in range(400)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute.jaccard_components(rows)


def test_repeated_ids_nulls_and_empty_tables(spark):
    text, other = " ".join("abcdefghijkl"), " ".join("mnopqrstuvwx")
    rows = [(7, text), (7, text), (7, other), (3, text), (9, other), (None, text), (5, None)]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == sorted([(7, 8, 3)] * 3 + [(3, 8, 3), (9, 8, 3), (None, 8, None), (5, 0, 5)], key=str)
    empty = jj.jaccard_components(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_boundary_by_cost():
    assert jj.choose_boundary({}, 5.0) == 0
    few, many = jj.choose_boundary({5: 10, 18: 1000}, 5.0), jj.choose_boundary({5: 10, 18: 1000}, 1e6)
    assert 5 <= few < 18 <= many
    assert jj.needed(5, 5) == 5 and jj.needed(9, 9) == 8 and jj.subset_sizes(9, 20) == [8, 9]
