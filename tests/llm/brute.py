"""Plain counterparts of the operators, slow and simple, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id); every pair with a common shingle is compared."""
    sets = {doc: shingles(text) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders, whole = defaultdict(list), {}
    for doc, found in sorted(sets.items()):
        if found:
            first = whole.setdefault(frozenset(found), doc)
            if first != doc:
                root[find(doc)] = find(first)
                continue
        for s in found:
            holders[s].append(doc)
    common = Counter()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                if 4 * len(sets[b]) <= 5 * len(sets[a]) and 4 * len(sets[a]) <= 5 * len(sets[b]):
                    common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for doc in sorted(sets):
        least.setdefault(find(doc), doc)
    return {doc: (len(sets[doc]), least[find(doc)]) for doc in sets}


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def targets(sizes: dict[str | None, int], weights=(3, 1, 2), share=1.5) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def seats(votes: dict, total: int, most: dict) -> dict:
    """Sainte-Lague, one seat at a time."""
    won = dict.fromkeys(votes, 0)
    for _ in range(total):
        free = [p for p in votes if won[p] < most[p]]
        if not free:
            break
        best = max(votes[p] / (2 * won[p] + 1) for p in free)
        won[min(p for p in free if votes[p] / (2 * won[p] + 1) == best)] += 1
    return won


def sentences(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    whole, begin = [], 0
    for k, m in enumerate(found):
        word, last = m[0], k + 1 == len(found)
        stop = word[-1] in ".!?" or (len(word) > 1 and word[-1] in "\"')]" and word[-2] in ".!?")
        if stop or last or "\n" in text[m.end() : found[k + 1].start()]:
            whole.append((begin, k + 1))
            begin = k + 1
    out = []
    for a, b in whole:
        begin = a
        for k in range(a, b):
            if k + 1 == b or (b - a > 12 and found[k][0][-1] in ",;:") or k + 1 - begin == 12:
                out.append((begin, k + 1))
                begin = k + 1
    return [m[0] for m in found], out


def chosen_places(words: list[str]) -> list[int]:
    """Words before which the words themselves divide a text: the hash of the pair around the place is the least of those up to two
    places away (of equal ones the first)."""
    from sitemill.llm import words as W

    data = " ".join(words).encode()
    array = np.frombuffer(data, np.uint8)
    starts, ends, _ = W.word_spans(array, np.array([0, len(data)]))
    each = W.word_hashes(array, starts, ends)
    value = {k: int(v) | 1 for k, v in enumerate(W.mix(W.mix(each[:-1]) + each[1:]), 1)} if len(each) > 1 else {}
    return [k for k, v in value.items() if all(value.get(k - d, v + 1) > v and value.get(k + d, v) >= v for d in (1, 2))]


def without_repeats(rows: list[tuple[int, str]]) -> dict[int, list[str]]:
    """The words that substring dedup leaves of each document."""
    places, words = defaultdict(list), {}
    for doc, text in rows:
        words[doc], found = sentences(text)
        spans = set()
        for i in range(len(found)):
            for j in range(i + 2, len(found)):
                if found[j][1] - found[i][0] >= 20:
                    spans.add((found[i][0], found[j][1]))
                    break
            for j in range(i - 2, -1, -1):
                if found[i][1] - found[j][0] >= 20:
                    spans.add((found[j][0], found[i][1]))
                    break
        chosen = chosen_places(words[doc])
        for i, a in enumerate(chosen):
            spans |= {(a, b) for b in [next((b for b in chosen[i:] if b - a >= 20), None)] if b is not None}
        for a, b in spans:
            places[tuple(map(lower, words[doc][a:b]))].append((doc, a, b))
    gone = defaultdict(set)
    for held in places.values():
        for doc, a, b in sorted(held)[1:]:
            gone[doc] |= set(range(a, b))
    return {doc: [w for k, w in enumerate(words[doc]) if k not in gone[doc]] for doc in words}


class Bigrams:
    """The interpolated modified Kneser-Ney model over dictionaries."""

    def __init__(self, texts: list[str | None]):
        self.words, pairs = Counter(), Counter()
        for text in texts:
            tokens = self.tokens(text)
            self.words.update(tokens)
            pairs.update(zip(["<s>", *tokens[:-1]], tokens, strict=True))
        self.pairs, self.total, self.follows = pairs, Counter(), Counter()
        self.kinds = defaultdict(lambda: [0, 0, 0])
        for (a, b), c in pairs.items():
            self.total[a] += c
            self.kinds[a][min(c, 3) - 1] += 1
            self.follows[b] += 1
        self.upper, self.lower = self.discounts(pairs.values()), self.discounts(self.follows.values())
        self.kept = sum(self.lower[min(c, 3)] for c in self.follows.values()) / len(pairs) if pairs else 1.0

    @staticmethod
    def tokens(text: str | None) -> list[str | None]:
        return [*WORD.findall(lower(text or "")), None]

    @staticmethod
    def discounts(counts) -> list[float]:
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0.0, *(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3))]

    def word(self, w) -> float:
        k = self.follows[w]
        return (k - self.lower[min(k, 3)]) / max(len(self.pairs), 1) + self.kept / (len(self.words) + 1)

    def probability(self, v, w) -> float:
        c, total = self.pairs[v, w], self.total[v]
        back = sum(self.upper[k + 1] * n for k, n in enumerate(self.kinds[v])) / total if total else 1.0
        return (c - self.upper[min(c, 3)]) / max(total, 1) + back * self.word(w)
