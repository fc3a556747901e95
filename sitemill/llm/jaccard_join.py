"""Exact n-gram Jaccard self-join over whole texts, as components of linked documents.

Size-aware heavy-light join. Two sets of n and m shingles with |A & B| >= 0.8 |A | B| share at least
c(n, m) = ceil(4 (n + m) / 9) shingles.

1. Copies: rows whose shingle sets are equal become one set.
2. Repeated shingles: a set with a partner shares at least 0.8 n of its shingles with other sets. Each task
   sends every distinct shingle of a pack of documents once, as 4 bytes beside its bucket, and buckets answer
   how many shingles of a set are repeated. Truncated hashes can only let more sets through.
3. Light sets (n <= boundary): every subset of exactly c(n, m) of the repeated shingles is enumerated. Two
   sets with a common subset of c shingles are linked if 9 c >= 4 (n + m), so each subset's holders are tied
   to its smallest holder, without pairs.
4. Heavy sets: inverted lists of the rarest shingles (no more than a linked pair can leave unshared) are
   scanned. All holders on a list are compared with its leader; where a list still holds several components,
   the remaining pairs across components are compared, except those that sizes or positions rule out.
5. The boundary is the size at which enumerating costs as much as scanning, from counts of all sets.

Nulls and empty texts give an empty set, linked with nothing. Rows with one doc_id are one node: any of
their texts may link it. A null doc_id takes part in no link and gets a null component."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm import words
from sitemill.llm.cluster import components
from sitemill.session import cut_lineage

SHINGLE = 5
#: Shingles that a bucket of step 2 holds on average, 4 bytes each.
PER_BUCKET = 3_000_000
#: Bytes of text in a pack of step 2.
PACK_BYTES = 8 << 20
#: Sizes that may be light; above it the subsets of a set outnumber any list.
LARGEST_LIGHT = 20


def set_id(found: np.ndarray) -> int:
    """A 64-bit name of a set of shingles, for any order of its members."""
    total = np.array([found.sum(dtype=np.uint64), words.mix(found ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], np.uint64)
    return words.sequence_hash(words.mix(total + np.uint64(len(found))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _describe(size: int, with_set: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, sets = [], [], []
            for found in words.shingle_sets(batch.column("text"), size):
                counts.append(len(found))
                names.append(_signed(set_id(found)))
                if with_set:
                    sets.append(found.view(np.int64))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.int64())]
            fields = ["doc_id", "n_shingles", "sid"]
            if with_set:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))))
                fields.append("shingles")
            yield pa.RecordBatch.from_arrays(columns, fields)

    return run


def describe(docs: DataFrame, size: int = SHINGLE, with_set: bool = False) -> DataFrame:
    """doc_id, n_shingles, sid (name of the set) and, if asked, the shingles of each row."""
    schema = "doc_id long, n_shingles long, sid long" + ", shingles array<long>" * with_set
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_describe(size, with_set), schema)


def _ship(size: int, buckets: int):
    """Rows of a bucket: the sets that send it shingles seen once in the pack, how many each, those shingles as
    4 bytes; the shingles seen more often; and sets with how many of the latter they hold."""
    fields = ["bucket", "sids", "counts", "once", "often", "held_by", "held"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def send(pack: dict[int, np.ndarray]) -> pa.RecordBatch:
        names = np.fromiter(pack, np.int64, len(pack))
        sizes = np.fromiter(map(len, pack.values()), np.int64, len(pack))
        shingles, owner = np.concatenate(list(pack.values())), np.repeat(np.arange(len(pack)), sizes)
        order, found, at = words.by_bucket(shingles, buckets)
        shingles, owner = shingles[order], owner[order]
        rows = [[], [], [], [], [], [], []]
        local = np.zeros(len(pack), np.int32)
        for bucket, a, b in zip(found, at[:-1], at[1:], strict=True):
            short, holders = shingles[a:b].astype(np.uint32), owner[a:b]
            values, inverse, count = np.unique(short, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            np.add.at(local, holders[again], 1)
            who, many = np.unique(holders[~again], return_counts=True)  # owners come in order, as the sort was stable
            for row, value in zip(rows, (int(bucket), names[who].tobytes(), many.astype(np.int32).tobytes(), short[~again].tobytes(), values[count > 1].tobytes(), b"", b""), strict=True):
                row.append(value)
        some = local > 0
        if rows[0] and some.any():
            spot = int(names[0]) % len(rows[0])
            rows[5][spot], rows[6][spot] = names[some].tobytes(), local[some].tobytes()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for found in words.shingle_sets(batch.column("text"), size):
                if len(found):
                    pack[_signed(set_id(found))] = found
                    held += len(found) * 8
                if held > PACK_BYTES:
                    yield send(pack)
                    pack, held = {}, 0
        if pack:
            yield send(pack)

    return run


def _joined(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind)] + [np.frombuffer(x, kind) for x in group.column(name).to_pylist()])


def _answer(parts: int):
    """How many shingles of each set in a bucket occur elsewhere too, as one row for each part of the sets."""
    def run(group: pa.Table) -> pa.Table:
        sids, counts, once, often = _joined(group, "sids", np.int64), _joined(group, "counts", np.int32), _joined(group, "once", np.uint32), _joined(group, "often", np.uint32)
        owner = np.repeat(np.arange(len(sids)), counts)
        # a set that came in several packs, as copies do, counts once
        names, who = np.unique(sids, return_inverse=True)
        order = np.lexsort((who[owner], once))
        shingle, holder = once[order], who[owner][order]
        new = np.ones(len(order), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (holder[1:] != holder[:-1])
        shingle, holder = shingle[new], holder[new]
        _, inverse, count = np.unique(np.concatenate([shingle, often, often]), return_inverse=True, return_counts=True)
        many = np.bincount(holder, weights=count[inverse[: len(shingle)]] > 1, minlength=len(names)).astype(np.int32)
        sids = np.concatenate([names[many > 0], _joined(group, "held_by", np.int64)])
        many = np.concatenate([many[many > 0], _joined(group, "held", np.int32)])
        order, found, at = words.by_bucket(sids.view(np.uint64), parts)
        cut = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"part": pa.array(found, pa.int64()), "sids": pa.array([sids[c].tobytes() for c in cut], pa.binary()), "many": pa.array([many[c].tobytes() for c in cut], pa.binary())})

    return run


def _total(group: pa.Table) -> pa.Table:
    """The sums of a part's sets over all buckets."""
    names, who = np.unique(_joined(group, "sids", np.int64), return_inverse=True)
    return pa.table({"sid": pa.array(names, pa.int64()), "repeated": pa.array(np.bincount(who, _joined(group, "many", np.int32), len(names)).astype(np.int64))})


def repeated_counts(docs: DataFrame, total: int, size: int = SHINGLE) -> DataFrame:
    """sid and repeated: at least the number of the set's shingles that other sets have too."""
    buckets = max(1, math.ceil(total / PER_BUCKET))
    sent = docs.select(F.col("text").cast("string")).mapInArrow(_ship(size, buckets), "bucket long, sids binary, counts binary, once binary, often binary, held_by binary, held binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(buckets), "part long, sids binary, many binary")
    return answers.groupBy("part").applyInArrow(_total, "sid long, repeated long")


def needed(n: int, m: int) -> int:
    """Shingles that sets of n and m share at least if they are linked."""
    return -(-4 * (n + m) // 9)


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The fixed sizes of the subsets that a light set of n shingles gives: one for each partner size."""
    return sorted({needed(n, m) for m in range(-(-4 * n // 5), min(boundary, 5 * n // 4) + 1)})


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest light size, by least total cost. sizes: sets of each size; list_length: mean holders of a shingle.

    Light: one row for each subset. Heavy: one row for each shingle of the prefix, compared with its list."""
    def light(n: int, x: int) -> float:
        return sum(math.comb(n, c) for c in subset_sizes(n, x) if c <= n)

    def heavy(n: int) -> float:
        return (n - needed(n, -(-4 * n // 5)) + 1) * (1 + list_length)

    costs = {x: sum(count * (light(n, x) if n <= x else heavy(n)) for n, count in sizes.items()) for x in range(LARGEST_LIGHT + 1)}
    return min(costs, key=lambda x: (costs[x], x))


def _subsets(boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for sid, n, items in zip(*(batch.column(x).to_pylist() for x in ("sid", "n", "shingles")), strict=True):
                members = np.sort(np.array(items, np.int64).view(np.uint64))
                for c in subset_sizes(n, boundary):
                    for chosen in combinations(range(len(members)), c):
                        out.append((c, _signed(words.sequence_hash(words.mix(members[list(chosen)])) if c else 0), sid, n))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["c", "key", "sid", "n"])

    return run


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links among sets of at most boundary shingles, each to the smallest holder of a common subset."""
    keys = sets.where(F.col("n") <= boundary).select("sid", "n", F.col("items").alias("shingles")).mapInArrow(_subsets(boundary), "c long, key long, sid long, n long")
    leaders = keys.groupBy("c", "key").agg(F.min(F.struct("n", "sid")).alias("lead"), F.count(F.lit(1)).alias("holders")).where("holders > 1").drop("holders")
    return keys.join(leaders, ["c", "key"]).where("sid <> lead.sid AND 9 * c >= 4 * (n + lead.n)").select(F.col("lead.sid").alias("a"), F.col("sid").alias("b")).distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are linked, by their whole sets."""
    side = sets.select("sid", "n", F.col("items").alias("s"))
    both = pairs.join(side.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a").join(side.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def reduced_sets(docs: DataFrame, described: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sets that can have a partner: sid, n, items (shingles that other such sets hold too,
    rarest first) and mean, the mean number of holders of these."""
    sets = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    some = repeated_counts(docs, total, size).join(sets, "sid").where("5 * repeated >= 4 * n").select("sid", "doc_id")
    some = cut_lineage(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    full = describe(texts, size, with_set=True).join(some.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])
    full = cut_lineage(full.select("sid", F.col("n_shingles").alias("n"), "shingles"))
    held = full.select("sid", "n", F.explode("shingles").alias("h"))
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    items = held.join(often, "h").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("items"))
    items = items.where("5 * size(items) >= 4 * n")
    mean = F.aggregate("items", F.lit(0.0), lambda total, x: total + x["df"]) / F.size("items")
    return cut_lineage(items.select("sid", "n", mean.alias("mean"), F.transform("items", lambda x: x["h"]).alias("items")))


def possible(x: str, y: str) -> Column:
    """Whether two entries of a list, numbered x and y, may be linked if the list is their first in common: the smaller
    has it among the shingles it may lack in common with a set not smaller, the larger is at most 1.25 times as
    large, and what follows the list's shingle in both is enough."""
    small_first = F.struct(f"n{x}", f"sid{x}") < F.struct(f"n{y}", f"sid{y}")
    n1, n2 = F.least(f"n{x}", f"n{y}"), F.greatest(f"n{x}", f"n{y}")
    rest = F.least(F.col(f"r{x}") - F.col(f"pos{x}"), F.col(f"r{y}") - F.col(f"pos{y}"))
    return F.when(small_first, F.col(f"in_short{x}")).otherwise(F.col(f"in_short{y}")) & (4 * n2 <= 5 * n1) & (9 * rest >= 4 * (n1 + n2)) & (F.col(f"sid{x}") != F.col(f"sid{y}"))


def heavy_links(sets: DataFrame, boundary: int, known: DataFrame) -> DataFrame:
    """Links of pairs with a set above the boundary, enough of them to join all that belong together.

    known: links found so far. A list holds a set's rarest shingles: those it may lack in common with a linked
    set of 0.8 to 1.25 times its size; in_short marks those it may lack with one not smaller than itself. A first
    round ties lists to a leader, the member with the fewest rarer shingles (the middle of a group of near copies);
    the second compares what is still apart, on lists that hold several components."""
    n, r = F.col("n"), F.size("items")
    unshared = n - r  # the set's own shingles come first in the order of rareness
    entries = sets.where(5 * n > 4 * F.lit(boundary)).select(
        "sid", "n", r.alias("r"), (n - F.ceil(8 * n / 9) + 1 - unshared).alias("short"),
        F.posexplode(F.slice("items", F.lit(1), F.greatest(F.lit(0), (n - F.ceil(4 * n / 5) + 1 - unshared).cast("int")))).alias("pos", "h"),
    )
    entries = entries.withColumns({"in_short": F.col("pos") < F.col("short"), "rarer": F.col("n") - F.col("r") + F.col("pos")}).drop("short")
    lists = entries.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("h")
    entries = cut_lineage(entries.join(lists, "h", "left_semi"))
    fields = ["sid", "n", "r", "pos", "in_short", "root"]
    leads = entries.groupBy("h").agg(F.min(F.struct("rarer", *fields[:-1])).alias("lead"))
    numbered = entries.select("h", *(F.col(x).alias(f"{x}1") for x in fields[:-1])).join(leads.select("h", *(F.col("lead")[x].alias(f"{x}2") for x in fields[:-1])), "h")
    pairs = numbered.where(possible("1", "2")).select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")).distinct()
    links = cut_lineage(known.unionByName(compared(pairs, sets)))
    placed = placed_entries(entries, links)
    left, right = (placed.select("h", *(F.col(x).alias(f"{x}{k}") for x in fields)) for k in "12")
    rest = left.join(right, "h").where((F.col("sid1") < F.col("sid2")) & (F.col("root1") != F.col("root2")) & possible("1", "2")).select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).distinct()
    return links.unionByName(compared(rest, sets))


def placed_entries(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The entries of lists that still hold several components, with each set's component (root)."""
    roots = components(links)
    placed = entries.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("h")
    return cut_lineage(placed.join(mixed, "h", "left_semi"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs(doc_id, text)."""
    described = cut_lineage(describe(docs, size))
    sets = reduced_sets(docs, described, size)
    sizes = {row["n"]: row["count"] for row in sets.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    mean = sets.agg(F.avg("mean")).first()[0] or 0.0
    boundary = choose_boundary(sizes, mean)
    known = light_links(sets, boundary)
    # rows that repeat a doc_id with another text are one node
    nodes = described.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "sid")
    spelled = nodes.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("top")).where("a <> top")
    same = nodes.join(spelled, "doc_id").where("sid <> a").select("a", F.col("sid").alias("b"))
    roots = components(heavy_links(sets, boundary, known.unionByName(same)))
    named = described.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    whole = named.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(whole, "root", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"))
