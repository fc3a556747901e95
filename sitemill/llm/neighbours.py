"""Approximate nearest neighbours by a forest of hash-prefix trees.

Every vector gets, for each of TREES trees, a string of BITS bits: the signs of its projections on that tree's random
directions. Vectors are dealt to shards of about SHARD rows by a hash of their id; a shard keeps each tree as a sorted array of
strings. A query descends in all trees at once to its longest matching prefixes (two binary searches a length)
and then ascends in all trees together, one bit a step, until the ranges of the current length hold CANDIDATES
of the shard's vectors and as many as are asked for, each counted once and the query's own vector not; all members of these
ranges are compared exactly. In a shard of up to WHOLE vectors all are. A query's nearest
of all shards are then merged, so the share of vectors compared, and with it the recall, does not fall as the
table grows.

Queries meet shards in blocks of QUERY_BLOCK rows by a join on (shard, block); no task holds more than a shard and a
block. Equal vectors are one member of a shard, with its smallest ids (as many as can be asked for), so a vector
that makes up a third of all rows neither fills ranges nor tasks.

Score: Euclidean distance in double precision on the original vectors; ties go to the smaller vec_id. Vectors that are
null, empty or zero, or hold null, NaN or infinite numbers, take no part, nor do rows with a null vec_id. Vectors are compared
with those of their own length only. Rows that repeat a vec_id and vector count once; one vec_id with two vectors counts with each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, SEED = 96, 48, 5
#: Vectors of a shard; share of them that a query's ranges hold before it stops to ascend; vectors of a shard in which all are compared.
SHARD, CANDIDATES, WHOLE = 16_384, 0.5, 1_024
QUERY_BLOCK = 20_000
K = 10


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The trees of one shard."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray):
        self.vectors = vectors
        keys = hash_strings(vectors, directions)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def members(self, strings: np.ndarray, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the places in the ranges of the longest length (or length 0) at which all trees together hold wanted
        vectors other than the query. strings: (trees, queries)."""
        trees, count = len(self.order), len(self.vectors)
        out = [np.arange(count)] * len(queries)
        if wanted >= count or count <= WHOLE:
            return out
        climbing = np.arange(len(queries))
        for length in range(BITS, 0, -1):
            rest = np.uint64((1 << (BITS - length)) - 1)
            begin, end = strings[:, climbing] & ~rest, strings[:, climbing] | rest
            a = np.stack([np.searchsorted(self.keys[t], begin[t]) for t in range(trees)])
            b = np.stack([np.searchsorted(self.keys[t], end[t], "right") for t in range(trees)])
            done = np.zeros(len(climbing), bool)
            for k in np.flatnonzero((b - a).sum(0) >= wanted):  # only then can so many different vectors be held
                mark = np.zeros(count, bool)
                for t in range(trees):
                    mark[self.order[t, a[t, k] : b[t, k]]] = True
                found = np.flatnonzero(mark)
                # vectors differ from each other, so one at most is the query
                own = len(found) == wanted and (self.vectors[found] == queries[climbing[k]]).all(1).any()
                if len(found) - own >= wanted:
                    out[climbing[k]], done[k] = found, True
            climbing = climbing[~done]
            if not len(climbing):
                break
        return out

    def search(self, queries: np.ndarray, strings: np.ndarray, wanted: int):
        """For each query the places of its candidates and their distances."""
        for start in range(0, len(queries), 256):
            part = slice(start, start + 256)
            for query, found in zip(queries[part], self.members(strings[:, part], queries[part], wanted), strict=True):
                difference = self.vectors[found] - query
                yield found, np.sqrt((difference * difference).sum(1))


def directions_of(size: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, trees * BITS))


def hash_strings(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(trees, vectors): each vector's string in each tree, its first bit the highest."""
    powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    out = []
    for start in range(0, len(vectors), 4096):
        signs = vectors[start : start + 4096] @ directions > 0
        out.append((signs.reshape(len(signs), -1, BITS) * powers).sum(2, dtype=np.uint64).T)
    return np.concatenate(out, 1)


def _search(k: int, trees: int, candidates: float):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(members) and len(queries):
            vectors = np.stack(members["vector"].to_numpy()).astype(np.float64)
            _, first, inverse = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
            ids = members["vec_id"].to_numpy(np.int64)
            order = np.lexsort((ids, inverse))
            at = np.searchsorted(inverse[order], np.arange(len(first) + 1))
            # the query itself may be among the smallest ids
            holders = [np.unique(ids[order[a:b]])[: k + 1] for a, b in zip(at[:-1], at[1:], strict=True)]
            directions = directions_of(vectors.shape[1], trees)
            forest = Forest(vectors[first], directions)
            asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            found = forest.search(asked, hash_strings(asked, directions), max(k, math.ceil(candidates * len(first))))
            for own, (places, distance) in zip(queries["query_id"], found, strict=True):
                if len(places) > 2 * k + 2:
                    bound = np.partition(distance, k)[k]  # k others at least lie within, one may be the query
                    near = distance <= bound
                    places, distance = places[near], distance[near]
                each = [(d, i) for p, d in zip(places, distance, strict=True) for i in holders[p] if i != own]
                rows.extend((own, i, d) for d, i in sorted(each)[:k])
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, candidates: float = CANDIDATES, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors(vec_id, vector) for each row of queries(query_id, vector)."""
    members = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", "vector", F.size("vector").alias("size"))
    asked = queries.where(usable(F.col("vector")) & F.col("query_id").isNotNull()).select("query_id", "vector", F.size("vector").alias("size"))
    counts = members.groupBy("size").count().collect()  # one row for each length of vector
    many = {row["size"]: max(1, math.ceil(row["count"] / shard)) for row in counts}
    blocks = max(1, math.ceil(asked.count() / block))
    if not many:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("size")]
    placed = members.select("vec_id", "vector", "size", F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = asked.select("query_id", "vector", "size", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), (shards - 1).cast("int"))).alias("shard"))
    key = ["size", "shard", "block"]
    found = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_search(k, trees, candidates), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(embeddings: DataFrame, **settings) -> DataFrame:
    """The stated queries: rows whose vec_id is divisible by 100, each against all other rows of embeddings(vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    return search(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), **settings)
