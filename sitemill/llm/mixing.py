"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Sizes are words. Targets: each source's weighted share of a total, at most REPEAT times its size, the excess
reshared by weight. Each source is dealt to shards by a seeded hash of the document; a shard's documents in
seeded order form one run of words, cut into blocks of equal length (about BLOCK_WORDS). The mix's blocks are
allotted to sources by highest quotients target / (2k + 1), each source's quota to its shards likewise, and
each shard takes all its blocks as often as its quota allows and the rest from the blocks that come first in
a seeded order. No block is taken more than REPEAT times, so no document either.

Null texts and texts without words have size 0 and take part in no block (taken 0). The null source is a source
of its own, after the others. Rows that repeat a doc_id are separate documents; ties in the seeded order go by
doc_id and size. A hot source has many shards, so no task holds more than a shard (SHARD_WORDS on average)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm import words
from sitemill.session import cut_lineage

WEIGHTS, TOTAL_SHARE, REPEAT = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 64, 500_000, 20_11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, place (from 1, by code point, null last), source_size, weight, target. One row a source."""
    sources = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("place", F.row_number().over(ordered))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights))
    sources = sources.withColumn("weight", weight).withColumn("most", (repeat * F.col("source_size")).cast("double"))
    # sources reach their bound in the order of bound / weight; the level that spends the total lies between two of them
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_share))
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total - full) / open_weight
    sources = sources.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    found = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(found * F.col("weight"), F.col("most")))
    return cut_lineage(sources.select("source", "place", "source_size", "weight", target.alias("target")))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, most: str) -> DataFrame:
    """parties with quota: seats of the group allotted by highest quotients votes / (2k + 1), none above most.

    With n parties, a party's seats differ from its exact share s by at most s n / (2 seats) + 1, so only the
    quotients between these bounds are ranked: about four rows a party, whatever the number of seats."""
    whole = Window.partitionBy(*group)
    share = F.col(votes) / F.sum(votes).over(whole)
    slack = share * F.count(F.lit(1)).over(whole) / 2 + 1
    out = parties.withColumn("_share", share * F.col(seats)).withColumn("_slack", slack)
    out = out.withColumn("_base", F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col("_share") - F.col("_slack")))))
    out = out.withColumn("_top", F.least(F.col(most), F.ceil(F.col("_share") + F.col("_slack"))))
    out = out.withColumn("_left", F.col(seats) - F.sum("_base").over(whole))
    bids = out.where("_top > _base").select(*group, key, votes, "_left", F.explode(F.sequence(F.col("_base"), F.col("_top") - 1)).alias("_k"))
    ranked = bids.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), "_k", key)))
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    out = out.join(won, [*group, key], "left").withColumn("quota", (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long"))
    return out.drop("_share", "_slack", "_base", "_top", "_left", "_won")


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: row, doc_id, size, source_size, target of every row of docs(doc_id, text, source).
    pieces: row, first, words, times: runs of words that the mix takes of a document, each times times."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("text", "doc_id").alias("mark"))
    sized = cut_lineage(sized)
    targets = source_targets(sized)
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", sized["source"], "size", "mark", "place", "source_size", "target")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), shards))
    run = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), "doc_id", "mark", "size")
    placed = placed.withColumn("end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("row", F.row_number().over(run))
    placed = cut_lineage(placed.withColumn("start", F.col("end") - F.col("size")))
    cells = placed.where("size > 0").groupBy("place", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long"))
    cells = cut_lineage(cells)
    held = cells.groupBy("place").agg((REPEAT * F.sum("blocks")).alias("most"))
    sources = targets.where("source_size > 0").join(held, "place").withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")).withColumn("all", F.lit(0))
    quotas = cut_lineage(apportion(sources, ["all"], "place", "target", "seats", "most").select("place", F.col("quota").alias("seats")))
    cells = apportion(cells.join(quotas, "place").withColumn("most", REPEAT * F.col("blocks")), ["place"], "shard", "blocks", "seats", "most")
    cells = cut_lineage(cells.select("place", "shard", "shard_size", "blocks", F.floor(F.col("quota") / F.col("blocks")).alias("passes"), (F.col("quota") % F.col("blocks")).alias("extra")))
    # seeded choice of a shard's blocks beyond whole passes: those up to the last one drawn, so blocks need not meet in a join
    turn = F.xxhash64(F.lit(seed + 2), "place", "shard", "block")
    dealt = cells.where("extra > 0").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "shard")
    dealt = dealt.select("place", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).withColumn("turn", turn)
    draw = Window.partitionBy("place", "shard").orderBy("turn", "block")
    last = dealt.withColumn("nth", F.row_number().over(draw)).where("nth = extra").select("place", "shard", F.struct("turn", "block").alias("last"))
    cells = cut_lineage(cells.join(last, ["place", "shard"], "left"))
    size, blocks = F.col("shard_size"), F.col("blocks")
    holding = lambda t: F.ceil((t + 1) * blocks / size) - 1  # noqa: E731  the block that holds word t
    spread = placed.where("size > 0").join(cells, ["place", "shard"])
    spread = spread.select("place", "shard", "row", "start", "end", "shard_size", "blocks", "passes", "last", F.explode(F.sequence(holding(F.col("start")), holding(F.col("end") - 1))).alias("block"))
    drawn = F.coalesce(F.struct(turn.alias("turn"), "block") <= F.col("last"), F.lit(False))
    spread = spread.withColumn("times", F.col("passes") + drawn.cast("long")).where("times > 0")
    low, high = F.floor(F.col("block") * size / blocks), F.floor((F.col("block") + 1) * size / blocks)
    spread = spread.withColumn("first", F.greatest("start", low) - F.col("start")).withColumn("words", F.least("end", high) - F.greatest("start", low)).where("words > 0")
    pieces = spread.select("place", "shard", "row", "first", "words", "times")
    return placed.select("place", "shard", "row", "doc_id", "source", "mark", "size", "source_size", "target"), pieces


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, text, source)."""
    rows, pieces = mix_blocks(docs, **settings)
    key = ["place", "shard", "row"]
    taken = pieces.groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each row's runs, as they stand in its text; runs that do not adjoin are parted by a line break."""
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = words.word_spans(data, np.array([0, len(data)]))
            joined: list[list[int]] = []
            for run in runs:
                if joined and joined[-1][1] == run["first"]:
                    joined[-1][1] += run["words"]
                else:
                    joined.append([run["first"], run["first"] + run["words"]])
            parts = [text if a == 0 and b == len(starts) else data[starts[a] : ends[b - 1]].tobytes().decode() for a, b in joined]
            texts.append("\n".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with docs' columns (text, and n_chars if there, made anew): one row for each pass over a
    document, its text the words taken in that pass. Words keep the white space between them."""
    rows, pieces = mix_blocks(docs.select("doc_id", "text", "source"), **settings)
    key = ["place", "shard", "row"]
    each = pieces.select(*key, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"), "first", "words")
    runs = each.groupBy(*key, "nth").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"))
    # rows alike in doc_id, text and source are told apart by a number
    alike = ["doc_id", "mark", "source"]
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*alike).orderBy(*key)))
    chosen = rows.join(runs, key).select(*alike, "copy", "runs")
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id"), F.xxhash64("text", "doc_id").alias("mark_"), F.col("source").cast("string").alias("source_"))
    packed = packed.withColumn("copy_", F.row_number().over(Window.partitionBy("id", "mark_", "source_").orderBy(F.xxhash64("rest"))))
    same = packed["id"].eqNullSafe(chosen["doc_id"]) & (packed["mark_"] == chosen["mark"]) & packed["source_"].eqNullSafe(chosen["source"])
    joined = packed.join(chosen, same & (packed["copy_"] == chosen["copy"]))
    joined = joined.select("rest", "text", "runs")
    cut = joined.mapInArrow(_cut, joined.select("rest", "text").schema)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*(made[c].alias(c) if c in made else F.col("rest").getField(c).alias(c) for c in docs.columns))
