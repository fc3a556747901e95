"""Writers: bundles, migration outputs, sitemaps, upserts, run ledger and progress counters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from sitemill import constants as K


def write_bundle(entities: DataFrame, path: str) -> None:
    """JSON lines in (collection order, key) order; a range sort, no single task."""
    rank = F.array_position(F.array(*[F.lit(name) for name in K.COLLECTIONS]), F.col("collection"))
    entities.orderBy(rank, "key").write.mode("overwrite").json(path)


def write_migration(rows: DataFrame, rules: DataFrame, decisions: DataFrame, path: str) -> None:
    """Rows as JSON and quoted CSV, rules and open decisions as JSON."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    flat = rows.withColumn("issues", F.concat_ws(";", "issues"))
    flat.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(f"{path}/rows-csv")
    rules.orderBy("from_path").write.mode("overwrite").json(f"{path}/rules")
    decisions.write.mode("overwrite").json(f"{path}/decisions")


def write_sitemaps(entries: DataFrame, path: str, shard: int = K.SITEMAP_SHARD) -> None:
    """entries(url, entry) -> one XML file per at most 50,000 sorted addresses. Each sorted partition is
    cut into shards by itself; a shard is the largest piece ever held."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held += batch["entry"].tolist()
            while len(held) >= shard:
                yield pd.DataFrame({"value": [head + "\n".join(held[:shard]) + "\n</urlset>"]})
                held = held[shard:]
        if held:
            yield pd.DataFrame({"value": [head + "\n".join(held) + "\n</urlset>"]})

    entries.orderBy("url").select("entry").mapInPandas(cut, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def upsert_snapshot(current: DataFrame, incoming: DataFrame, key: str, provenance: dict[str, str]) -> DataFrame:
    """The next version of a table: incoming rows replace or extend current ones by key and carry their
    provenance (run, time, source hash). Write it beside the current version, then switch."""
    stamped = incoming.withColumns({name: F.lit(value) for name, value in provenance.items()})
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(stamped, allowMissingColumns=True)


def merge_into(incoming: DataFrame, table: str, key: str) -> None:
    """Row-level upsert for catalogs that support MERGE."""
    incoming.alias("s").mergeInto(table, F.expr(f"{table}.{key} = s.{key}")).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def append_run(runs: DataFrame, path: str) -> None:
    """Appends one attempt of a run to the ledger."""
    runs.write.mode("append").json(path)


def append_new(rows: DataFrame, stored: DataFrame | None, path: str, key: str) -> None:
    """Appends rows whose key is not stored yet, one per key."""
    fresh = rows.dropDuplicates([key])
    if stored is not None:
        fresh = fresh.join(stored.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def with_progress(df: DataFrame, name: str, failed: str | None = None, size: str | None = None) -> tuple[DataFrame, Observation]:
    """Counts rows, failures and bytes while the data is written; no extra pass."""
    counters = [F.count(F.lit(1)).alias("rows")]
    if failed:
        counters.append(F.count_if(F.col(failed).isNotNull()).alias("failed"))
    if size:
        counters.append(F.sum(size).alias("bytes"))
    observation = Observation(name)
    return df.observe(observation, *counters), observation


def quoted_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
