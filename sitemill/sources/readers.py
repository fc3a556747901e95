"""Readers: captured pages, bundles, routing tables, crawl lists, issue reports and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill import constants as K, schemas as S
from sitemill.operators.files import skip_reason
from sitemill.operators.pages import content_digest


def _read(spark: SparkSession, path: str, schema: str, fmt: str, **options) -> DataFrame:
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_captures(spark: SparkSession, pages: str, manifest: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(verified pages, rejects(url, code)). A page must be in the manifest with its byte count and
    digest; a page that fails never stops the run."""
    listed = _read(spark, manifest, S.CAPTURE_MANIFEST, fmt).select("url", "final_url", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"), F.col("charset").alias("m_charset"))
    rows = _read(spark, pages, "url string, html string", fmt).join(listed, "url", "full")
    rows = rows.withColumn("charset", F.coalesce("m_charset", F.lit("utf-8"))).withColumn("sha256", content_digest(F.col("html"), F.col("charset")))
    wide = F.lower("charset").isin("iso-8859-1", "latin-1", "us-ascii", "ascii")
    size = F.when(wide, F.length("html")).otherwise(F.octet_length(F.encode("html", "utf-8")))
    code = (
        F.when(F.col("html").isNull(), F.lit("capture-missing"))
        .when(F.col("m_sha").isNull(), F.lit("capture-not-listed"))
        .when(F.col("sha256").isNull(), F.lit("capture-undecodable"))
        .when((F.col("sha256") != F.col("m_sha")) | (size != F.col("m_bytes")), F.lit("capture-integrity"))
    )
    judged = rows.withColumn("code", code)
    return judged.where("code is null").select("url", "final_url", "html", "sha256", "charset"), judged.where("code is not null").select("url", "code")


def read_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of a bundle folder (source, entities, media as JSON lines) and the envelope issues."""
    source = _read(spark, f"{folder}/source", S.SOURCE, "json")
    parsed = F.from_json("value", S.ENTITY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    entities = spark.read.text(f"{folder}/entities").select(parsed.alias("e")).select("e.*")
    media = _read(spark, f"{folder}/media", S.MEDIA, "json")
    envelope = F.array_compact(F.array(
        F.when(~F.col("version").eqNullSafe(F.lit(1)), F.lit("version")),
        F.when(~F.coalesce(F.col("kind").isin("joomla-dump", "public-pages", "demo"), F.lit(False)), F.lit("source-kind")),
        F.when(~F.coalesce(F.col("manifestHash").rlike(r"\A[a-f0-9]{64}\z"), F.lit(False)), F.lit("manifest-hash")),
        F.when(F.col("capturedAt").try_cast("timestamp").isNull(), F.lit("captured-at")),
        F.when(F.col("complete").isNull(), F.lit("complete")),
    ))
    issues = source.select(F.explode(envelope).alias("code"))
    unknown = entities.where(F.col("_corrupt").isNotNull() | ~F.coalesce(F.col("collection").isin(*K.COLLECTIONS), F.lit(False)))
    issues = issues.unionByName(unknown.select(F.when(F.col("_corrupt").isNotNull(), F.lit("entity-unreadable")).otherwise(F.lit("unsupported-collection")).alias("code")))
    return {"source": source, "entities": entities.where("_corrupt is null").drop("_corrupt"), "media": media}, issues


def routing_projection(raw: DataFrame, columns: Sequence[str] = S.ROUTE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). Only listed columns may come in; ids are positive and unique per kind; 0 and 1
    become booleans."""
    extra = [name for name in raw.columns if name not in columns and name != "kind"]
    if extra:
        raise ValueError(f"only routing columns allowed, got {extra}")
    keys = [name for name in ("kind", "id") if name in raw.columns]
    repeated = raw.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = raw.withColumn("published", F.coalesce(F.col("published").cast("boolean"), F.lit(False)))
    bad = F.coalesce(F.col("id") <= 0, F.lit(True))
    clean = rows.where(~bad).join(repeated, keys, "left_anti")
    rejects = rows.where(bad).select(*keys).unionByName(repeated.where("id > 0").select(*keys))
    return clean, rejects


def read_routing_projection(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    return routing_projection(_read(spark, path, S.ROUTE, fmt))


def crawl_addresses(captured: DataFrame, failed: DataFrame, pending: DataFrame, excluded: DataFrame) -> DataFrame:
    """One list (url, final_url, capture_state) of the four lists of a crawl."""
    none = F.lit(None).cast("string")
    tag = lambda df, state: df.select("url", (F.col("final_url") if "final_url" in df.columns else none).alias("final_url"), F.lit(state).alias("capture_state"))
    return tag(captured, "captured").unionByName(tag(failed, "failed")).unionByName(tag(pending, "pending")).unionByName(tag(excluded, "excluded"))


def with_document_addresses(crawl: DataFrame, documents: DataFrame, origin: str) -> DataFrame:
    """Adds document addresses that the crawl does not list."""
    urls = documents.select(F.concat(F.lit(origin.rstrip("/")), "legacy_path").alias("url")).distinct()
    fresh = urls.join(crawl.select("url"), "url", "left_anti")
    return crawl.unionByName(fresh.select("url", F.lit(None).cast("string").alias("final_url"), F.lit("document").alias("capture_state")))


def conversion_issues(report: DataFrame, host_pattern: str) -> DataFrame:
    """report(code, url, detail) -> (url, code) of own pages; a content conflict names several."""
    several = F.when(F.col("url").isNotNull(), F.array("url")).when(F.col("code") == "conflicting-source-content", F.split("detail", r" \| "))
    rows = report.where("code is not null").select("code", F.explode(several).alias("url"))
    return rows.where(F.col("url").rlike(rf"\Ahttps://{host_pattern}/")).select("url", "code")


def read_file_inventory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Recursive listing (path, size, modified, skip_reason); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).withColumn("skip_reason", skip_reason(F.col("path")))


def read_file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256); the bytes are hashed where they are read and never shuffled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def scan_all(df: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, truncated flag): a plain scan, or its first cap rows in key order with a flag."""
    if cap is None:
        return df, df.sparkSession.range(1).select(F.lit(False).alias("truncated"))
    flag = df.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
    return df.orderBy(df.columns[0]).limit(cap), flag
