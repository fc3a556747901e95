"""The site tables as views over the star-schema tables. Each view is one SQL text that runs
unchanged in Spark and in any ANSI engine; {name} stands for an input table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "v_capture": """
SELECT page_id, url, html,
 CASE page_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'captured' END AS capture_state
FROM {pages}""",
    "v_candidate": """
SELECT doc_id AS id, lang AS collection, md5(lower(text)) AS key_text, text AS body,
 concat('/d/',CAST(doc_id AS VARCHAR(20)),CASE WHEN doc_id % 2 = 0 THEN '.html' ELSE '' END) AS path,
 concat('t-',CAST(length(text) % 3 AS VARCHAR(20))) AS seo
FROM {documents}""",
    "v_route": """
SELECT 'product' AS kind, 1 AS kind_rank, p_partkey AS id, concat('/p-',CAST(p_partkey % 150 AS VARCHAR(20)),'.html') AS legacy_path,
 concat('p-',CAST(p_partkey AS VARCHAR(20))) AS slug, CAST(NULL AS VARCHAR(20)) AS path, p_partkey % 11 <> 0 AS published FROM {part}
UNION ALL SELECT 'category', 2, CAST(100 + n_nationkey AS BIGINT), CASE WHEN n_nationkey % 3 = 0 THEN concat('/p-',CAST(n_nationkey AS VARCHAR(20)),'.html') END,
 concat('c-',CAST(n_nationkey AS VARCHAR(20))), CAST(NULL AS VARCHAR(20)), true FROM {nation}
UNION ALL SELECT 'page', 4, page_id, concat('/r-',CAST(page_id AS VARCHAR(20))), CAST(NULL AS VARCHAR(20)),
 concat('g-',CAST(page_id AS VARCHAR(20))), page_id % 4 = 0 FROM {pages}""",
    "v_redirect": """
SELECT c_custkey AS id, concat('/r-',CAST(c_custkey AS VARCHAR(20))) AS src,
 CASE WHEN c_custkey % 13 = 0 AND c_custkey > 0 THEN concat('/r-',CAST(c_custkey-1 AS VARCHAR(20)))
      WHEN c_custkey % 5 = 0 THEN concat('/p-',CAST(c_custkey AS VARCHAR(20)),'.html')
      ELSE concat('/r-',CAST(c_custkey+1 AS VARCHAR(20))) END AS dst FROM {customer}""",
    "v_category": """
SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM {nation}""",
    "v_product": """
SELECT p_partkey AS id, p_name AS name, p_brand AS manufacturer, concat(p_type,'-',CAST(p_partkey AS VARCHAR(20))) AS sku,
 CAST(round(p_retailprice*100) AS BIGINT) AS price_cents,
 CASE WHEN p_partkey % 4 = 0 THEN CAST(floor(p_retailprice*90) AS BIGINT) WHEN p_partkey % 9 = 0 THEN CAST(round(p_retailprice*100) AS BIGINT)+1 END AS sale_price_cents,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 5 AS BIGINT) END AS stock,
 100 + p_partkey % 25 AS category_id, p_partkey % 11 <> 0 AS published, p_partkey % 17 = 0 AS featured FROM {part}""",
    # one scan per possible position; a product has none, two or three variants
    "v_variant": "\nUNION ALL ".join(
        f"""SELECT p_partkey AS product_id, {n} AS pos, 'v{n}' AS variant_id, 'size {n}' AS label,
 CASE WHEN (p_partkey+{n}) % 5 = 0 THEN NULL ELSE (p_partkey+{n}) % 3 END AS stock,
 CAST({'round(p_retailprice*100)' if n == 1 else 'NULL'} AS BIGINT) + 500 AS price_cents
FROM {{part}} WHERE p_partkey % 3 > 0 AND {n} <= p_partkey % 3""" for n in range(3)
    ),
    "v_order_item": """
SELECT l_orderkey AS order_id, l_linenumber AS pos, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty FROM {lineitem}""",
    "v_schedule": """
SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'event' WHEN 'signup' THEN 'course' WHEN 'view' THEN 'trip'
  ELSE CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'course' ELSE 'trip' END END AS kind,
 user_id AS course_id, CASE WHEN event_type='view' AND event_id % 6 = 0 THEN NULL ELSE ts END AS starts_at,
 event_id % 8 AS capacity, event_id % 5 AS reserved FROM {events}""",
    "v_event": """
SELECT event_id, ts, user_id AS state_key, event_type AS command, CAST(round(value*100) AS BIGINT) AS amount_cents,
 concat(CAST(user_id AS VARCHAR(20)),':',CAST(event_id % 20 AS VARCHAR(20))) AS event_key,
 concat(event_type,'|',CAST(CAST(round(value*100) AS BIGINT) AS VARCHAR(20))) AS body FROM {events}""",
    "v_stored": """
SELECT c_custkey AS legacy_key, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS content,
 c_acctbal AS imported FROM {customer} WHERE c_custkey % 9 <> 0""",
    "v_incoming": """
SELECT c_custkey AS legacy_key, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS content
FROM {customer} WHERE c_custkey % 50 <> 0""",
    "v_media_target": """
SELECT l_orderkey AS entity_id, l_linenumber AS pos, concat('m-',CAST(l_partkey % 40 AS VARCHAR(20))) AS media_key FROM {lineitem}""",
}


def inputs_of(sql: str) -> list[str]:
    return [name for name in re.findall(r"\{(\w+)\}", sql) if name in TABLES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over the cluster, for work that costs far more time than a row has bytes: a table of small rows comes as one split."""
    return rows.repartition(F.col(key))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{item: table(spark, sf_dir, item) for item in set(inputs_of(sql))})


def with_views(*names: str) -> str:
    """'WITH ...' text that defines views for an engine where the tables are registered by name."""
    parts = [f"{name} AS ({VIEWS[name].format(**{item: item for item in TABLES})})" for name in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
