"""The domain tables as projections of the given tables.

Every block is plain SQL that Spark and DuckDB both run, so a query and its SQL
check read the same rows. Blocks may build on earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from auctionlens.sources.catalog import Catalog

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")

_WIDTH = (
    "CAST(CASE {c} % 7 WHEN 0 THEN 300 WHEN 1 THEN 728 WHEN 2 THEN 300 WHEN 3 THEN 54 "
    "WHEN 4 THEN 266 WHEN 5 THEN 60 ELSE 0 END AS INT)"
)
_HEIGHT = (
    "CAST(CASE {c} % 7 WHEN 0 THEN 250 WHEN 1 THEN 90 WHEN 2 THEN 600 WHEN 3 THEN 132 "
    "WHEN 4 THEN 127 WHEN 5 THEN 120 ELSE 0 END AS INT)"
)
_CLOCK = "lpad(CAST({c} % 24 AS STRING), 2, '0')"
_RESPONSE_HOUR = (
    "CASE WHEN hr >= 24 THEN '2024-01-02 ' ELSE '2024-01-01 ' END || " + _CLOCK.format(c="hr")
)

PROJECTIONS: dict[str, str] = {
    "imps": f"""
SELECT l_orderkey AS auction_id_64, '2024-01-01 ' || {_CLOCK.format(c='l_orderkey')} AS dh,
  CAST(l_partkey % 6 AS STRING) AS operating_system, CAST(l_linenumber % 4 AS INT) AS supply_type,
  CAST(l_suppkey % 2 AS INT) AS device_type, CAST(l_partkey % 5 AS INT) AS device_id,
  {_WIDTH.format(c='l_partkey')} AS width, {_HEIGHT.format(c='l_partkey')} AS height,
  CAST(l_quantity AS INT) % 6 AS content_category_id,
  'site' || CAST(l_suppkey % 20 AS STRING) || '.example' AS site_domain,
  'app' || CAST(l_partkey % 10 AS STRING) AS application_id,
  'NATION_' || CAST(l_suppkey % 25 AS STRING) AS geo_country,
  CAST(l_suppkey AS INT) AS seller_member_id, CAST(l_partkey % 100 AS INT) AS buyer_member_id,
  l_partkey AS creative_id
FROM lineitem""",
    "bids": f"""
SELECT o_orderkey AS auction_id_64, '2024-01-01 ' || {_CLOCK.format(c='o_orderkey')} AS dh,
  CAST(o_orderkey % 5 AS INT) AS payment_type, CAST(o_custkey % 50 AS INT) AS campaign_id
FROM orders
UNION ALL
SELECT o_orderkey, '2024-01-01 ' || {_CLOCK.format(c='o_orderkey')}, 3, CAST(o_custkey % 50 AS INT)
FROM orders WHERE o_orderkey % 10 = 0""",
    "responses": """
SELECT event_id % 5000 AS auction_id_64, event_type,
  (event_id % 5000) % 24 + CASE WHEN event_id % 7 < 4 THEN 0 WHEN event_id % 7 < 6 THEN 1 ELSE 2 END AS hr
FROM events WHERE event_type IN ('click', 'purchase')""",
    "clicks": f"SELECT auction_id_64, {_RESPONSE_HOUR} AS dh FROM responses WHERE event_type = 'click'",
    "conversions": f"""
SELECT auction_id_64, {_RESPONSE_HOUR} AS dh, CAST(auction_id_64 % 2 AS INT) AS post_click_conv
FROM responses WHERE event_type = 'purchase'""",
    "pixel_fires": f"""
SELECT r.auction_id_64, 100 + r.auction_id_64 % 40 AS pixel_id, CAST(o.o_custkey % 50 AS INT) AS campaign_id,
  {_RESPONSE_HOUR} AS dh
FROM responses r JOIN orders o ON o.o_orderkey = r.auction_id_64 WHERE r.event_type = 'purchase'""",
    "aggregated_hours": "SELECT dh FROM imps WHERE dh < '2024-01-01 06'",
    "perf_fact": f"""
SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS ymd,
  CAST(CAST(l_shipdate AS DATE) AS STRING) || ' ' || {_CLOCK.format(c='l_orderkey')} AS ymdh,
  CAST(l_suppkey % 25 AS INT) AS seller_member_id, CAST(l_suppkey AS INT) AS site_id,
  'NATION_' || CAST(l_partkey % 25 AS STRING) AS geo_country,
  {_WIDTH.format(c='l_partkey')} AS width, {_HEIGHT.format(c='l_partkey')} AS height,
  CAST(l_orderkey % 40 AS INT) AS campaign_group_id, CAST(l_orderkey % 200 AS INT) AS campaign_id,
  CAST(l_linenumber AS INT) AS tag_id, l_partkey AS creative_id,
  CAST(1 + l_orderkey % 11 AS INT) AS imp_type, CAST(l_partkey % 8 - 1 AS INT) AS revenue_type,
  CAST(l_suppkey % 3 AS INT) AS payment_type,
  CAST((l_partkey + l_suppkey) % 12 - 2 AS INT) AS predict_type_rev,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 100 + l_orderkey % 40 END AS INT) AS pixel_id,
  CAST(l_quantity AS BIGINT) AS imps, CAST(floor(l_quantity * l_discount) AS BIGINT) AS clicks,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS post_click_convs,
  CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS BIGINT) AS post_view_convs,
  CAST(l_extendedprice AS DECIMAL(18,4)) AS booked_revenue_dollars,
  CAST(l_extendedprice AS DECIMAL(18,4)) AS booked_revenue_adv_curr,
  CAST(l_tax * 100 AS DECIMAL(18,4)) AS reseller_revenue
FROM lineitem""",
    "site": """
SELECT CAST(s_suppkey AS INT) AS id, s_nationkey AS member_id, CAST(s_suppkey % 10 AS INT) AS publisher_id,
  CAST(s_suppkey % 12 AS INT) AS managed_bucket_id,
  CASE WHEN s_suppkey % 13 = 12 THEN 1 ELSE 0 END AS deleted,
  CASE WHEN s_suppkey % 11 = 10 THEN 'inactive' ELSE 'active' END AS state
FROM supplier""",
    "marketplace": """
SELECT CAST(s_suppkey AS INT) AS site_id,
  '2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') AS created_on,
  '2024-02-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') || ' 10:00:00' AS last_modified,
  CASE WHEN s_suppkey % 17 = 16 THEN 1 ELSE 0 END AS deleted,
  CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE 1 END AS performance
FROM supplier""",
    "programme": "SELECT site_id FROM marketplace WHERE deleted = 0 AND performance = 1",
    "country": """
SELECT n_nationkey AS id, n_name AS name, n_name AS code, n_regionkey AS country_group_id,
  CASE WHEN n_nationkey = 24 THEN 1 ELSE 0 END AS deleted
FROM nation""",
    "creative_sizes": f"""
SELECT CAST(CASE width WHEN 728 THEN 1 WHEN 300 THEN CASE height WHEN 250 THEN 2 ELSE 3 END
    WHEN 54 THEN 4 WHEN 266 THEN 5 ELSE 6 END AS INT) AS id,
  width, height, CASE WHEN width = 728 THEN 1 ELSE 0 END AS deleted, 1 AS active
FROM (SELECT DISTINCT {_WIDTH.format(c='p_partkey')} AS width, {_HEIGHT.format(c='p_partkey')} AS height FROM part) t
WHERE width > 0""",
    "campaign": """
SELECT CAST(c_custkey AS INT) AS id, CAST(c_custkey % 40 AS INT) AS campaign_group_id,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 90 END AS INT) AS profile_id,
  CASE WHEN c_custkey % 9 = 8 THEN 1 ELSE 0 END AS deleted,
  CASE WHEN c_custkey % 6 = 5 THEN 'inactive' ELSE 'active' END AS state
FROM customer""",
    "campaign_group": """
SELECT id, 100 + id % 30 AS profile_id, member_id,
  CASE id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE id % 3 WHEN 0 THEN 'ctr' WHEN 1 THEN 'cpc' ELSE 'cpa' END AS goal_type,
  id % 8 - 1 AS revenue_type, CASE WHEN id % 19 = 18 THEN 1 ELSE 0 END AS deleted, 'active' AS state
FROM (SELECT CAST(c_custkey % 40 AS INT) AS id, min(c_nationkey) AS member_id
      FROM customer GROUP BY CAST(c_custkey % 40 AS INT)) g""",
    "currency": """
SELECT * FROM (VALUES ('USD', 1.0), ('EUR', 0.8), ('GBP', 0.5)) AS t(code, conversion_rate)""",
    "goal": """
SELECT id AS campaign_group_id, 100 + id % 40 AS pixel_id,
  CASE WHEN id % 2 = 0 THEN 5.0 ELSE NULL END AS post_view_goal_target,
  CASE WHEN id % 5 <> 0 THEN 8.0 ELSE NULL END AS post_click_goal_target,
  CASE WHEN id % 2 = 0 THEN 50000.0 ELSE NULL END AS post_view_goal_threshold,
  CASE WHEN id % 5 <> 0 THEN 80000.0 ELSE NULL END AS post_click_goal_threshold,
  0 AS deleted, 'active' AS state
FROM campaign_group""",
    "valuation": """
SELECT id AS campaign_group_id, CASE WHEN id % 7 = 6 THEN NULL ELSE 0.04 END AS goal_threshold,
  CASE WHEN id % 11 = 10 THEN 1 ELSE 0 END AS deleted
FROM campaign_group""",
    "pixel": """
SELECT CAST(100 + c_custkey AS INT) AS id,
  CASE c_custkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'view' ELSE 'click' END AS trigger_type,
  CASE WHEN c_custkey % 23 = 22 THEN 1 ELSE 0 END AS deleted, 'active' AS state
FROM customer""",
    "group_pixel": """
SELECT CAST(100 + c_custkey AS INT) AS pixel_id, CAST(c_custkey % 40 AS INT) AS campaign_group_id,
  CAST(c_custkey % 7 AS DOUBLE) AS post_view_revenue,
  CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) END AS post_click_revenue,
  CASE WHEN c_custkey % 29 = 28 THEN 1 ELSE 0 END AS deleted, 'active' AS state
FROM customer""",
    "categorizer": """
SELECT CAST(o_custkey AS INT) AS campaign_id, CAST(100 + o_custkey % 40 AS INT) AS pixel_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'advertiser_goal' WHEN 1 THEN 'rtb_cpm_payout' ELSE 'rtb_event_payout' END AS type,
  CASE o_orderkey % 4 WHEN 0 THEN 'pc_cpa' WHEN 1 THEN 'pv_cpa' WHEN 2 THEN 'pc_cpa' ELSE 'cpm' END AS value_type,
  CAST(o_orderkey % 17 AS DOUBLE) AS value
FROM orders""",
    "quick_stats": """
SELECT campaign_id AS object_id, '7day' AS time_interval, 'campaign' AS report_type,
  CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks,
  CAST(sum(post_view_convs) AS BIGINT) AS post_view_convs,
  CAST(sum(post_click_convs) AS BIGINT) AS post_click_convs,
  CAST(sum(booked_revenue_dollars) AS DOUBLE) AS booked_revenue
FROM perf_fact GROUP BY campaign_id""",
    "bid_model": """
SELECT CAST(c_custkey AS INT) AS bid_model_id, CAST(c_custkey AS INT) AS campaign_id,
  CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END AS deleted
FROM customer""",
    "profile_target_age": """
SELECT CAST(o_custkey % 45 AS INT) AS profile_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS deleted
FROM orders""",
    "profile_target_segment": """
SELECT CAST(100 + o_custkey % 12 AS INT) AS profile_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS deleted
FROM orders""",
    "offers": """
SELECT CAST(o_custkey % 40 AS INT) AS campaign_group_id, CAST(o_custkey % 25 AS INT) AS bucket_member_id,
  CAST(o_orderkey % 12 AS INT) AS bucket_id, CAST(o_orderkey % 5 AS INT) AS country_group_id,
  CAST(1 + o_orderkey % 6 AS INT) AS creative_size_bucket_id, 0 AS deleted, CAST(o_orderkey % 3 AS INT) AS opt_state
FROM orders""",
    "inventory_exclusion": f"""
SELECT CAST(o_custkey % 40 AS INT) AS campaign_group_id, CAST(o_orderkey % 5 AS INT) AS country_group_id,
  CAST(o_orderkey % 7 AS INT) AS tag_id, CAST(1 + o_orderkey % 6 AS INT) AS creative_size_bucket_id,
  CAST(1 + o_orderkey % 3 AS INT) AS exclusion_state_id, 1 AS active,
  CAST(CAST(o_orderdate AS DATE) AS STRING) || ' ' || {_CLOCK.format(c='o_orderkey')} || ':30:00' AS last_modified,
  o_orderkey AS id
FROM orders""",
    "nodes": """
SELECT campaign_group_id, CAST(site_id % 5 AS INT) AS country_group_id, tag_id,
  CASE WHEN area > 90000 THEN 3 WHEN area > 74000 THEN 2 WHEN area = 7128 THEN 4 WHEN area = 33782 THEN 5
    WHEN area = 7200 THEN 6 ELSE 1 END AS creative_size_bucket_id,
  100 + campaign_group_id AS pixel_id, ymdh,
  '1996-01-01 00' AS qt_start_time_adjusted, '1998-12-31 23' AS qt_finish_time,
  (campaign_group_id + tag_id) % 2 AS is_passed, imps, clicks, post_click_convs, post_view_convs,
  booked_revenue_adv_curr AS booked_rev
FROM (SELECT *, width * height AS area FROM perf_fact) f""",
    "tweets": """
SELECT doc_id AS tweet_id, text, lang, source AS screen_name,
  CASE doc_id % 5 WHEN 0 THEN 'WA' WHEN 1 THEN 'CA' WHEN 2 THEN 'NY' WHEN 3 THEN 'TX' ELSE NULL END AS state
FROM documents""",
    "tracked": "SELECT substr(text, 1, 12) AS keyword FROM benchmark UNION ALL SELECT substr(text, 20, 3) FROM benchmark",
    "tweet_hashtags": """
SELECT doc_id AS tweet_id, source AS hashtag FROM documents UNION ALL SELECT doc_id, lang FROM documents""",
    "lexicon": """
SELECT * FROM (VALUES ('the', 1), ('and', -1), ('for', 2), ('is', -2), ('les', 3), ('aux', -3), ('der', 1), ('el', -4))
  AS t(term, score)""",
    "phrase_lexicon": """
SELECT term, score FROM lexicon UNION ALL
SELECT * FROM (VALUES ('the and', 2), ('the the', -3), ('de de', 4), ('and and', -2)) AS p(term, score)""",
}


def _parents(sql: str) -> list[str]:
    return [n for n in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if n in PROJECTIONS]


def needed(names: list[str]) -> list[str]:
    """The named blocks and what they build on, in an order a WITH list can use."""
    out: list[str] = []

    def visit(name: str) -> None:
        for parent in _parents(PROJECTIONS[name]):
            visit(parent)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def with_list(*names: str) -> str:
    """``name AS (...), ...`` for a WITH clause."""
    return ",\n".join(f"{n} AS ({PROJECTIONS[n].strip()})" for n in needed(list(names)))


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table over the parquet files of ``sf_dir``."""
    query = f"WITH {with_list(name)} SELECT * FROM {name}"
    used = [t for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", query)]
    for t in used:
        query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def fixture_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, {n: (lambda s, n=n: projection(s, sf_dir, n)) for n in PROJECTIONS} | {
        "raw_pages": f"{sf_dir}/pages.parquet",
        "raw_documents": f"{sf_dir}/documents.parquet",
    })
