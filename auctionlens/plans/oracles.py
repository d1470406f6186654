"""The SQL each query is checked against, written from the job descriptions.

The statements join row by row and use no shortcut of the Spark plans.
"""

from __future__ import annotations

from auctionlens.constants import APP_SIZE_KEPT_MEMBER, EXCLUDED_MEMBERS
from auctionlens.operators import pages
from auctionlens.plans import queries as q
from auctionlens.sources.fixtures import with_list

ORACLES: dict[str, str] = {}


def _sql(name: str, tables: str, body: str) -> None:
    """``body`` is either a SELECT or further WITH entries followed by one."""
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    ORACLES[name] = f"WITH {with_list(*tables.split())}{glue}{body}"


_MEMBERS = ", ".join(str(m) for m in EXCLUDED_MEMBERS if m != APP_SIZE_KEPT_MEMBER)
_EXCL = f"seller_member_id NOT IN ({_MEMBERS}, 818)"
_EXCL_APP = f"seller_member_id NOT IN ({_MEMBERS})"
_DISPLAY = f"supply_type < 2 AND device_type = 0 AND {_EXCL} AND content_category_id > 0"
_SOCIAL = f"supply_type = 3 AND {_EXCL} AND content_category_id > 0"
_APP = f"supply_type = 2 AND {_EXCL}"
_MOBILE_WEB = f"supply_type < 2 AND device_id <> 0 AND {_EXCL}"
_RESOLD = "seller_member_id <> buyer_member_id"

_OPEN_BIDS = "payment_type = 0 AND campaign_id > 0"
_ALL_BIDS = "payment_type IN (0, 3, 4) AND campaign_id > 0"
_CHOSEN_BIDS = f"""payment_type IN (0, 3, 4)
  AND campaign_id IN (SELECT object_id FROM quick_stats WHERE imps > {q.CAMPAIGN_IMPS})"""


_CPA_CAMPAIGNS = f"""SELECT object_id FROM quick_stats
  WHERE time_interval = '7day' AND report_type = 'campaign' AND imps > {q.CPA_CAMPAIGN_IMPS} AND clicks > 2 * post_click_convs
    AND object_id IN (SELECT campaign_id FROM categorizer
      WHERE type IN ('rtb_event_payout', 'rtb_cpm_payout') AND value_type = 'pc_cpa'
      GROUP BY campaign_id HAVING count(*) = 1)"""
_CPA_BIDS = f"payment_type IN (0, 3, 4) AND campaign_id IN ({_CPA_CAMPAIGNS})"


def _later(hour: str, n: int) -> str:
    return f"strftime(strptime({hour}, '%Y-%m-%d %H') + INTERVAL {n} HOUR, '%Y-%m-%d %H')"


def _hourly_select(
    keys: str, imps: str, bids: str, once: bool = False, late: int = 1, measure: str = "clicks", zero: bool = False
) -> str:
    responses = "clicks" if measure == "clicks" else "(SELECT * FROM conversions WHERE post_click_conv = 1)"
    columns = ", ".join(f"{'b' if k == 'campaign_id' else 'i'}.{k}" for k in keys.split(", "))
    same = "b.auction_id_64 = i.auction_id_64 AND b.dh = i.dh"
    matched = f"(SELECT * FROM bids WHERE {bids}) b"
    join = "" if once else f"JOIN {matched} ON {same}"
    exists = f"WHERE EXISTS (SELECT 1 FROM {matched} WHERE {same})" if once else ""
    total = "sum(c.hit)"
    if zero:
        total = f"coalesce({total}, 0)"
    return f"""SELECT i.dh, {columns}, CAST(count(*) AS BIGINT) AS imps, CAST({total} AS BIGINT) AS {measure}
FROM (SELECT *, width * height AS size FROM imps WHERE {imps}) i
{join}
LEFT JOIN (SELECT auction_id_64, dh, 1 AS hit FROM {responses} r) c
  ON c.auction_id_64 = i.auction_id_64 AND c.dh >= i.dh AND c.dh <= {_later('i.dh', late)}
{exists}
GROUP BY i.dh, {columns}"""


_SITE = "width, height, content_category_id, site_domain, seller_member_id, geo_country"
_CAMPAIGN = "supply_type, operating_system, size, content_category_id, site_domain, campaign_id, geo_country"
_WEB_KEYS = "device_id, operating_system, geo_country, width, height, site_domain, content_category_id"
_APP_KEYS = "device_id, operating_system, application_id, geo_country"
_SOCIAL_KEYS = "operating_system, width, height, geo_country"

_HOURLY: dict[str, str] = {
    "agg_auction_features": _hourly_select(
        "operating_system, supply_type, content_category_id, site_domain, creative_id, geo_country, width, height, "
        "campaign_id, buyer_member_id",
        f"{_RESOLD} AND content_category_id > 0", _OPEN_BIDS, zero=True,
    ),
    "agg_display_rtb": _hourly_select(
        f"supply_type, {_SITE}", f"{_RESOLD} AND {_EXCL} AND content_category_id > 0", _OPEN_BIDS
    ),
    "agg_display_os": _hourly_select(f"supply_type, operating_system, {_SITE}", _DISPLAY, _ALL_BIDS, once=True),
    "agg_social": _hourly_select(_SOCIAL_KEYS, _SOCIAL, _ALL_BIDS, once=True),
    "agg_mobile_app": _hourly_select(_APP_KEYS, _APP, _ALL_BIDS, once=True),
    "agg_mobile_app_size": _hourly_select(
        "device_id, application_id, width, height, geo_country",
        f"supply_type = 2 AND {_RESOLD} AND {_EXCL_APP}", _OPEN_BIDS,
    ),
    "agg_mobile_web": _hourly_select(_WEB_KEYS, _MOBILE_WEB, _ALL_BIDS, once=True),
    "agg_conversions_seller": _hourly_select(
        f"supply_type, operating_system, {_SITE}", f"{_RESOLD} AND {_EXCL} AND content_category_id > 0",
        _OPEN_BIDS, late=23, measure="pc_convs",
    ),
    "agg_conversions_campaign": _hourly_select(
        _CAMPAIGN, f"{_RESOLD} AND {_EXCL} AND content_category_id > 0", _CPA_BIDS, late=23, measure="pc_convs"
    ),
    "agg_campaign_clicks": _hourly_select(_CAMPAIGN, f"{_EXCL} AND content_category_id > 0", _CHOSEN_BIDS),
}
for _name, _body in _HOURLY.items():
    _sql(_name, "imps bids clicks conversions quick_stats categorizer", _body)
# All auctions are of the one day.
ORACLES["agg_conversions_day"] = ORACLES["agg_conversions_seller"]

_TARGET_KEYS = (
    "application_id", "content_category_id", "device_id", "geo_country", "height", "operating_system",
    "seller_member_id", "site_domain", "supply_type", "width",
)


def _long(target: str, keys: str) -> str:
    own = keys.split(", ")
    columns = ", ".join(k if k in own else f"NULL AS {k}" for k in _TARGET_KEYS)
    return f"SELECT '{target}' AS target, dh, {columns}, imps, clicks FROM ({_HOURLY[target]}) AS {target}"


_sql(
    "agg_four_way", "imps bids clicks",
    "\nUNION ALL\n".join([
        _long("agg_display_os", f"supply_type, operating_system, {_SITE}"), _long("agg_social", _SOCIAL_KEYS),
        _long("agg_mobile_app", _APP_KEYS), _long("agg_mobile_web", _WEB_KEYS),
    ]),
)

_EXPORT_WEB = "site_domain, content_category_id, supply_type, width, height, geo_country, operating_system"
for _name, _stored, _keys in (
    ("hourly_export_web", "agg_display_os", _EXPORT_WEB),
    ("hourly_export_mobile_web", "agg_mobile_web", _WEB_KEYS),
    ("hourly_export_app", "agg_mobile_app", _APP_KEYS),
    ("hourly_export_social", "agg_social", _SOCIAL_KEYS),
):
    _sql(_name, "imps bids clicks", f"""
stored AS ({_HOURLY[_stored]})
SELECT dh, {_keys}, CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks
FROM stored GROUP BY dh, {_keys}""")

_sql("day_rollup", "imps bids clicks", f"""
stored AS ({_HOURLY['agg_display_os']})
SELECT substr(dh, 1, 10) AS dd, {_EXPORT_WEB}, CAST(sum(imps) AS BIGINT) AS imps,
  CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks
FROM stored GROUP BY substr(dh, 1, 10), {_EXPORT_WEB}""")

_sql("big_cpa_campaigns", "categorizer quick_stats", f"""
SELECT object_id AS campaign_id, imps, clicks, post_view_convs, post_click_convs, booked_revenue
FROM quick_stats
WHERE time_interval = '7day' AND report_type = 'campaign' AND imps > {q.CPA_CAMPAIGN_IMPS}
  AND clicks > 2 * post_click_convs
  AND object_id IN (
    SELECT campaign_id FROM categorizer
    WHERE type IN ('rtb_event_payout', 'rtb_cpm_payout') AND value_type = 'pc_cpa'
    GROUP BY campaign_id HAVING count(*) = 1)""")

_sql("big_campaigns", "quick_stats", f"""
SELECT object_id AS campaign_id, imps, clicks, post_view_convs, post_click_convs, booked_revenue
FROM quick_stats WHERE time_interval = '7day' AND report_type = 'campaign' AND imps > {q.CAMPAIGN_IMPS}""")

_TREE = """SELECT m.bid_model_id AS model_id, m.campaign_id FROM bid_model m JOIN campaign c ON c.id = m.campaign_id
WHERE m.deleted = 0 AND c.deleted = 0 AND c.state = 'active'"""
_sql("tree_campaigns", "bid_model campaign", _TREE)
_sql("tree_campaign_imps", "imps bids pixel_fires bid_model campaign", f"""
tree AS ({_TREE})
SELECT i.*, b.campaign_id, p.pixel_id
FROM imps i
JOIN bids b ON b.auction_id_64 = i.auction_id_64 AND b.dh = i.dh AND b.campaign_id IN (SELECT campaign_id FROM tree)
LEFT JOIN (SELECT * FROM pixel_fires WHERE campaign_id IN (SELECT campaign_id FROM tree)) p
  ON p.auction_id_64 = i.auction_id_64 AND p.dh >= i.dh AND p.dh <= '{q.TREE_END_HOUR}'""")

_sql("ready_hours", "imps bids clicks aggregated_hours", f"""
SELECT dh, follow_hour FROM (SELECT DISTINCT dh, {_later('dh', 1)} AS follow_hour FROM imps) h
WHERE dh > '2023-12-25 00' AND dh IN (SELECT dh FROM bids) AND dh IN (SELECT dh FROM clicks)
  AND dh NOT IN (SELECT dh FROM aggregated_hours) AND follow_hour IN (SELECT dh FROM clicks)""")
_sql("retained_hours", "clicks", "SELECT DISTINCT dh FROM clicks WHERE dh >= '2024-01-01 12'")
_sql("hours_to_load", "conversions aggregated_hours", """
SELECT DISTINCT dh FROM conversions WHERE dh NOT IN (SELECT dh FROM aggregated_hours)""")
_sql("incremental_rows", "conversions aggregated_hours", """
SELECT * FROM conversions WHERE dh NOT IN (SELECT dh FROM aggregated_hours)""")

# Reporting

_REPORTED = "imp_type NOT IN (7, 9, 10, 11)"
_SINCE = "ymd >= '1993-09-14'"
_ANY_REVENUE = "booked_revenue_dollars + reseller_revenue"
_WHEN = {
    "perf": "revenue_type IN (3, 4)",
    "perf_managed": "revenue_type IN (3, 4) AND imp_type = 5",
    "perf_xnet": "revenue_type IN (3, 4) AND imp_type = 6",
    "learn": "imp_type IN (5, 6) AND predict_type_rev IN (0, 1) AND revenue_type IN (3, 4)",
    "learn_managed": "imp_type = 5 AND predict_type_rev IN (0, 1) AND revenue_type IN (3, 4)",
    "learn_xnet": "imp_type = 6 AND predict_type_rev IN (0, 1) AND revenue_type IN (3, 4)",
}


def _imps(cls: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {_WHEN[cls]} THEN imps ELSE 0 END) AS BIGINT) AS {name}"


def _revenue(cls: str, name: str) -> str:
    value = "booked_revenue_dollars" if cls.startswith("learn") else _ANY_REVENUE
    return f"CAST(sum(CASE WHEN {_WHEN[cls]} THEN {value} ELSE 0 END) AS DOUBLE) AS {name}"


_sql("site_daily_stats", "perf_fact marketplace", f"""
stats AS (
  SELECT ymd, seller_member_id, site_id, CAST(sum(imps) AS BIGINT) AS imps,
    {', '.join(_imps(c, c + '_imps') for c in _WHEN)},
    CAST(sum({_ANY_REVENUE}) AS DOUBLE) AS revenue, {', '.join(_revenue(c, c + '_rev') for c in _WHEN)}
  FROM perf_fact WHERE {_REPORTED} GROUP BY ymd, seller_member_id, site_id
  HAVING sum(CASE WHEN {_WHEN['perf']} THEN imps ELSE 0 END) > {q.SITE_MIN_IMPS})
SELECT *, CASE WHEN site_id IN (SELECT site_id FROM marketplace WHERE deleted = 0 AND performance = 1)
  THEN 1 ELSE 0 END AS in_programme FROM stats""")


def _perf_select(grain: str) -> str:
    keys = (
        f"{grain}, seller_member_id, site_id, geo_country, width, height, campaign_group_id, campaign_id, "
        "creative_id, tag_id"
    )
    classes = ("perf", "perf_managed", "perf_xnet")
    return f"""SELECT {keys}, CAST(sum(imps) AS BIGINT) AS total_imps,
  {', '.join(_imps(c, c + '_imps') for c in classes)}, CAST(sum({_ANY_REVENUE}) AS DOUBLE) AS total_revenue,
  {', '.join(_revenue(c, c + '_revenue') for c in classes)},
  {_imps('learn', 'learn_imps')}, {_revenue('learn', 'learn_rev')}
FROM perf_fact
WHERE {_REPORTED} AND {_SINCE} AND site_id IN (SELECT site_id FROM programme)
GROUP BY {keys}"""


_sql("perf_data_daily", "perf_fact programme", _perf_select("ymd"))
_sql("perf_data_hourly", "perf_fact programme", _perf_select("ymdh"))
_sql("perf_ratios", "perf_fact programme", f"""
sums AS (
  SELECT ymd, seller_member_id, CAST(sum(imps) AS BIGINT) AS total_imps, sum({_ANY_REVENUE}) AS total_revenue,
    {', '.join(_imps(c, c + '_imps') for c in ('learn', 'perf', 'perf_managed', 'perf_xnet'))},
    {', '.join(f"sum(CASE WHEN {_WHEN[c]} THEN {_ANY_REVENUE} ELSE 0 END) AS {c}_revenue"
               for c in ('perf', 'perf_managed', 'perf_xnet'))},
    sum(CASE WHEN {_WHEN['learn']} THEN booked_revenue_dollars ELSE 0 END) AS learn_rev
  FROM perf_fact
  WHERE {_REPORTED} AND {_SINCE} AND site_id IN (SELECT site_id FROM programme)
  GROUP BY ymd, seller_member_id)
SELECT ymd, seller_member_id, total_imps, learn_imps, perf_imps, perf_managed_imps, perf_xnet_imps,
  CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(learn_rev AS DOUBLE) AS learn_rev,
  CAST(perf_revenue AS DOUBLE) AS perf_revenue, CAST(perf_managed_revenue AS DOUBLE) AS perf_managed_revenue,
  CAST(perf_xnet_revenue AS DOUBLE) AS perf_xnet_revenue,
  CAST(learn_imps AS DOUBLE) / nullif(total_imps, 0) AS learn_pct,
  CAST(perf_revenue AS DOUBLE) * 1000.0 / nullif(perf_imps, 0) AS perf_rpm,
  CAST(perf_managed_revenue AS DOUBLE) * 1000.0 / nullif(perf_managed_imps, 0) AS perf_managed_rpm,
  CAST(perf_xnet_revenue AS DOUBLE) * 1000.0 / nullif(perf_xnet_imps, 0) AS perf_xnet_rpm,
  CAST(total_revenue - perf_revenue AS DOUBLE) * 1000.0 / nullif(total_imps - perf_imps, 0) AS flat_cpm_rpm,
  total_imps - perf_imps AS flat_cpm_imps, CAST(total_revenue - perf_revenue AS DOUBLE) AS flat_cpm_revenue,
  CAST(learn_rev AS DOUBLE) * 1000.0 / nullif(learn_imps, 0) AS learn_rpm
FROM sums""")


def _learn_select(grain: str, narrowed: str = "") -> str:
    keys = f"{grain}, site_id, geo_country, width, height"
    return f"""SELECT {keys}, CAST(sum(imps) AS BIGINT) AS imps, {_imps('learn_managed', 'learn_imps')}
FROM perf_fact
WHERE {_REPORTED} AND {_SINCE} AND site_id IN (SELECT site_id FROM programme) {narrowed}
GROUP BY {keys}"""


_sql("learn_share", "perf_fact programme", _learn_select("ymd"))
_sql("learn_share_hourly", "perf_fact programme", _learn_select(
    "ymdh", "AND width = 300 AND height = 250 AND geo_country IN ('NATION_1', 'NATION_2', 'NATION_3')"
))

_sql("code_labels", "perf_fact", """
imp_names(imp_type, imp_type_name) AS (VALUES (1, 'Blank'), (2, 'PSA'), (3, 'Default Error'), (4, 'Default'),
  (5, 'Kept'), (6, 'Resold'), (7, 'RTB'), (8, 'PSA Error'), (9, 'Ext Imp'), (10, 'Ext Click'), (11, 'FB')),
rev_names(revenue_type, rev_type_name) AS (VALUES (-1, 'No Payment'), (0, 'Flat CPM'), (1, 'Cost plus CPM'),
  (2, 'Cost plus Margin'), (3, 'CPC'), (4, 'CPA'), (5, 'Revshare'), (6, 'Flat Fee')),
predict_names(predict_type_rev, predict_type_name, bid_type) AS (VALUES (-2, 'None', '-'), (-1, 'Base', 'Manual'),
  (0, 'Learn Give-Up', 'Learn Give-Up'), (1, 'Learn', 'Learn'), (2, 'Throttled', 'Optimized'),
  (3, 'Optimized_0', 'Optimized'), (4, 'Biased_1', 'Optimized'), (5, 'Optimized_1', 'Optimized'),
  (6, 'Biased_2', 'Optimized'), (7, 'Optimized_2', 'Optimized'), (8, 'Optimized_Give_up', 'Optimized Give-Up'),
  (9, 'Base Give-Up', 'Manual Give-Up'))
SELECT f.imp_type, f.revenue_type, f.predict_type_rev, CAST(sum(f.imps) AS BIGINT) AS imps, imp_type_name,
  rev_type_name, predict_type_name, bid_type
FROM perf_fact f LEFT JOIN imp_names USING (imp_type) LEFT JOIN rev_names USING (revenue_type)
LEFT JOIN predict_names USING (predict_type_rev)
GROUP BY f.imp_type, f.revenue_type, f.predict_type_rev, imp_type_name, rev_type_name, predict_type_name, bid_type""")

_sql("offer_states", "offers", """
SELECT opt_state, CAST(count(*) AS BIGINT) AS offers,
  CASE opt_state WHEN 0 THEN 'Test' WHEN 1 THEN 'Pass' WHEN 2 THEN 'Fail' WHEN 3 THEN 'Suspended'
    WHEN 4 THEN 'Frozen' WHEN 5 THEN 'Eligible' END AS opt_state_nm
FROM offers GROUP BY opt_state""")

_SIZE_BUCKET = """CASE WHEN {a} > 90000 THEN 3 WHEN {a} > 74000 THEN 2 WHEN {a} = 7128 THEN 4
  WHEN {a} = 33782 THEN 5 WHEN {a} = 7200 THEN 6 ELSE 1 END"""
_sql("size_buckets", "imps", f"""
SELECT width, height, {_SIZE_BUCKET.format(a='width * height')} AS bucket, CAST(count(*) AS BIGINT) AS imps
FROM imps GROUP BY width, height""")
_sql("size_predicates", "imps", """
sizes AS (SELECT width, height, width * height AS a FROM imps)
SELECT CAST(count(*) FILTER (WHERE width = 0 AND height = 0) AS BIGINT) AS bucket_0,
  CAST(count(*) FILTER (WHERE a <= 74000 AND a NOT IN (7128, 33782, 7200)) AS BIGINT) AS bucket_1,
  CAST(count(*) FILTER (WHERE a > 74000 AND a <= 90000) AS BIGINT) AS bucket_2,
  CAST(count(*) FILTER (WHERE a > 90000) AS BIGINT) AS bucket_3,
  CAST(count(*) FILTER (WHERE a = 7128) AS BIGINT) AS bucket_4,
  CAST(count(*) FILTER (WHERE a = 33782) AS BIGINT) AS bucket_5,
  CAST(count(*) FILTER (WHERE a = 7200) AS BIGINT) AS bucket_6
FROM sizes""")

# Sites and lookups

_PROGRAMME = """SELECT s.member_id, m.site_id, m.created_on, substr(m.last_modified, 1, 10) AS last_modified
FROM marketplace m JOIN site s ON s.id = m.site_id
WHERE m.deleted = 0 AND m.performance = 1 AND s.deleted = 0"""
_sql("programme_sites", "site marketplace", f"{_PROGRAMME} AND s.member_id <> 958")
_sql("programme_sites_member", "site marketplace",
     f"{_PROGRAMME} AND s.member_id = 15 AND m.created_on >= '2024-01-01'")
_SITE_BUCKETS = """site_buckets AS (SELECT id AS site_id, managed_bucket_id AS bucket_id FROM site
  WHERE deleted = 0 AND state = 'active')"""
_SIZES = """sizes AS (SELECT id AS creative_size_bucket_id, width, height FROM creative_sizes
  WHERE deleted = 0 AND active = 1)"""
_sql("map_sell_side_keys", "perf_fact site country creative_sizes", f"""
{_SITE_BUCKETS}, {_SIZES},
data AS (SELECT site_id, geo_country, width, height, CAST(sum(imps) AS BIGINT) AS imps FROM perf_fact
  GROUP BY site_id, geo_country, width, height)
SELECT d.*, b.bucket_id, c.country_group_id, coalesce(s.creative_size_bucket_id, 1) AS creative_size_bucket_id
FROM data d LEFT JOIN site_buckets b ON b.site_id = d.site_id
LEFT JOIN country c ON c.code = d.geo_country AND c.deleted = 0
LEFT JOIN sizes s ON s.width = d.width AND s.height = d.height""")
_sql("sites_of_publishers", "site programme", """
SELECT DISTINCT id FROM site WHERE publisher_id IN (
  SELECT publisher_id FROM site WHERE id IN (SELECT site_id FROM programme))""")
_sql("site_bucket_map", "site", f"{_SITE_BUCKETS} SELECT * FROM site_buckets")
_sql("sites_of_buckets", "site marketplace offers", """
SELECT s.id AS site_id, s.managed_bucket_id AS bucket_id FROM site s JOIN marketplace m ON m.site_id = s.id
WHERE s.deleted = 0 AND m.performance = 1
  AND s.managed_bucket_id IN (SELECT bucket_id FROM offers WHERE opt_state = 0)""")
_sql("site_closure", "site marketplace programme", f"""
{_SITE_BUCKETS}
SELECT s.id AS site_id, s.managed_bucket_id AS bucket_id FROM site s JOIN marketplace m ON m.site_id = s.id
WHERE s.deleted = 0 AND m.performance = 1 AND s.managed_bucket_id IN (
  SELECT bucket_id FROM site_buckets WHERE site_id IN (SELECT site_id FROM programme))""")
_sql("size_bucket_map", "creative_sizes", f"{_SIZES} SELECT * FROM sizes")

_sql("clogged_nodes", "perf_fact programme offers site country creative_sizes campaign_group", f"""
{_SITE_BUCKETS}, {_SIZES},
served AS (
  SELECT f.campaign_group_id, c.country_group_id, s.creative_size_bucket_id, b.bucket_id, sum(f.imps) AS imps
  FROM perf_fact f JOIN country c ON c.code = f.geo_country JOIN site_buckets b ON b.site_id = f.site_id
  JOIN sizes s ON s.width = f.width AND s.height = f.height
  WHERE f.ymd > '1993-09-14' AND f.imp_type = 5 AND f.revenue_type IN (3, 4) AND f.predict_type_rev IN (0, 1)
    AND f.site_id IN (SELECT site_id FROM programme)
  GROUP BY f.campaign_group_id, c.country_group_id, s.creative_size_bucket_id, b.bucket_id),
offered AS (
  SELECT o.* FROM offers o JOIN campaign_group g ON g.id = o.campaign_group_id AND g.member_id = o.bucket_member_id
  WHERE o.deleted = 0 AND o.opt_state = 0 AND o.bucket_id IN (
    SELECT bucket_id FROM site_buckets WHERE site_id IN (SELECT site_id FROM programme))),
counted AS (
  SELECT o.bucket_id, o.country_group_id, o.creative_size_bucket_id,
    CAST(sum(CASE WHEN o.campaign_group_id > 0 THEN 1 ELSE 0 END) AS BIGINT) AS number_of_offers,
    CAST(sum(CASE WHEN v.imps > 0 THEN 1 ELSE 0 END) AS BIGINT) AS number_of_offers_w_imps
  FROM offered o LEFT JOIN served v ON v.campaign_group_id = o.campaign_group_id AND v.bucket_id = o.bucket_id
    AND v.country_group_id = o.country_group_id AND v.creative_size_bucket_id = o.creative_size_bucket_id
  GROUP BY o.bucket_id, o.country_group_id, o.creative_size_bucket_id)
SELECT *, number_of_offers - number_of_offers_w_imps AS clogged_offers FROM counted""")

# Campaign metadata and goals

_sql("campaigns_by_target", "campaign campaign_group profile_target_age profile_target_segment", """
targeted AS (SELECT profile_id FROM profile_target_age WHERE deleted = 0
  UNION SELECT profile_id FROM profile_target_segment WHERE deleted = 0)
SELECT DISTINCT c.id AS campaign_id FROM campaign c LEFT JOIN campaign_group g ON g.id = c.campaign_group_id
WHERE (c.profile_id > 0 AND c.profile_id IN (SELECT profile_id FROM targeted))
   OR (g.profile_id > 0 AND g.profile_id IN (SELECT profile_id FROM targeted))""")

_sql("campaign_pixel_meta", "pixel group_pixel campaign_group campaign currency categorizer goal", """
open_group AS (SELECT id, currency FROM campaign_group WHERE state = 'active' AND deleted = 0),
open_campaign AS (SELECT id, campaign_group_id FROM campaign WHERE state = 'active' AND deleted = 0),
open_pixel AS (SELECT id, trigger_type FROM pixel WHERE state = 'active' AND deleted = 0),
attached AS (
  SELECT campaign_group_id, pixel_id, post_view_revenue, post_click_revenue FROM group_pixel
  WHERE state = 'active' AND deleted = 0),
live AS (
  SELECT a.campaign_group_id, open_campaign.id AS campaign_id, a.pixel_id, open_pixel.trigger_type, a.post_view_revenue,
    a.post_click_revenue, currency.conversion_rate
  FROM attached a
  JOIN open_group ON open_group.id = a.campaign_group_id
  JOIN currency ON currency.code = open_group.currency
  JOIN open_campaign ON open_campaign.campaign_group_id = a.campaign_group_id
  JOIN open_pixel ON open_pixel.id = a.pixel_id),
split AS (
  SELECT campaign_group_id, campaign_id, pixel_id,
    CASE trigger_type WHEN 'hybrid' THEN 'view' ELSE trigger_type END AS trigger_type,
    CASE WHEN trigger_type IN ('hybrid', 'view') THEN post_view_revenue ELSE post_click_revenue END AS revenue,
    conversion_rate FROM live
  UNION ALL
  SELECT campaign_group_id, campaign_id, pixel_id, 'click', post_click_revenue, conversion_rate
  FROM live WHERE trigger_type = 'hybrid'),
paid AS (
  SELECT campaign_id, pixel_id, CASE value_type WHEN 'pc_cpa' THEN 'click' WHEN 'pv_cpa' THEN 'view' END AS trigger_type,
    sum(CASE WHEN type = 'advertiser_goal' THEN value END) AS adv_goal,
    sum(CASE WHEN type = 'rtb_cpm_payout' THEN value END) AS rtb_cpm_payout
  FROM categorizer WHERE type IN ('advertiser_goal', 'rtb_cpm_payout') AND value_type IN ('pc_cpa', 'pv_cpa')
  GROUP BY campaign_id, pixel_id, value_type),
targets AS (
  SELECT campaign_group_id, pixel_id, 'view' AS trigger_type, post_view_goal_target AS goal_target FROM goal
  WHERE state = 'active' AND post_view_goal_target IS NOT NULL
  UNION ALL
  SELECT campaign_group_id, pixel_id, 'click', post_click_goal_target FROM goal
  WHERE state = 'active' AND post_click_goal_target IS NOT NULL)
SELECT s.campaign_group_id, s.campaign_id, s.pixel_id, s.trigger_type,
  CAST(s.revenue AS DOUBLE) / CAST(s.conversion_rate AS DOUBLE) AS revenue,
  CAST(p.adv_goal AS DOUBLE) / CAST(s.conversion_rate AS DOUBLE) AS adv_goal,
  CAST(p.rtb_cpm_payout AS DOUBLE) / CAST(s.conversion_rate AS DOUBLE) AS rtb_cpm_payout,
  CAST(t.goal_target AS DOUBLE) / CAST(s.conversion_rate AS DOUBLE) AS goal_target
FROM split s
LEFT JOIN paid p ON p.campaign_id = s.campaign_id AND p.pixel_id = s.pixel_id AND p.trigger_type = s.trigger_type
LEFT JOIN targets t ON t.campaign_group_id = s.campaign_group_id AND t.pixel_id = s.pixel_id
  AND t.trigger_type = s.trigger_type""")

_GOALS = """goals AS (
  SELECT g.id AS cg_id, g.goal_type, g.revenue_type,
    CASE WHEN g.goal_type <> 'cpa' THEN CAST(v.goal_threshold AS DOUBLE) END AS goal_threshold,
    CASE WHEN g.goal_type <> 'ctr' THEN x.pixel_id END AS pixel_id,
    CASE WHEN g.goal_type <> 'ctr' THEN CAST(x.post_view_goal_threshold AS DOUBLE) END AS pvg_threshold,
    CASE WHEN g.goal_type <> 'ctr' THEN CAST(x.post_click_goal_threshold AS DOUBLE) END AS pcg_threshold
  FROM campaign_group g LEFT JOIN valuation v ON v.campaign_group_id = g.id
  LEFT JOIN goal x ON x.campaign_group_id = g.id
  WHERE g.deleted = 0 AND (
    (g.goal_type = 'ctr' AND v.goal_threshold IS NOT NULL AND coalesce(v.deleted, 0) <> 1)
    OR (g.goal_type = 'cpc' AND v.goal_threshold IS NOT NULL)
    OR (g.goal_type = 'cpa' AND coalesce(x.deleted, 0) <> 1
        AND (x.post_view_goal_threshold IS NOT NULL OR x.post_click_goal_threshold IS NOT NULL))))"""
_GOAL_TABLES = "campaign_group valuation goal"
_sql("line_item_goals", _GOAL_TABLES, f"{_GOALS} SELECT * FROM goals")

_ITEMS = """items AS (
  SELECT cg_id AS line_item, goal_type, goal_threshold AS goal_value, 0 AS pixel_id FROM goals
  WHERE goal_type IN ('ctr', 'cpc') AND goal_threshold IS NOT NULL
  UNION ALL SELECT cg_id, 'cpa_post_click', pcg_threshold, pixel_id FROM goals
  WHERE goal_type = 'cpa' AND pcg_threshold IS NOT NULL
  UNION ALL SELECT cg_id, 'cpa_post_view', pvg_threshold, pixel_id FROM goals
  WHERE goal_type = 'cpa' AND pvg_threshold IS NOT NULL)"""
_sql("conform_line_items", _GOAL_TABLES, f"{_GOALS}, {_ITEMS} SELECT * FROM items")

_BOOKED = """CAST(sum(booked_revenue_adv_curr) AS DOUBLE) AS booked_rev,
  CAST(sum(booked_revenue_dollars) AS DOUBLE) AS booked_rev_dol"""
_VOLUMES = """CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks,
  CAST(sum(post_click_convs) AS BIGINT) AS pcc, CAST(sum(post_view_convs) AS BIGINT) AS pvc"""
_CHECKED = f"imp_type IN (5, 7, 11) AND ymdh >= '{q.START}' AND ymdh <= '{q.END}'"
_sql("node_metrics", "perf_fact country", f"""
SELECT ymdh, {_VOLUMES}, {_BOOKED}
FROM perf_fact
WHERE {_CHECKED} AND campaign_group_id = 8 AND tag_id = 2 AND pixel_id IN (0, 108)
  AND width * height > 74000 AND width * height <= 90000
  AND geo_country IN (SELECT code FROM country WHERE country_group_id = 1)
GROUP BY ymdh""")


def _click_rows(goal_types: str) -> str:
    keys = "ymdh, campaign_group_id, tag_id, geo_country, width * height"
    return f"""SELECT ymdh, campaign_group_id, tag_id, geo_country, width * height AS size,
  CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks, {_BOOKED}
FROM perf_fact
WHERE {_CHECKED} AND pixel_id = 0
  AND campaign_group_id IN (SELECT cg_id FROM goals WHERE goal_type IN ({goal_types}))
GROUP BY {keys}"""


_CONVERSION_ROWS = f"""SELECT ymdh, campaign_group_id, pixel_id, tag_id, geo_country, width * height AS size,
  {_BOOKED}, CAST(sum(post_view_convs) AS BIGINT) AS post_view_convs,
  CAST(sum(post_click_convs) AS BIGINT) AS post_click_convs
FROM perf_fact
WHERE {_CHECKED} AND campaign_group_id IN (SELECT cg_id FROM goals WHERE goal_type = 'cpa')
GROUP BY ymdh, campaign_group_id, pixel_id, tag_id, geo_country, width * height"""
_sql("ctr_node_rows", f"perf_fact {_GOAL_TABLES}", f"{_GOALS} {_click_rows(chr(39) + 'ctr' + chr(39))}")
_sql("cpa_node_rows", f"perf_fact {_GOAL_TABLES}", f"{_GOALS} {_CONVERSION_ROWS}")

_AS_NODE = f"""coalesce(CAST(c.country_group_id AS VARCHAR), '') AS country_group_id,
  {_SIZE_BUCKET.format(a='f.width * f.height')} AS creative_size_bucket_id"""
for _type in ("ctr", "cpc"):
    _sql(f"node_aggregates_{_type}", f"perf_fact country {_GOAL_TABLES}", f"""
{_GOALS},
rows AS (
  SELECT f.*, {_AS_NODE} FROM perf_fact f LEFT JOIN country c ON c.code = upper(f.geo_country)
  WHERE {_CHECKED} AND pixel_id = 0 AND campaign_group_id IN (SELECT cg_id FROM goals WHERE goal_type = '{_type}'))
SELECT campaign_group_id, tag_id, country_group_id, creative_size_bucket_id, ymdh, {_BOOKED},
  CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks
FROM rows GROUP BY campaign_group_id, tag_id, country_group_id, creative_size_bucket_id, ymdh""")
_sql("node_aggregates_cpa", f"perf_fact country {_GOAL_TABLES}", f"""
{_GOALS},
own AS (SELECT cg_id, max(pixel_id) AS goal_pixel FROM goals WHERE goal_type = 'cpa' GROUP BY cg_id),
rows AS (
  SELECT f.*, {_AS_NODE} FROM perf_fact f LEFT JOIN country c ON c.code = f.geo_country
  WHERE {_CHECKED} AND campaign_group_id IN (SELECT cg_id FROM own)),
merged AS (
  SELECT pixel_id, campaign_group_id, tag_id, country_group_id, creative_size_bucket_id, ymdh, {_BOOKED},
    CAST(sum(post_view_convs) AS BIGINT) AS post_view_convs, CAST(sum(post_click_convs) AS BIGINT) AS post_click_convs
  FROM rows GROUP BY pixel_id, campaign_group_id, tag_id, country_group_id, creative_size_bucket_id, ymdh),
mapped AS (
  SELECT CASE WHEN m.pixel_id = 0 THEN coalesce(o.goal_pixel, 0) ELSE m.pixel_id END AS pixel_id,
    m.* EXCLUDE (pixel_id) FROM merged m LEFT JOIN own o ON o.cg_id = m.campaign_group_id)
SELECT * FROM mapped WHERE pixel_id IN (SELECT goal_pixel FROM own)""")

_IN_SCOPE = """campaign_group_id IN (SELECT line_item FROM items)
  AND (pixel_id = 0 OR pixel_id IN (SELECT pixel_id FROM items))"""
_sql("camp_perf", f"perf_fact {_GOAL_TABLES}", f"""
{_GOALS}, {_ITEMS}
SELECT campaign_group_id, {_VOLUMES}, {_BOOKED}
FROM perf_fact WHERE {_CHECKED} AND {_IN_SCOPE} GROUP BY campaign_group_id""")

_CHANGES = f"""ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY campaign_group_id, country_group_id, tag_id, creative_size_bucket_id
    ORDER BY last_modified DESC, id DESC) AS rn
  FROM inventory_exclusion
  WHERE last_modified >= '{q.START}' AND last_modified < '{q.END}' AND exclusion_state_id <> 1 AND active = 1),
changes AS (
  SELECT substr(last_modified, 1, 14) || '00:00' AS ymdh, campaign_group_id,
    CAST(sum(CASE WHEN exclusion_state_id = 2 THEN 1 ELSE 0 END) AS BIGINT) AS number_of_passed_buckets,
    CAST(sum(CASE WHEN exclusion_state_id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS number_of_excluded_buckets
  FROM ranked WHERE rn = 1 GROUP BY substr(last_modified, 1, 14) || '00:00', campaign_group_id)"""
_sql("exclusion_counts", "inventory_exclusion", f"{_CHANGES} SELECT * FROM changes")
_sql("camp_perf_hourly", f"perf_fact inventory_exclusion {_GOAL_TABLES}", f"""
{_GOALS}, {_ITEMS}, {_CHANGES},
perf AS (
  SELECT ymdh || ':00:00' AS ymdh, campaign_group_id, {_VOLUMES}, {_BOOKED}
  FROM perf_fact
  WHERE imp_type IN (5, 7, 11) AND ymdh >= '{q.START}' AND ymdh < '{q.END}' AND {_IN_SCOPE}
  GROUP BY ymdh, campaign_group_id)
SELECT p.*, coalesce(c.number_of_passed_buckets, 0) AS number_of_passed_buckets,
  coalesce(c.number_of_excluded_buckets, 0) AS number_of_excluded_buckets, 'None' AS group_type,
  i.goal_type, i.goal_value, i.pixel_id
FROM perf p LEFT JOIN changes c ON c.ymdh = p.ymdh AND c.campaign_group_id = p.campaign_group_id
LEFT JOIN items i ON i.line_item = p.campaign_group_id""")

# Buckets

_SUMS = "sum(imps) AS imps, sum(clicks) AS clicks"


def _levels(prefix: str, source: str, where: str = "1 = 1") -> str:
    """Grouped levels of the site, tag, seller hierarchy under the bucket threshold."""
    t = q.MIN_IMPS
    return f"""{prefix}0 AS (SELECT site_id, tag_id, seller_member_id, {_SUMS} FROM {source} WHERE {where}
  GROUP BY site_id, tag_id, seller_member_id),
{prefix}1 AS (SELECT tag_id, seller_member_id, {_SUMS} FROM {prefix}0 WHERE imps < {t} GROUP BY tag_id, seller_member_id),
{prefix}2 AS (SELECT seller_member_id, {_SUMS} FROM {prefix}1 WHERE imps < {t} GROUP BY seller_member_id),
{prefix}buckets AS (
  SELECT 0 AS level, site_id, tag_id, seller_member_id, imps, clicks FROM {prefix}0 WHERE imps >= {t}
  UNION ALL SELECT 1, NULL, tag_id, seller_member_id, imps, clicks FROM {prefix}1 WHERE imps >= {t}
  UNION ALL SELECT 2, NULL, NULL, seller_member_id, imps, clicks FROM {prefix}2 WHERE imps >= {t}
  UNION ALL SELECT 3, NULL, NULL, NULL, coalesce(sum(imps), 0) + 1, coalesce(sum(clicks), 0) FROM {prefix}2
    WHERE imps < {t})"""


_BUILT = _levels("b", "perf_fact")
_BIG = "CAST(imps AS BIGINT) AS imps, CAST(clicks AS BIGINT) AS clicks"
_sql("bucketize", "perf_fact", f"""
{_BUILT} SELECT level, site_id, tag_id, seller_member_id, {_BIG} FROM bbuckets""")

_LEVEL_OF = """CASE WHEN EXISTS (SELECT 1 FROM bbuckets b WHERE b.level = 0 AND b.site_id = f.site_id
    AND b.tag_id = f.tag_id AND b.seller_member_id = f.seller_member_id) THEN 0
  WHEN EXISTS (SELECT 1 FROM bbuckets b WHERE b.level = 1 AND b.tag_id = f.tag_id
    AND b.seller_member_id = f.seller_member_id) THEN 1
  WHEN EXISTS (SELECT 1 FROM bbuckets b WHERE b.level = 2 AND b.seller_member_id = f.seller_member_id) THEN 2
  ELSE 3 END"""
_PLACED = """CASE WHEN level <= 0 THEN site_id END AS site_id, CASE WHEN level <= 1 THEN tag_id END AS tag_id,
    CASE WHEN level <= 2 THEN seller_member_id END AS seller_member_id"""


def _applied(where: str) -> str:
    return f"""{_BUILT},
placed AS (SELECT level, {_PLACED}, campaign_id, imps, clicks
  FROM (SELECT f.*, {_LEVEL_OF} AS level FROM perf_fact f WHERE {where}) x),
per_campaign AS (SELECT level, site_id, tag_id, seller_member_id, campaign_id, {_SUMS} FROM placed
  GROUP BY level, site_id, tag_id, seller_member_id, campaign_id)"""


_sql("bucket_perf", "perf_fact", f"""
{_applied(_REPORTED)}
SELECT level, site_id, tag_id, seller_member_id, CAST(sum(imps) AS BIGINT) AS imps,
  CAST(sum(clicks) AS BIGINT) AS clicks
FROM placed WHERE level < 3 GROUP BY level, site_id, tag_id, seller_member_id""")
_sql("bucket_perf_campaign", "perf_fact", f"""
{_applied(_REPORTED)}
SELECT level, site_id, tag_id, seller_member_id, campaign_id, {_BIG} FROM per_campaign""")


def _ent(n: str, y: str) -> str:
    return f"""CASE WHEN {y} = 0 OR {y} = {n} THEN 0.0
    ELSE -(({n} - {y}) * ln(CAST({n} - {y} AS DOUBLE) / {n}) + {y} * ln(CAST({y} AS DOUBLE) / {n})) END"""


def _scores(source: str) -> str:
    return f"""scores AS (
  SELECT level, sum({_ent('imps', 'clicks')}) AS entropy, -sum(CAST(clicks AS DOUBLE) * clicks / imps) AS variance,
    CAST(count(*) AS BIGINT) AS buckets, CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks
  FROM {source} GROUP BY level),
total AS (
  SELECT sum(variance) AS total_var, CAST(sum(trunc(entropy)) AS BIGINT) AS total_entropy,
    CAST(sum(buckets) AS BIGINT) AS num_buckets, CAST(sum(imps) AS BIGINT) AS imps, CAST(sum(clicks) AS BIGINT) AS clicks
  FROM scores)"""


_GAIN = f"round(1 - CAST(total_entropy AS DOUBLE) / nullif({_ent('imps', 'clicks')}, 0), 6) AS info_gain"
_sql("campaign_gain", "perf_fact", f"""
{_applied('1 = 1')}, {_scores('per_campaign')}
SELECT round(total_var, 6) AS total_var, total_entropy AS conditional_entropy, {_GAIN} FROM total""")
_sql("bucket_variance", "perf_fact", f"""
{_BUILT}
SELECT round(sum(CAST(clicks AS DOUBLE) * (1 - CAST(clicks AS DOUBLE) / imps)), 6) AS variance,
  round(-sum(CAST(clicks AS DOUBLE) * clicks / imps), 6) AS variance_2
FROM bbuckets""")
_sql("bucket_entropy", "perf_fact", f"""
{_BUILT}
SELECT round(sum({_ent('imps', 'clicks')}), 6) AS entropy, CAST(trunc(sum({_ent('imps', 'clicks')})) AS BIGINT) AS entropy_int
FROM bbuckets""")
_sql("level_scores", "perf_fact", f"""
{_BUILT}, {_scores('bbuckets')}
SELECT level, round(entropy, 6) AS entropy, round(variance, 6) AS variance, buckets, imps, clicks FROM scores""")
_sql("bucket_summary", "perf_fact", f"""
{_BUILT}, {_scores('bbuckets')}
SELECT round(total_var, 6) AS total_var, {_GAIN}, num_buckets, imps, clicks FROM total""")

_IS0 = "(site_id, tag_id, seller_member_id) IN (SELECT (site_id, tag_id, seller_member_id) FROM bbuckets WHERE level = 0)"
_IS1 = "(tag_id, seller_member_id) IN (SELECT (tag_id, seller_member_id) FROM bbuckets WHERE level = 1)"
_IS2 = "seller_member_id IN (SELECT seller_member_id FROM bbuckets WHERE level = 2)"
_sql("bucket_update", "perf_fact", f"""
{_BUILT},
u0 AS (SELECT *, {_IS0} AS known FROM (SELECT site_id, tag_id, seller_member_id, {_SUMS} FROM perf_fact
  WHERE {_REPORTED} GROUP BY site_id, tag_id, seller_member_id) x),
u1 AS (SELECT *, {_IS1} AS known FROM (SELECT tag_id, seller_member_id, {_SUMS} FROM u0
  WHERE NOT known AND imps <= {q.GROW_ABOVE} GROUP BY tag_id, seller_member_id) x),
u2 AS (SELECT *, {_IS2} AS known FROM (SELECT seller_member_id, {_SUMS} FROM u1
  WHERE NOT known AND imps <= {q.GROW_ABOVE} GROUP BY seller_member_id) x),
every AS (
  SELECT 0 AS level, site_id, tag_id, seller_member_id, imps, clicks, known FROM u0
  UNION ALL SELECT 1, NULL, tag_id, seller_member_id, imps, clicks, known FROM u1
  UNION ALL SELECT 2, NULL, NULL, seller_member_id, imps, clicks, known FROM u2)
SELECT level, site_id, tag_id, seller_member_id, {_BIG}, CASE WHEN known THEN 'delete' ELSE 'grow' END AS action
FROM every WHERE (known AND imps < {q.DELETE_BELOW}) OR (NOT known AND imps > {q.GROW_ABOVE})""")

_sql("contingency", "perf_fact", """
SELECT geo_country, CAST(sum(CASE WHEN clicks > 0 THEN imps ELSE 0 END) AS BIGINT) AS weight_true,
  CAST(sum(CASE WHEN NOT clicks > 0 THEN imps ELSE 0 END) AS BIGINT) AS weight_false
FROM perf_fact GROUP BY geo_country""")

_PAIRS = f"""pairs AS (SELECT site_id, geo_country, {_SUMS} FROM perf_fact
  GROUP BY site_id, geo_country HAVING sum(imps) >= 1)"""
_sql("key_report", "perf_fact", f"""
{_PAIRS}
SELECT 'site_id_geo_country' AS keys, CAST(count(*) AS BIGINT) AS buckets,
  round(sum(clicks * (1 - CAST(clicks AS DOUBLE) / imps)), 6) AS variance,
  round(-sum(CAST(clicks AS DOUBLE) * clicks / imps), 6) AS variance_2,
  round(sum({_ent('imps', 'clicks')}), 6) AS entropy,
  CAST(trunc(sum({_ent('imps', 'clicks')})) AS BIGINT) AS entropy_int
FROM pairs""")
_sql("key_report_histogram", "perf_fact", f"""
{_PAIRS},
points AS (
  SELECT 'log_ctr' AS metric, round(log10(CAST(clicks AS DOUBLE) / imps + 1e-6), 6) AS x FROM pairs
  UNION ALL SELECT 'log_imps', round(log10(CAST(imps AS DOUBLE)), 6) FROM pairs),
ends AS (
  SELECT metric, count(*) AS n, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM points GROUP BY metric),
counted AS (
  SELECT p.metric, least(CAST(floor(round((x - lo) * 30 / (hi - lo), 6)) AS INT), 29) AS bin, count(*) AS k
  FROM points p JOIN ends e ON e.metric = p.metric
  GROUP BY p.metric, least(CAST(floor(round((x - lo) * 30 / (hi - lo), 6)) AS INT), 29))
SELECT e.metric, CAST(g.bin AS INT) AS bin, round(lo + (hi - lo) / 30 * g.bin, 6) AS bin_start,
  round(coalesce(c.k, 0) * 100.0 / e.n, 6) AS percent
FROM ends e CROSS JOIN (SELECT unnest(range(30)) AS bin) g
LEFT JOIN counted c ON c.metric = e.metric AND c.bin = g.bin""")


def _weighted_gini(given: str, feature: str) -> str:
    return f"""SELECT sum(t * (1 - ss / (t * t))) / sum(t) FROM (
    SELECT sum(x) AS t, sum(x * x) AS ss FROM (
      SELECT {given}, CAST(sum(imps) AS DOUBLE) AS x FROM perf_fact GROUP BY {given}, {feature}) c
    GROUP BY {given}) v"""


def _own_gini(feature: str) -> str:
    return f"""SELECT 1 - sum(x * x) / (sum(x) * sum(x)) FROM (
    SELECT CAST(sum(imps) AS DOUBLE) AS x FROM perf_fact GROUP BY {feature}) c"""


_sql("gini", "perf_fact", f"SELECT round(({_own_gini('campaign_id')}), 6) AS gini")
_sql("gini_weighted", "perf_fact", f"SELECT round(({_weighted_gini('site_id, tag_id', 'campaign_id')}), 6) AS gini")
_sql("impurity_matrix", "perf_fact", "\nUNION ALL\n".join(
    f"SELECT '{g}' AS given, '{f}' AS feature, "
    + ("CAST(0 AS DOUBLE)" if g == f else f"round(({_weighted_gini(g, f) if g else _own_gini(f)}), 3)")
    + " AS impurity"
    for f in q.MATRIX_FEATURES for g in (*q.MATRIX_FEATURES, "")
))

# Goal checks

_IN_TEST = "ymdh >= qt_start_time_adjusted AND ymdh <= qt_finish_time"
_CPA = f"""{_GOALS},
per_node AS (
  SELECT campaign_group_id, country_group_id, tag_id, creative_size_bucket_id, pixel_id,
    arg_min(is_passed, ymdh || is_passed) AS is_passed, CAST(sum(booked_rev) AS DOUBLE) AS spent,
    sum(post_view_convs) AS pv, sum(post_click_convs) AS pc,
    coalesce(sum(post_view_convs) FILTER (WHERE {_IN_TEST}), 0) AS pv_test,
    coalesce(sum(post_click_convs) FILTER (WHERE {_IN_TEST}), 0) AS pc_test
  FROM nodes GROUP BY campaign_group_id, country_group_id, tag_id, creative_size_bucket_id, pixel_id),
judged AS (
  SELECT is_passed = 1 AS passed,
    (pvg_threshold IS NOT NULL AND pv_test > 0) OR (pcg_threshold IS NOT NULL AND pc_test > 0) AS should_pass,
    coalesce(pv * pvg_threshold, 0) + coalesce(pc * pcg_threshold, 0) > spent AS perf_sum,
    coalesce(pv * pvg_threshold, 0) > spent OR coalesce(pc * pcg_threshold, 0) > spent AS perf_any
  FROM per_node n JOIN goals g ON g.cg_id = n.campaign_group_id AND g.goal_type = 'cpa')"""
_CTR = f"""{_GOALS},
per_node AS (
  SELECT campaign_group_id, country_group_id, tag_id, creative_size_bucket_id,
    arg_min(is_passed, ymdh || is_passed) AS is_passed, sum(imps) AS imps, sum(clicks) AS clicks,
    coalesce(sum(clicks) FILTER (WHERE {_IN_TEST}), 0) AS clicks_test
  FROM nodes GROUP BY campaign_group_id, country_group_id, tag_id, creative_size_bucket_id),
judged AS (
  SELECT is_passed = 1 AS passed, clicks_test > 0 AS should_pass, clicks > goal_threshold * imps AS perf
  FROM per_node n JOIN goals g ON g.cg_id = n.campaign_group_id AND g.goal_type = 'ctr')"""


def _matrix(name: str, row: str, col: str) -> str:
    return f"""SELECT '{name}' AS matrix, CAST(c.r AS INT) AS row, CAST(c.k AS INT) AS col, CAST(count(j.r) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(r, k)
LEFT JOIN (SELECT 1 - CAST({row} AS INT) AS r, 1 - CAST({col} AS INT) AS k FROM judged) j ON j.r = c.r AND j.k = c.k
GROUP BY c.r, c.k"""


def _check(name: str, base: str, *matrices: tuple[str, str, str]) -> None:
    _sql(name, f"nodes {_GOAL_TABLES}", base + "\n" + "\nUNION ALL\n".join(_matrix(*m) for m in matrices))


_DEF = ("definition", "passed", "should_pass")
_check("confusion_cpa_v1", _CPA, _DEF, ("performance", "perf_sum", "should_pass"))
_check("confusion_cpa_v2", _CPA, _DEF, ("performance", "perf_any", "should_pass"))
_check("confusion_ctr", _CTR, _DEF, ("performance", "perf", "should_pass"))
_check("confusion_def_cpa", _CPA, _DEF)
_check("confusion_def_ctr", _CTR, _DEF)
_check("confusion_perf_cpa", _CPA, ("performance", "passed", "perf_sum"))
_check("confusion_perf_ctr", _CTR, ("performance", "passed", "perf"))

# Text

_TERMS = r"""terms AS (SELECT tweet_id, state, term FROM (
    SELECT tweet_id, state, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM tweets) t WHERE term <> '')"""
_SCORES = f"""{_TERMS},
scored AS (SELECT tweet_id, CAST(sum(score) AS BIGINT) AS s FROM terms JOIN lexicon USING (term) GROUP BY tweet_id),
sentiments AS (SELECT t.tweet_id, t.state, coalesce(s.s, 0) AS sentiment FROM tweets t
  LEFT JOIN scored s ON s.tweet_id = t.tweet_id)"""
_STATES = """states AS (SELECT state, CAST(sum(sentiment) AS DOUBLE) / count(*) AS mean_sentiment FROM sentiments
  WHERE state IS NOT NULL GROUP BY state)"""
_sql("tweet_select", "tweets", """
SELECT CAST(tweet_id AS VARCHAR) AS created_at, text, screen_name FROM tweets WHERE lang = 'en' AND text IS NOT NULL""")
_sql("tweet_track", "tweets", """
SELECT tweet_id, lang FROM tweets
WHERE lower(text) LIKE '%the%' OR lower(text) LIKE '%aux%' OR lower(text) LIKE '%der%'""")

_sql("tweet_track_many", "tweets tracked", r"""
words AS (
  SELECT DISTINCT lower(regexp_replace(keyword, '^\s+|\s+$', '', 'g')) AS word FROM tracked
)
SELECT tweet_id, lang FROM tweets
WHERE EXISTS (SELECT 1 FROM words WHERE word <> '' AND contains(lower(text), word))""")
# Markup is taken apart by the patterns of the job, without the possessive forms that RE2 lacks. Of the references and the
# letters, those that the test pages hold are decoded.


def _pattern(java: str) -> str:
    return "'" + java.replace("++", "+").replace("*+", "*").replace("'", "''") + "'"


def _tidied(x: str, raw: bool = False) -> str:
    for reference, letter in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{reference}', '{letter}', 'g')"
    if raw:
        return x
    plain = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[''\"%]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _elements(name: str, end: str) -> str:
    cut = f"regexp_replace(x, {_pattern(end)}, '')"
    return f"""list_transform(regexp_split_to_array(page, {_pattern(pages.start_tag(name))})[2:],
    lambda x: regexp_replace({cut}, {_pattern(pages.ANY_TAG)}, '', 'g'))"""


def _attribute(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, {_pattern(pages.attribute(name))}, 1)"


def _unquoted(x: str) -> str:
    return f"""regexp_replace({x}, '^["'']|["'']$', '', 'g')"""


def _last_meta(prefix: str) -> str:
    return f"""list_filter(metas, lambda m: {_attribute('m', 'content')} <> ''
      AND starts_with(lower({_unquoted(_attribute('m', 'name'))}), '{prefix}'))[-1]"""


def _lines(texts: str) -> str:
    return f"coalesce(array_to_string({texts}, chr(10)), '')"


_NAMED = f"lambda t: trim({_tidied('t', raw=True)}, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT regexp_full_match(trim(t), '[0-9]+')"
_FEATURES = rf"""seen AS (
  SELECT page_id, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)) AS domain,
    regexp_replace(html, {_pattern(pages.UNSEEN)}, '', 'g') AS page FROM pages WHERE html IS NOT NULL),
parts AS (
  SELECT *, regexp_extract_all(page, {_pattern(pages.start_tag("meta"))}) AS metas,
    list_transform(regexp_extract_all(page, {_pattern(pages.start_tag("img"))}), lambda x: {_unquoted(_attribute("x", "alt"))}) AS alts,
    {_elements("a", pages.rest_after(["a"]))} AS links,
    {_elements("title", pages.rest_after(["title"]))} AS titles,
    {_elements("p", pages.rest_after(pages.BLOCKS, "/?"))} AS paragraphs FROM seen),
features AS (
  SELECT page_id, domain, coalesce({_tidied("titles[1]")}, '') AS title,
    coalesce({_tidied(_unquoted(_attribute(_last_meta("descr"), "content")))}, '') AS meta_description,
    list_transform(list_filter(regexp_split_to_array({_tidied(_unquoted(_attribute(_last_meta("keywords"), "content")), raw=True)}, '\s+'),
      lambda w: w <> ''), lambda w: trim(w, ',')) AS meta_keywords,
    list_transform(list_filter(links, {_NAMED}), lambda t: {_tidied("t")}) AS ref_titles,
    list_transform(list_filter(alts, {_NAMED}), lambda t: {_tidied("t")}) AS img_alt_titles,
    list_transform(paragraphs, lambda t: {_tidied("t")}) AS content FROM parts)"""
ORACLES["page_features"] = f"""WITH {_FEATURES}
SELECT page_id, domain, title, meta_description, {_lines("meta_keywords")} AS meta_keywords, {_lines("ref_titles")} AS ref_titles,
  {_lines("img_alt_titles")} AS img_alt_titles, {_lines("content")} AS content FROM features"""
ORACLES["page_anchor_counts"] = f"""WITH {_FEATURES},
terms AS (SELECT domain, unnest(flatten(list_transform(list_prepend(title, ref_titles), lambda t: string_split(lower(t), ' ')))) AS term
  FROM features)
SELECT domain, term, CAST(count(*) AS BIGINT) AS n FROM terms WHERE term <> '' GROUP BY domain, term"""
ORACLES["line_count"] = """SELECT 'tweets' AS file, CAST(count(*) AS BIGINT) AS lines FROM documents
UNION ALL SELECT 'pages', CAST(count(*) AS BIGINT) FROM pages"""
_sql("tweet_sentiment", "tweets lexicon", f"{_SCORES} SELECT tweet_id, sentiment FROM sentiments")
_sql("tweet_sentiment_phrases", "tweets phrase_lexicon", r"""
split AS (SELECT tweet_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM tweets),
terms AS (SELECT tweet_id, unnest(w) AS term FROM split UNION ALL
  SELECT tweet_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))
  FROM split WHERE len(w) > 1),
scored AS (SELECT tweet_id, CAST(sum(score) AS BIGINT) AS s FROM terms JOIN phrase_lexicon USING (term) GROUP BY tweet_id)
SELECT t.tweet_id, coalesce(s.s, 0) AS sentiment FROM tweets t LEFT JOIN scored s ON s.tweet_id = t.tweet_id""")
_sql("term_sentiment", "tweets lexicon", f"""
{_SCORES}
SELECT term, CAST(sum(sentiment) AS DOUBLE) / count(*) AS sentiment
FROM (SELECT DISTINCT tweet_id, term FROM terms WHERE term NOT IN (SELECT term FROM lexicon)) d
JOIN sentiments USING (tweet_id) GROUP BY term""")
_sql("term_frequency", "tweets", f"""
{_TERMS}
SELECT term, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM terms) AS frequency FROM terms GROUP BY term""")
_sql("state_sentiment", "tweets lexicon", f"{_SCORES}, {_STATES} SELECT * FROM states")
_sql("happiest_state", "tweets lexicon", f"""
{_SCORES}, {_STATES} SELECT * FROM states ORDER BY mean_sentiment DESC, state LIMIT 1""")
_sql("top_hashtags", "tweet_hashtags", """
SELECT hashtag, CAST(count(*) AS BIGINT) AS n FROM tweet_hashtags GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 10""")
ORACLES["top_hashtag_entities"] = ORACLES["top_hashtags"]
_sql("journaled_load", "conversions", "SELECT * FROM conversions")
# What went through storage or a stream has the rows of the plain job.
ORACLES |= {name: ORACLES[job] for name, job in {
    "stored_display_os": "agg_display_os", "stored_auction_features": "agg_auction_features",
    "stored_four_way": "agg_four_way", "stored_site_days": "site_daily_stats", "exported_day": "hourly_export_web",
    "listed_ready_hours": "ready_hours", "stream_display_os": "agg_display_os",
    "stream_conversions_seller": "agg_conversions_seller",
}.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
