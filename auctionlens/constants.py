"""Ids, code labels and thresholds whose exact value decides results."""

from __future__ import annotations

# Seller members left out of the hourly aggregates.
EXCLUDED_MEMBERS = (
    332, 865, 718, 948, 1754, 1251, 1886, 634, 1920, 1039, 326, 319, 630, 1544,
    1004, 848, 456, 95, 1979, 1739, 1974, 1656, 1318, 88, 1939, 928, 1906, 1357,
    1869, 1972, 1333, 1697, 818,
)

# Fixed value: the app-by-size job keeps this one member.
APP_SIZE_KEPT_MEMBER = 818

# Fixed value: the member never reported as a programme member.
HOUSE_MEMBER = 958

# Impression types outside the reporting metrics, and the types
# counted when line items are checked against their goals.
UNREPORTED_IMP_TYPES = (7, 9, 10, 11)
GOAL_IMP_TYPES = (5, 7, 11)

# Code labels.
IMP_TYPE_NAMES = {
    1: "Blank", 2: "PSA", 3: "Default Error", 4: "Default", 5: "Kept", 6: "Resold",
    7: "RTB", 8: "PSA Error", 9: "Ext Imp", 10: "Ext Click", 11: "FB",
}
REVENUE_TYPE_NAMES = {
    -1: "No Payment", 0: "Flat CPM", 1: "Cost plus CPM", 2: "Cost plus Margin",
    3: "CPC", 4: "CPA", 5: "Revshare", 6: "Flat Fee",
}
PREDICT_TYPE_NAMES = {
    -2: ("None", "-"),
    -1: ("Base", "Manual"),
    0: ("Learn Give-Up", "Learn Give-Up"),
    1: ("Learn", "Learn"),
    2: ("Throttled", "Optimized"),
    3: ("Optimized_0", "Optimized"),
    4: ("Biased_1", "Optimized"),
    5: ("Optimized_1", "Optimized"),
    6: ("Biased_2", "Optimized"),
    7: ("Optimized_2", "Optimized"),
    8: ("Optimized_Give_up", "Optimized Give-Up"),
    9: ("Base Give-Up", "Manual Give-Up"),
}
OPT_STATE_NAMES = {0: "Test", 1: "Pass", 2: "Fail", 3: "Suspended", 4: "Frozen", 5: "Eligible"}

# Creative sizes (width x height) that have a bucket of their own,
# and the two area limits of the large buckets.
LARGE_AREA = 90000
MEDIUM_AREA = 74000
EXACT_SIZE_BUCKETS = {7128: 4, 33782: 5, 7200: 6}

# Bucket analysis thresholds (impressions per day).
BUCKET_MIN_IMPS = 1_000_000
BUCKET_DELETE_BELOW = 500_000
BUCKET_GROW_ABOVE = 1_500_000

# 7-day impression floors of the campaign pickers.
BIG_CPA_CAMPAIGN_IMPS = 3_000_000
BIG_CAMPAIGN_IMPS = 7_000_000

# Fixed value: a site needs more performance impressions than this to be reported.
SITE_MIN_PERF_IMPS = 100
