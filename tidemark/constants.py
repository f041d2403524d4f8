"""Business constants of the warehouse.

Fixed values: they must be equal everywhere a number is compared, so they are
listed once, plainly, in this module.
"""

from __future__ import annotations

# --- event vocabulary -------------------------------------------------------
VIEW = "view"
CART = "cart"
REMOVE = "remove_from_cart"
PURCHASE = "purchase"
EVENT_TYPES = (VIEW, CART, REMOVE, PURCHASE)

# two source rows with equal values in these columns are the same event
DEDUP_KEYS = ("user_id", "event_time", "product_id", "event_type")

PARTITION_COLUMN = "event_date"

# --- dirty reasons, in order of precedence ----------------------------------
NULL_KEY = "null_key"
INVALID_EVENT_TYPE = "invalid_event_type"
NEGATIVE_PRICE = "negative_price"

# --- labels stored in tables; English is the default ------------------------
BEHAVIOR_EN = {
    "view": "view",
    "cart": "add to cart",
    "remove_from_cart": "remove from cart",
    "purchase": "purchase",
}
BEHAVIOR_ZH = {
    "view": "浏览",
    "cart": "加购",
    "remove_from_cart": "移出购物车",
    "purchase": "购买",
}

# (last hour of the bucket, label)
TIME_BUCKETS_EN = ((6, "night(0-6)"), (12, "morning(7-12)"), (18, "afternoon(13-18)"), (23, "evening(19-23)"))
TIME_BUCKETS_ZH = ((6, "凌晨(0-6)"), (12, "上午(7-12)"), (18, "下午(13-18)"), (23, "晚间(19-23)"))

# segment by (money good, frequency good, recency good)
RFM_SEGMENTS_EN = {
    (1, 1, 1): "key value",
    (1, 1, 0): "key keep",
    (1, 0, 1): "key develop",
    (1, 0, 0): "key win-back",
    (0, 1, 1): "general value",
    (0, 1, 0): "general keep",
    (0, 0, 1): "general develop",
    (0, 0, 0): "general win-back",
}
RFM_SEGMENTS_ZH = {
    (1, 1, 1): "重要价值客户",
    (1, 1, 0): "重要保持客户",
    (1, 0, 1): "重要发展客户",
    (1, 0, 0): "重要挽留客户",
    (0, 1, 1): "一般价值客户",
    (0, 1, 0): "一般保持客户",
    (0, 0, 1): "一般发展客户",
    (0, 0, 0): "一般挽留客户",
}

# --- report parameters ------------------------------------------------------
HOT_RANK_SIZE = 100
RETENTION_OFFSETS = (1, 3, 7)
RECENCY_DAYS = 30
OPEN_END = "9999-12-31"

# --- quality thresholds -----------------------------------------------------
VOLUME_DAYS = 7
VOLUME_WARN = 0.50
VOLUME_DROP_BLOCK = 0.50
NULL_RATE_MAX = 0.001
BAD_PRICE_RATE_MAX = 0.01
GMV_DAYS = 7
GMV_WARN = 0.30
GMV_DROP_BLOCK = 0.50
MONEY_TOLERANCE = 0.01

# --- skewed aggregation -----------------------------------------------------
SALT_BUCKETS = 64
