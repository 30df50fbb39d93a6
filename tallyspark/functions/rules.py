"""Business rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.scalars import MONEY

# First band whose lower bound, a share of the quota, is reached.
QUOTA_BANDS = [
    ("Overachiever", "1.20"),
    ("On Target", "1.00"),
    ("Near Target", "0.80"),
    ("Below Target", "0.60"),
]

# Tier, least spend, least orders, least account age in days.
CUSTOMER_TIERS = [
    ("Platinum", 10000, 50, 730),
    ("Gold", 5000, 25, 365),
    ("Silver", 1000, 10, None),
]
BRONZE_SPEND, BRONZE_ORDERS = 100, 3

# Discount rate per tier, season surcharge, cap, minimum.
TIER_DISCOUNTS = {"Platinum": "0.15", "Gold": "0.10", "Silver": "0.05", "Bronze": "0.02"}
SEASON_DISCOUNT, MAX_DISCOUNT = "0.05", "0.25"
MIN_DISCOUNT_ABOVE, MIN_DISCOUNT = "50", "1"
SEASON_MONTHS = (11, 12)

# Bonus rate per performance rating.
BONUS_RATES = {"good": 0.10, "average": 0.05}

# Order status labels.
STATUS_LABELS = {1: "Pending", 2: "Shipped", 3: "Delivered", 4: "Cancelled"}

# Upper bounds in days.
SHIPPING_SPEEDS = [("Fast", 2), ("Normal", 7), ("Slow", 14)]
ENGAGEMENT = [("Active", 30), ("Warm", 90), ("Cooling", 180)]


def _rate(text: str) -> Column:
    return F.lit(text).cast("decimal(5,4)")


def first_reached(value: Column, bands, default: str) -> Column:
    """Label of the first band with value >= bound; NULL falls to the default."""
    label = F.lit(default)
    for name, bound in reversed(bands):
        label = F.when(value >= F.lit(bound), F.lit(name)).otherwise(label)
    return label


def first_within(value: Column, bands, default: str) -> Column:
    """Label of the first band with value <= bound; NULL falls to the default."""
    label = F.lit(default)
    for name, bound in reversed(bands):
        label = F.when(value <= F.lit(bound), F.lit(name)).otherwise(label)
    return label


def first_above(value: Column, bands, default: str) -> Column:
    """Label of the first band with value > bound; NULL falls to the default."""
    label = F.lit(default)
    for name, bound in reversed(bands):
        label = F.when(value > F.lit(bound), F.lit(name)).otherwise(label)
    return label


def lookup(key: Column, labels: dict, default) -> Column:
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def quota_band(revenue: Column, quota: Column) -> Column:
    """Band of the attained share, decided in decimals: revenue against the bound times the quota."""
    wanted = quota.cast("decimal(24,6)")
    label = F.lit("At Risk")
    for name, share in reversed(QUOTA_BANDS):
        bound = wanted * F.lit(share).cast("decimal(3,2)")
        reached = F.when(wanted > 0, revenue >= bound).otherwise(revenue <= bound)
        label = F.when(reached, name).otherwise(label)
    return F.when(F.coalesce(wanted, F.lit(0)) != 0, label).otherwise("No Quota")


def customer_tier(spend: Column, orders: Column, age_days: Column, scale: int = 1) -> Column:
    """Tier from spend, order count and account age; ``scale`` multiplies the spend bounds."""
    tier = F.when((spend >= BRONZE_SPEND * scale) | (orders >= BRONZE_ORDERS), "Bronze").otherwise(
        "Standard"
    )
    for name, least_spend, least_orders, least_age in reversed(CUSTOMER_TIERS):
        met = (spend >= least_spend * scale) & (orders >= least_orders)
        if least_age is not None:
            met = met & (age_days >= least_age)
        tier = F.when(met, name).otherwise(tier)
    return tier


def in_season(day: Column) -> Column:
    return F.month(day).isin(*SEASON_MONTHS)


def order_discount(amount: Column, tier: Column, season: Column) -> Column:
    """Discount in money: tier rate, season surcharge, cap, and a minimum."""
    base = F.coalesce(
        F.try_element_at(
            F.create_map(*[c for k, v in TIER_DISCOUNTS.items() for c in (F.lit(k), _rate(v))]), tier
        ),
        _rate("0"),
    )
    rate = base + F.when(season, _rate(SEASON_DISCOUNT)).otherwise(_rate("0"))
    rate = F.least(rate, _rate(MAX_DISCOUNT).cast("decimal(6,4)"))
    discount = (amount.cast(MONEY) * rate).cast(MONEY)
    floor = F.lit(MIN_DISCOUNT).cast(MONEY)
    raised = (amount > F.lit(MIN_DISCOUNT_ABOVE).cast(MONEY)) & (discount < floor)
    return F.when(raised, floor).otherwise(discount)


def bonus(salary: Column, performance: Column) -> Column:
    return salary * lookup(performance, BONUS_RATES, 0.0)


def status_label(status: Column) -> Column:
    return lookup(status, STATUS_LABELS, "Unknown")
