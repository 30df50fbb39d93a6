"""Reference tables kept as data: pricing rules, rates, thresholds, quality rules."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

TIERS = ("Gold", "Silver", "Bronze", "Standard")
OTHER = "OTHER"

# The 37 pricing rules. Columns: category, subcategory (None = any),
# territory group, tier, discount, commission, tax override (None = no override).
# All are in force from RULES_FROM with no end.
RULES_FROM = dt.date(2019, 1, 1)
PRICING_RULES = [
    ("Bikes", "Mountain Bikes", "North America", "Gold", "0.1200", "0.0500", None),
    ("Bikes", "Mountain Bikes", "North America", "Silver", "0.0800", "0.0450", None),
    ("Bikes", "Mountain Bikes", "North America", "Bronze", "0.0500", "0.0400", None),
    ("Bikes", "Mountain Bikes", "North America", "Standard", "0.0000", "0.0350", None),
    ("Bikes", "Mountain Bikes", "Europe", "Gold", "0.1300", "0.0520", "0.2000"),
    ("Bikes", "Mountain Bikes", "Europe", "Silver", "0.0900", "0.0470", "0.2000"),
    ("Bikes", "Mountain Bikes", "Europe", "Bronze", "0.0600", "0.0420", "0.2000"),
    ("Bikes", "Mountain Bikes", "Europe", "Standard", "0.0100", "0.0370", "0.2000"),
    ("Bikes", "Mountain Bikes", "Pacific", "Gold", "0.1100", "0.0480", "0.1000"),
    ("Bikes", "Mountain Bikes", "Pacific", "Silver", "0.0750", "0.0430", "0.1000"),
    ("Bikes", "Road Bikes", "North America", "Gold", "0.1150", "0.0510", None),
    ("Bikes", "Road Bikes", "North America", "Silver", "0.0780", "0.0460", None),
    ("Bikes", "Road Bikes", "North America", "Bronze", "0.0480", "0.0410", None),
    ("Bikes", "Road Bikes", "North America", "Standard", "0.0000", "0.0360", None),
    ("Bikes", "Road Bikes", "Europe", "Gold", "0.1250", "0.0530", "0.2000"),
    ("Bikes", "Road Bikes", "Europe", "Silver", "0.0850", "0.0480", "0.2000"),
    ("Bikes", "Road Bikes", "Pacific", "Gold", "0.1050", "0.0490", "0.1000"),
    ("Bikes", "Touring Bikes", "North America", "Gold", "0.1100", "0.0500", None),
    ("Bikes", "Touring Bikes", "Europe", "Gold", "0.1200", "0.0520", "0.2000"),
    ("Components", None, "North America", "Gold", "0.0800", "0.0300", None),
    ("Components", None, "North America", "Silver", "0.0600", "0.0280", None),
    ("Components", None, "North America", "Bronze", "0.0400", "0.0260", None),
    ("Components", None, "North America", "Standard", "0.0000", "0.0240", None),
    ("Components", None, "Europe", "Gold", "0.0850", "0.0320", "0.2000"),
    ("Components", None, "Europe", "Silver", "0.0650", "0.0300", "0.2000"),
    ("Clothing", None, "North America", "Gold", "0.1500", "0.0200", None),
    ("Clothing", None, "North America", "Silver", "0.1000", "0.0180", None),
    ("Clothing", None, "North America", "Bronze", "0.0700", "0.0160", None),
    ("Clothing", None, "North America", "Standard", "0.0200", "0.0140", None),
    ("Clothing", None, "Europe", "Gold", "0.1600", "0.0220", "0.2000"),
    ("Clothing", None, "Europe", "Silver", "0.1100", "0.0200", "0.2000"),
    ("Accessories", None, "North America", "Gold", "0.1000", "0.0250", None),
    ("Accessories", None, "North America", "Silver", "0.0700", "0.0230", None),
    ("Accessories", None, "North America", "Bronze", "0.0500", "0.0210", None),
    ("Accessories", None, "North America", "Standard", "0.0000", "0.0190", None),
    ("Accessories", None, "Europe", "Gold", "0.1050", "0.0270", "0.2000"),
    ("Accessories", None, "Pacific", "Gold", "0.0950", "0.0260", "0.1000"),
]

# Least revenue for Gold, Silver, Bronze per territory group.
TIER_THRESHOLDS = [
    ("North America", "50000", "20000", "5000"),
    ("Europe", "45000", "18000", "4500"),
    ("Pacific", "40000", "15000", "4000"),
    ("OTHER", "50000", "20000", "5000"),
]

# Discount rate for Gold, Silver, Bronze and Standard customers.
# A product group that is not listed gets no discount.
DISCOUNT_RATES = [
    ("Mountain Bikes", "North America", "0.1200", "0.0800", "0.0500", "0.0000"),
    ("Mountain Bikes", "Europe", "0.1300", "0.0900", "0.0600", "0.0100"),
    ("Mountain Bikes", "Pacific", "0.1100", "0.0750", "0.0500", "0.0000"),
    ("Mountain Bikes", "OTHER", "0.0000", "0.0000", "0.0000", "0.0000"),
    ("Road Bikes", "North America", "0.1150", "0.0780", "0.0480", "0.0000"),
    ("Road Bikes", "Europe", "0.1250", "0.0850", "0.0600", "0.0100"),
    ("Road Bikes", "Pacific", "0.1050", "0.0720", "0.0470", "0.0000"),
    ("Road Bikes", "OTHER", "0.0000", "0.0000", "0.0000", "0.0000"),
    ("Touring Bikes", "North America", "0.1100", "0.0750", "0.0460", "0.0000"),
    ("Touring Bikes", "Europe", "0.1200", "0.0830", "0.0560", "0.0080"),
    ("Touring Bikes", "OTHER", "0.1000", "0.0700", "0.0000", "0.0000"),
    ("Components", "North America", "0.0800", "0.0600", "0.0400", "0.0000"),
    ("Components", "Europe", "0.0850", "0.0650", "0.0430", "0.0050"),
    ("Components", "Pacific", "0.0780", "0.0580", "0.0380", "0.0000"),
    ("Components", "OTHER", "0.0000", "0.0000", "0.0000", "0.0000"),
    ("Clothing", "North America", "0.1500", "0.1000", "0.0700", "0.0200"),
    ("Clothing", "Europe", "0.1600", "0.1100", "0.0780", "0.0250"),
    ("Clothing", "Pacific", "0.1400", "0.0950", "0.0660", "0.0180"),
    ("Clothing", "OTHER", "0.1300", "0.0900", "0.0150", "0.0150"),
    ("Accessories", "North America", "0.1000", "0.0700", "0.0500", "0.0000"),
    ("Accessories", "Europe", "0.1050", "0.0730", "0.0520", "0.0000"),
    ("Accessories", "Pacific", "0.0950", "0.0680", "0.0480", "0.0000"),
    ("Accessories", "OTHER", "0.0000", "0.0000", "0.0000", "0.0000"),
]

# Commission rate for Gold, Silver, Bronze and Standard customers.
COMMISSION_RATES = [
    ("Bikes", "North America", "0.0500", "0.0450", "0.0400", "0.0350"),
    ("Bikes", "Europe", "0.0520", "0.0470", "0.0420", "0.0370"),
    ("Bikes", "Pacific", "0.0480", "0.0430", "0.0380", "0.0330"),
    ("Bikes", "OTHER", "0.0350", "0.0350", "0.0350", "0.0350"),
    ("Components", "North America", "0.0300", "0.0280", "0.0260", "0.0240"),
    ("Components", "Europe", "0.0320", "0.0300", "0.0278", "0.0255"),
    ("Components", "OTHER", "0.0290", "0.0235", "0.0235", "0.0235"),
    ("Clothing", "North America", "0.0200", "0.0180", "0.0160", "0.0140"),
    ("Clothing", "Europe", "0.0220", "0.0200", "0.0175", "0.0150"),
    ("Clothing", "OTHER", "0.0195", "0.0130", "0.0130", "0.0130"),
    ("Accessories", "North America", "0.0250", "0.0230", "0.0210", "0.0190"),
    ("Accessories", "Europe", "0.0270", "0.0248", "0.0225", "0.0200"),
    ("Accessories", "OTHER", "0.0240", "0.0185", "0.0185", "0.0185"),
    ("OTHER", "OTHER", "0.0200", "0.0200", "0.0200", "0.0200"),
]

# Tax override by territory group, else by country.
TERRITORY_TAX = {"Europe": "0.2000", "Pacific": "0.1000"}
COUNTRY_TAX = {"CA": "0.0500"}

TERRITORIES = ("North America", "Europe", "Pacific", OTHER)
BIKE_GROUPS = ("Mountain Bikes", "Road Bikes", "Touring Bikes")


def _decimal(cell: str | None) -> Decimal | None:
    return None if cell is None else Decimal(cell)


def pricing_rules(spark: SparkSession, effective: dt.date = RULES_FROM) -> DataFrame:
    """The pricing rules, numbered from 1; a fixed table of 37 rows."""
    rows = [
        (i, cat, sub, group, tier, _decimal(disc), _decimal(comm), _decimal(tax), effective, None)
        for i, (cat, sub, group, tier, disc, comm, tax) in enumerate(PRICING_RULES, start=1)
    ]
    schema = (
        "rule_id int, category_name string, subcategory_name string, territory_group string, "
        "customer_tier string, discount_pct decimal(5,4), commission_pct decimal(5,4), "
        "tax_override_pct decimal(5,4), effective_date date, expiry_date date"
    )
    return spark.createDataFrame(rows, schema)


def tier_thresholds(spark: SparkSession, scale: int = 1) -> DataFrame:
    """Least revenue per tier and territory group, times ``scale``; 4 rows."""
    rows = [
        (territory, *[Decimal(bound) * scale for bound in bounds])
        for territory, *bounds in TIER_THRESHOLDS
    ]
    schema = "territory_key string, gold decimal(19,4), silver decimal(19,4), bronze decimal(19,4)"
    return spark.createDataFrame(rows, schema)


def _by_key(rows: list[tuple]) -> dict[tuple[str, str], list[str]]:
    return {(group, territory): rates for group, territory, *rates in rows}


def rate_table(spark: SparkSession) -> DataFrame:
    """Discount and commission per product group, territory and tier.

    Every combination is present (8 x 4 x 4 rows), so pricing is one
    broadcast join on three keys. A territory that is not listed for a group
    takes that group's OTHER row.
    """
    discounts, commissions = _by_key(DISCOUNT_RATES), _by_key(COMMISSION_RATES)
    none = ["0.0000"] * len(TIERS)

    def find(rates, group, territory, missing):
        return rates.get((group, territory)) or rates.get((group, OTHER)) or missing

    rows = []
    for group in (*BIKE_GROUPS, "Bikes", "Components", "Clothing", "Accessories", OTHER):
        category = "Bikes" if group in BIKE_GROUPS else group
        for territory in TERRITORIES:
            discount = find(discounts, group, territory, none)
            commission = find(commissions, category, territory, commissions[(OTHER, OTHER)])
            for tier, off, share in zip(TIERS, discount, commission):
                rows.append((group, territory, tier, Decimal(off), Decimal(share)))
    schema = (
        "rate_group string, territory_key string, tier_key string, "
        "applied_discount_pct decimal(5,4), applied_commission_pct decimal(5,4)"
    )
    return spark.createDataFrame(rows, schema)


# Rule groups as (name, first id, last id, predicate over customer facts).
QUALITY_GROUPS = [
    ("Nulls", 1, 100, "customer_id IS NULL"),
    ("Ranges", 101, 200, "total_revenue_path_a < 0 OR avg_order_value < 0"),
    (
        "Reconcile",
        201,
        260,
        "abs(coalesce(total_revenue_path_a, 0) - coalesce(total_revenue_path_b, 0)) "
        "> coalesce(total_revenue_path_a, 0) * 0.01",
    ),
]


def quality_severity(rule_id: int) -> int:
    """Severity follows the id: every 25th rule is 1, every 9th is 2, the rest 3."""
    if rule_id % 25 == 0:
        return 1
    return 2 if rule_id % 9 == 0 else 3


def quality_rules(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """The 260 quality rules in id order, or the first ``limit`` of them."""
    rows = [
        (i, group, f"QC_{i:04d}", quality_severity(i), predicate)
        for group, first, last, predicate in QUALITY_GROUPS
        for i in range(first, last + 1)
    ]
    schema = "qc_id int, check_group string, check_name string, severity smallint, predicate string"
    return spark.createDataFrame(rows[:limit], schema)
