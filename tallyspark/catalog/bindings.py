"""How the test tables play the parts of each workload, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions.scalars import MONEY, as_money
from tallyspark.plans.commission import CommissionParams
from tallyspark.plans.facts import FactsParams
from tallyspark.plans.sales import SalesParams
from tallyspark.sources import seeds

c = F.col

# --- sales ---------------------------------------------------------------------------

SALES_PARAMS = SalesParams(
    start=dt.date(1996, 1, 1),
    end=dt.date(2000, 12, 31),
    as_of=dt.date(2001, 1, 31),
    min_amount=Decimal("1000"),
    tier_scale=100,
)


def sales_products(t):
    return t.part.select(
        c("p_partkey").alias("product_id"),
        c("p_name").alias("product_name"),
        c("p_type").alias("category_name"),
        (as_money(c("p_retailprice")) - 895).cast(MONEY).alias("unit_price"),
        c("p_size").alias("units_in_stock"),
        F.when(c("p_size") <= 40, c("p_name")).alias("description"),
        (c("p_retailprice") > 0).alias("is_active"),
        (c("p_brand") == "Brand#25").alias("is_deleted"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), c("p_size")).alias("created_date"),
    )


def sales_orders(t):
    status = F.when(c("o_orderstatus") == "F", "Cancelled").when(c("o_orderstatus") == "O", "Open")
    return t.orders.select(
        c("o_orderkey").alias("order_id"),
        c("o_custkey").alias("customer_id"),
        c("o_orderdate").cast("date").alias("order_date"),
        (as_money(c("o_totalprice")) * F.lit(Decimal("0.01"))).cast(MONEY).alias("shipping_cost"),
        status.otherwise("Processing").alias("order_status"),
    )


def sales_order_lines(t):
    pending = (c("l_returnflag") == "N") & (c("l_linestatus") == "O")
    return t.lineitem.select(
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("line_no"),
        c("l_partkey").alias("product_id"),
        c("l_quantity").cast("int").alias("quantity"),
        as_money(c("l_extendedprice")).alias("line_total"),
        F.nullif(c("l_discount").cast("decimal(5,4)"), F.lit(0).cast("decimal(5,4)")).alias("discount"),
        F.when(~pending, c("l_shipdate").cast("date")).alias("shipped_date"),
    )


def sales_customers(t):
    places = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return t.customer.join(places, c("c_nationkey") == c("n_nationkey")).select(
        c("c_custkey").alias("customer_id"),
        c("c_name").alias("customer_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.nullif(c("r_name"), F.lit("MIDDLE EAST")).alias("region"),
        F.date_add(F.lit(dt.date(1993, 1, 1)), c("c_nationkey") * 40).alias("registration_date"),
        (c("c_acctbal") > -500).alias("is_active"),
    )


_P = SALES_PARAMS
AS_OF = f"DATE '{_P.as_of}'"

SALES_SQL = f"""
    WITH active AS (
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name,
               CAST(CAST(p_retailprice AS DECIMAL(19,4)) - 895 AS DECIMAL(19,4)) AS unit_price,
               p_size AS units_in_stock,
               CASE WHEN p_size <= 40 THEN p_name ELSE 'No description' END AS description,
               CASE WHEN p_retailprice - 895 > 100 THEN 'Premium' WHEN p_retailprice - 895 > 50 THEN 'Standard'
                    WHEN p_retailprice - 895 > 10 THEN 'Budget' ELSE 'Clearance' END AS price_tier,
               {AS_OF} - (DATE '1995-01-01' + p_size) AS days_since_listed
        FROM part WHERE p_retailprice > 0 AND p_brand <> 'Brand#25' AND p_size > 0
    ), base AS (
        SELECT o_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date, product_id, product_name, category_name, price_tier,
               CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(19,4)) AS line_total,
               CAST(l_discount AS DECIMAL(5,4)) AS discount_applied,
               CAST(CAST(o_totalprice AS DECIMAL(19,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS shipping_cost,
               CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE 'Processing' END AS order_status,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN {AS_OF} ELSE CAST(l_shipdate AS DATE) END
                   - CAST(o_orderdate AS DATE) AS days_to_ship
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN active ON l_partkey = product_id
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{_P.start}' AND DATE '{_P.end}'
          AND o_orderstatus <> 'F' AND l_extendedprice >= {_P.min_amount}
    ), sales AS (
        SELECT *, CASE WHEN days_to_ship <= 2 THEN 'Fast' WHEN days_to_ship <= 7 THEN 'Normal'
                       WHEN days_to_ship <= 14 THEN 'Slow' ELSE 'Delayed' END AS shipping_speed,
               year(order_date) AS order_year, month(order_date) AS order_month,
               dayofweek(order_date) + 1 AS order_weekday
        FROM base
    )
"""

TIE_SQL = "order_id, line_no, product_id, line_total, discount_applied, days_to_ship"

PROFILE_SQL = (
    SALES_SQL
    + f""", customers AS (
        SELECT c_custkey AS customer_id, c_name AS customer_name, lower(c_name) || '@example.com' AS email,
               coalesce(nullif(r_name, 'MIDDLE EAST'), 'Unknown') AS region,
               DATE '1993-01-01' + c_nationkey * 40 AS registration_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_acctbal > -500
    ), running AS (
        SELECT *, sum(line_total) OVER (PARTITION BY customer_id ORDER BY order_date, {TIE_SQL}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total FROM sales
    ), history AS (
        SELECT customer_id, count(DISTINCT order_id) AS total_orders, sum(line_total) AS spend,
               count(*) AS line_count, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
               CAST(sum(days_to_ship) AS DOUBLE) / count(*) AS avg_days_to_ship,
               count(DISTINCT category_name) AS categories, max(running_total) AS lifetime_value
        FROM running GROUP BY customer_id
    ), profile0 AS (
        SELECT c.*, {AS_OF} - registration_date AS account_age_days, coalesce(total_orders, 0) AS total_orders,
               coalesce(spend, 0) AS spend, coalesce(CAST(spend AS DOUBLE) / line_count, 0) AS avg_order_value,
               first_order_date, last_order_date, {AS_OF} - last_order_date AS days_since_last_order,
               coalesce(avg_days_to_ship, 0) AS avg_days_to_ship, coalesce(categories, 0) AS categories, lifetime_value
        FROM customers c LEFT JOIN history h ON h.customer_id = c.customer_id
    ), profile AS (
        SELECT *, CASE WHEN spend >= 1000000 AND total_orders >= 50 AND account_age_days >= 730 THEN 'Platinum'
                       WHEN spend >= 500000 AND total_orders >= 25 AND account_age_days >= 365 THEN 'Gold'
                       WHEN spend >= 100000 AND total_orders >= 10 THEN 'Silver'
                       WHEN spend >= 10000 OR total_orders >= 3 THEN 'Bronze' ELSE 'Standard' END AS customer_tier,
               CASE WHEN days_since_last_order <= 30 THEN 'Active' WHEN days_since_last_order <= 90 THEN 'Warm'
                    WHEN days_since_last_order <= 180 THEN 'Cooling' ELSE 'Dormant' END AS engagement
        FROM profile0
    )
"""
)


def revenue_sql(by_customer_tier: bool) -> str:
    tier = "customer_tier" if by_customer_tier else "price_tier"
    return (
        PROFILE_SQL
        + f""", rated AS (
        SELECT s.*, least(CASE {tier} WHEN 'Platinum' THEN 0.15 WHEN 'Gold' THEN 0.10 WHEN 'Silver' THEN 0.05
                               WHEN 'Bronze' THEN 0.02 ELSE 0 END
                    + CASE WHEN order_month IN (11, 12) THEN 0.05 ELSE 0 END, 0.25)::DECIMAL(6,4) AS rate
        FROM sales s LEFT JOIN (SELECT customer_id AS cid, customer_tier FROM profile) ON cid = s.customer_id
    ), discounted AS (
        SELECT *, CASE WHEN line_total > 50 AND CAST(line_total * rate AS DECIMAL(19,4)) < 1
                       THEN CAST(1 AS DECIMAL(19,4)) ELSE CAST(line_total * rate AS DECIMAL(19,4)) END AS discount
        FROM rated
    ), revenue AS (
        SELECT *, line_total - discount AS net, line_total - discount - shipping_cost AS profit FROM discounted
    )
"""
    )

# --- commission ------------------------------------------------------------------------

COMMISSION_PARAMS = CommissionParams(
    start=dt.date(1995, 6, 1),
    end=dt.date(2000, 12, 31),
    min_order_amount=Decimal("5000"),
    top_sellers=10,
    threshold_scale=50,
)

# p_type plays the category (ECONOMY has none), p_brand the subcategory.
_CATEGORY = {"STANDARD": "Bikes", "LARGE": "Components", "MEDIUM": "Clothing", "SMALL": "Accessories", "PROMO": "Promo"}
_GROUP = {"AMERICA": "North America", "EUROPE": "Europe", "ASIA": "Pacific"}
ONLINE = ("1-URGENT", "2-HIGH")


def _renamed(column, labels, otherwise=None):
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for key, label in labels.items():
        out = F.when(column == key, label).otherwise(out)
    return out


def commission_territories(t):
    places = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return places.select(
        c("n_nationkey").alias("territory_id"),
        c("n_name").alias("territory_name"),
        _renamed(c("n_nationkey"), {1: "US", 6: "CA"}, c("n_name")).alias("country_code"),
        _renamed(c("r_name"), _GROUP, c("r_name")).alias("territory_group"),
    )


def commission_orders(t):
    """An order's seller is the lowest supplier key on its lines; none without lines."""
    sellers = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_suppkey").alias("seller_id")
    )
    joined = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(sellers, "o_orderkey", "left")
    total = as_money(c("o_totalprice"))
    return joined.select(
        c("o_orderkey").alias("order_id"),
        c("o_custkey").alias("customer_id"),
        "seller_id",
        c("c_nationkey").alias("territory_id"),
        c("o_orderdate").cast("date").alias("order_date"),
        total.alias("total_due"),
        c("o_orderpriority").isin(*ONLINE).alias("online"),
    )


def seller_persons(t):
    parts = F.split("s_name", "#")
    return t.supplier.select(
        c("s_suppkey").alias("person_id"),
        parts[0].alias("first_name"),
        F.when(c("s_acctbal") >= 0, parts[1]).alias("last_name"),
    )


def seller_employees(t):
    title = F.when(c("s_nationkey") < 20, F.concat(F.lit("Rep "), c("s_nationkey").cast("string")))
    return t.supplier.select(c("s_suppkey").alias("person_id"), title.alias("job_title"))


def seller_quotas(t):
    """One quota inside the period and one after it."""
    quota = F.greatest(as_money(c("s_acctbal")), F.lit(0)) * 5000
    days = F.array(F.lit(dt.date(1997, 6, 1)), F.lit(dt.date(2005, 1, 1)))
    return t.supplier.select(
        c("s_suppkey").alias("person_id"),
        F.explode(days).alias("quota_date"),
        quota.cast(MONEY).alias("sales_quota"),
    )


def customer_persons(t):
    parts = F.split("c_name", "#")
    return t.customer.where(c("c_acctbal") >= -900).select(
        c("c_custkey").alias("person_id"),
        parts[0].alias("first_name"),
        parts[1].alias("last_name"),
        F.when(c("c_mktsegment") == "BUILDING", "SC").otherwise("IN").alias("person_type"),
        F.when(c("c_mktsegment").isin("MACHINERY", "FURNITURE"), "Mr.").alias("title"),
    )


def commission_products(t):
    number = F.substring("p_brand", 7, 3).cast("int")
    bikes = F.when(number <= 8, "Mountain Bikes").when(number <= 16, "Road Bikes")
    bikes = bikes.when(number <= 22, "Touring Bikes").otherwise("Other Bikes")
    category = _renamed(c("p_type"), _CATEGORY)
    price = as_money(c("p_retailprice"))
    return t.part.select(
        c("p_partkey").alias("product_id"),
        c("p_name").alias("product_name"),
        price.alias("list_price"),
        (price * F.lit(Decimal("0.6"))).cast(MONEY).alias("standard_cost"),
        category.alias("category_name"),
        F.when(category == "Bikes", bikes).when(category.isNotNull(), c("p_brand")).alias("subcategory_name"),
    )


def commission_lines(t):
    return t.lineitem.select(
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("line_no"),
        c("l_partkey").alias("product_id"),
        c("l_quantity").cast("int").alias("order_qty"),
        (c("l_extendedprice") / c("l_quantity")).alias("unit_price"),
        c("l_discount").cast("decimal(5,4)").alias("unit_price_discount"),
        as_money(c("l_extendedprice")).alias("line_total"),
    )


def phones(t):
    return t.orders.where(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("person_id"))


def emails(t):
    return t.orders.where(c("o_orderpriority") == "2-HIGH").select(c("o_custkey").alias("person_id"))


_C = COMMISSION_PARAMS

COMMISSION_SQL = f"""
    WITH terr AS (
        SELECT n_nationkey AS territory_id, n_name AS territory_name,
               CASE n_nationkey WHEN 1 THEN 'US' WHEN 6 THEN 'CA' ELSE n_name END AS country_code,
               CASE r_name WHEN 'AMERICA' THEN 'North America' WHEN 'EUROPE' THEN 'Europe' WHEN 'ASIA' THEN 'Pacific' ELSE r_name END AS territory_group
        FROM nation JOIN region ON n_regionkey = r_regionkey
    ), sellers AS (SELECT l_orderkey, min(l_suppkey) AS seller_id FROM lineitem GROUP BY 1),
    all_orders AS (
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, seller_id, c_nationkey AS territory_id,
               CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DECIMAL(19,4)) AS total_due,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS online
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN sellers ON l_orderkey = o_orderkey
    ), base AS (
        SELECT o.*, territory_name, country_code, territory_group,
               coalesce(CASE WHEN s_acctbal >= 0 THEN replace(s_name, '#', ' ') END, 'Online/Unknown') AS seller_name,
               CASE WHEN s_nationkey < 20 THEN 'Rep ' || s_nationkey END AS seller_title,
               coalesce(greatest(CAST(s_acctbal AS DECIMAL(19,4)), 0) * 5000, 0) AS sales_quota
        FROM all_orders o JOIN terr ON terr.territory_id = o.territory_id LEFT JOIN supplier ON s_suppkey = seller_id
        WHERE order_date BETWEEN DATE '{_C.start}' AND DATE '{_C.end}' AND total_due >= {_C.min_order_amount}
    ), products AS (
        SELECT p_partkey AS product_id, p_name AS product_name, CAST(p_retailprice AS DECIMAL(19,4)) AS list_price,
               CAST(CAST(p_retailprice AS DECIMAL(19,4)) * CAST(0.6 AS DECIMAL(3,1)) AS DECIMAL(19,4)) AS standard_cost, category_name,
               CASE WHEN category_name = 'Bikes' THEN CASE WHEN n <= 8 THEN 'Mountain Bikes' WHEN n <= 16 THEN 'Road Bikes'
                         WHEN n <= 22 THEN 'Touring Bikes' ELSE 'Other Bikes' END
                    WHEN category_name IS NOT NULL THEN p_brand END AS subcategory_name
        FROM (SELECT *, CAST(substring(p_brand, 7) AS INT) AS n, CASE p_type WHEN 'STANDARD' THEN 'Bikes' WHEN 'LARGE' THEN 'Components'
              WHEN 'MEDIUM' THEN 'Clothing' WHEN 'SMALL' THEN 'Accessories' WHEN 'PROMO' THEN 'Promo' END AS category_name FROM part)
    ), all_lines AS (
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS order_qty,
               l_extendedprice / l_quantity AS unit_price, CAST(l_discount AS DECIMAL(5,4)) AS unit_price_discount,
               CAST(l_extendedprice AS DECIMAL(19,4)) AS line_total FROM lineitem
    ), lines AS (
        SELECT l.*, p.* EXCLUDE (product_id), b.* EXCLUDE (order_id), list_price - standard_cost AS gross_margin_unit
        FROM all_lines l JOIN base b ON b.order_id = l.order_id JOIN products p ON p.product_id = l.product_id
    ), tier_sums AS (
        SELECT customer_id, territory_group, sum(line_total) AS total_revenue,
               sum(CASE WHEN category_name = 'Bikes' THEN line_total ELSE 0 END) AS bike_revenue,
               sum(CASE WHEN category_name = 'Components' THEN line_total ELSE 0 END) AS comp_revenue,
               sum(CASE WHEN category_name = 'Clothing' THEN line_total ELSE 0 END) AS clothing_revenue,
               sum(CASE WHEN category_name = 'Accessories' THEN line_total ELSE 0 END) AS access_revenue,
               count(DISTINCT order_id) AS order_count
        FROM lines GROUP BY 1, 2
    ), tiers AS (
        SELECT s.*, CASE WHEN total_revenue >= g * 50 THEN 'Gold' WHEN total_revenue >= s * 50 THEN 'Silver'
                         WHEN total_revenue >= b * 50 THEN 'Bronze' ELSE 'Standard' END AS customer_tier
        FROM tier_sums s JOIN (VALUES ('North America', 50000, 20000, 5000), ('Europe', 45000, 18000, 4500),
            ('Pacific', 40000, 15000, 4000), ('AFRICA', 50000, 20000, 5000), ('MIDDLE EAST', 50000, 20000, 5000)) v(tg, g, s, b)
            ON tg = territory_group
    )
"""


def _ladder(table: list[tuple], value_column: str, default: str) -> str:
    """A CASE over (group, territory, tier), from the same fixed values."""
    whens = []
    for group, territory, *rates in table:
        test = f"{value_column} = '{group}'"
        if territory != "OTHER":
            test += f" AND territory_group = '{territory}'"
        if group == "OTHER":
            continue
        whens.append(
            f"WHEN {test} THEN CASE customer_tier WHEN 'Gold' THEN {rates[0]} WHEN 'Silver' THEN {rates[1]} "
            f"WHEN 'Bronze' THEN {rates[2]} ELSE {rates[3]} END"
        )
    return f"CASE {' '.join(whens)} ELSE {default} END"


def commission_sql() -> str:
    group = "(CASE WHEN category_name = 'Bikes' THEN subcategory_name ELSE category_name END)"
    discount = _ladder(seeds.DISCOUNT_RATES, group, "0.0")
    share = _ladder(seeds.COMMISSION_RATES, "category_name", "0.02")
    return (
        COMMISSION_SQL
        + f""", priced AS (
        SELECT l.*, customer_tier, CAST({discount} AS DECIMAL(5,4)) AS disc, CAST({share} AS DECIMAL(5,4)) AS comm,
               CAST(CASE WHEN l.territory_group = 'Europe' THEN 0.2 WHEN l.territory_group = 'Pacific' THEN 0.1
                    WHEN country_code = 'CA' THEN 0.05 END AS DECIMAL(5,4)) AS tax
        FROM lines l LEFT JOIN (SELECT customer_id AS cid, territory_group AS tg, customer_tier FROM tiers)
             ON cid = customer_id AND tg = territory_group
    ), finals AS (
        SELECT *, line_total * (1 - disc) AS adjusted, line_total * disc AS discount_amount,
               line_total * (1 - disc) * comm AS earned, line_total * (1 - disc) - standard_cost * order_qty AS margin,
               CAST(CAST(line_total * (1 - disc) - standard_cost * order_qty AS DOUBLE)
                    / CAST(line_total * (1 - disc) AS DOUBLE) AS DECIMAL(28,10)) AS margin_pct,
               line_total * (1 - disc) * tax AS estimated_tax
        FROM priced
    ), seller AS (
        SELECT seller_id, seller_name, territory_group, territory_name, count(DISTINCT order_id) AS total_orders,
               sum(line_total) AS original, sum(adjusted) AS adjusted, sum(discount_amount) AS discounts,
               sum(earned) AS earned, sum(margin) AS margin, CAST(sum(margin_pct) AS DOUBLE) / count(*) AS margin_pct,
               sum(CASE WHEN category_name = 'Bikes' THEN adjusted ELSE 0 END) AS bike_revenue,
               sum(CASE WHEN category_name = 'Components' THEN adjusted ELSE 0 END) AS comp_revenue,
               sum(CASE WHEN category_name = 'Clothing' THEN adjusted ELSE 0 END) AS clothing_revenue,
               sum(CASE WHEN category_name = 'Accessories' THEN adjusted ELSE 0 END) AS access_revenue,
               max(sales_quota) AS sales_quota
        FROM finals WHERE seller_id IS NOT NULL GROUP BY 1, 2, 3, 4
    ), seller_ranked AS (
        SELECT *, CASE WHEN sales_quota = 0 THEN 'No Quota'
                       WHEN adjusted >= 1.2 * sales_quota THEN 'Overachiever'
                       WHEN adjusted >= 1 * sales_quota THEN 'On Target'
                       WHEN adjusted >= 0.8 * sales_quota THEN 'Near Target'
                       WHEN adjusted >= 0.6 * sales_quota THEN 'Below Target' ELSE 'At Risk' END AS band,
               ntile(4) OVER (ORDER BY adjusted DESC, seller_id, territory_name) AS quartile
        FROM seller
    ), rfm_sums AS (
        SELECT customer_id, count(DISTINCT order_id) AS order_count, sum(adjusted) AS total_revenue,
               CAST(sum(adjusted) AS DOUBLE) / count(*) AS avg_line, max(order_date) AS last_day, min(order_date) AS first_day,
               sum(discount_amount) AS discounts, sum(earned) AS earned, max(customer_tier) AS customer_tier,
               max(territory_group) AS territory_group
        FROM finals GROUP BY 1
    ), rfm AS (
        SELECT s.*, DATE '{_C.end}' - last_day AS recency_days, replace(c_name, '#', ' ') AS customer_name,
               ntile(5) OVER (ORDER BY DATE '{_C.end}' - last_day, customer_id) AS r_score,
               ntile(5) OVER (ORDER BY order_count DESC, customer_id) AS f_score,
               ntile(5) OVER (ORDER BY total_revenue DESC, customer_id) AS m_score
        FROM rfm_sums s JOIN customer ON c_custkey = customer_id WHERE c_acctbal >= -900
    ), bench AS (
        SELECT territory_group, count(DISTINCT seller_id) AS seller_count, sum(adjusted) AS total,
               CAST(sum(adjusted) AS DOUBLE) / count(*) AS avg_revenue, CAST(sum(earned) AS DOUBLE) / count(*) AS avg_commission,
               avg(margin_pct) AS avg_margin, sum(bike_revenue) AS bike, sum(comp_revenue) AS comp,
               sum(clothing_revenue) AS clothing, sum(access_revenue) AS access
        FROM seller GROUP BY 1
    )
"""
    )

# --- customer facts -----------------------------------------------------------------------

FACTS_PARAMS = FactsParams(
    start=dt.date(1996, 1, 1), end=dt.date(2000, 12, 31), as_of=dt.date(2001, 3, 1), tolerance=Decimal("0.5")
)


def fact_header(t):
    total = as_money(c("o_totalprice"))

    def share(text):
        return (total * F.lit(Decimal(text))).cast(MONEY)

    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("o_orderkey").alias("order_id"),
        c("o_custkey").alias("customer_id"),
        c("c_nationkey").alias("address_id"),
        c("o_orderdate").cast("date").alias("order_date"),
        total.alias("total_due"),
        share("0.90").alias("sub_total"),
        share("0.08").alias("tax_amt"),
        share("0.02").alias("freight"),
        c("o_orderpriority").isin(*ONLINE).alias("online"),
    )


def fact_addresses(t):
    """A nation without a state falls back to its region; one has neither."""
    places = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return places.select(
        c("n_nationkey").alias("address_id"),
        F.when(c("n_regionkey") != 0, c("n_name")).alias("state"),
        F.when(c("n_nationkey") != 0, c("r_name")).alias("country"),
    )


def fact_order_lines(t):
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    each = F.call_function("div", cents * 100, c("l_quantity").cast("bigint"))
    return t.lineitem.select(
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("line_no"),
        c("l_partkey").alias("product_id"),
        c("l_quantity").cast("int").alias("order_qty"),
        (each.cast("decimal(15,0)") * F.lit(Decimal("0.0001"))).cast(MONEY).alias("unit_price"),
        c("l_discount").cast("decimal(5,4)").alias("unit_price_discount"),
        as_money(c("l_extendedprice")).alias("line_total"),
    )


def fact_products(t):
    return t.part.select(
        c("p_partkey").alias("product_id"), c("p_name").alias("product_name"), c("p_type").alias("category_name")
    )


def fact_customers(t):
    parts = F.split("c_name", "#")
    return t.customer.select(
        c("c_custkey").alias("customer_id"), parts[0].alias("first_name"), parts[1].alias("last_name")
    )


_F = FACTS_PARAMS

FACTS_SQL = f"""
    WITH orders0 AS (
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_totalprice AS DECIMAL(19,4)) AS total_due,
               CAST(CAST(o_totalprice AS DECIMAL(19,4)) * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS sub_total,
               CAST(CAST(o_totalprice AS DECIMAL(19,4)) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS tax_amt,
               CAST(CAST(o_totalprice AS DECIMAL(19,4)) * CAST(0.02 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS freight,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS online,
               coalesce(CASE WHEN n_regionkey <> 0 THEN n_name END, CASE WHEN n_nationkey <> 0 THEN r_name END, 'Unknown Region') AS region_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{_F.start}' AND DATE '{_F.end}'
    ), lines0 AS (
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS order_qty,
               CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 // CAST(l_quantity AS BIGINT) AS DECIMAL(15,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(19,4)) AS unit_price,
               CAST(l_discount AS DECIMAL(5,4)) AS unit_price_discount, CAST(l_extendedprice AS DECIMAL(19,4)) AS line_total,
               o.customer_id, p_name AS product_name, p_type AS category_name
        FROM lineitem JOIN orders0 o ON o.order_id = l_orderkey JOIN part ON p_partkey = l_partkey
    ), a AS (
        SELECT customer_id, count(*) AS order_count, sum(total_due) AS revenue_a, sum(sub_total) AS sub_total_a, sum(tax_amt) AS tax_a,
               sum(freight) AS freight_a, count(*) FILTER (WHERE online) AS online_orders, count(*) FILTER (WHERE NOT online) AS offline_orders,
               min(order_date) AS first_day, max(order_date) AS last_day, max(region_name) AS region_name
        FROM orders0 GROUP BY 1
    ), per_order AS (
        SELECT customer_id, order_id, sum(line_total) AS total, sum(unit_price * order_qty * unit_price_discount) AS discount, count(*) AS lines,
               sum(order_qty) AS qty, count(DISTINCT product_id) AS products, count(DISTINCT category_name) AS categories
        FROM lines0 GROUP BY 1, 2
    ), b AS (
        SELECT customer_id, sum(total) AS revenue_b, sum(discount) AS discount_b, CAST(sum(lines) AS BIGINT) AS total_lines,
               CAST(sum(qty) AS BIGINT) AS total_qty, CAST(sum(products) AS BIGINT) AS products, CAST(sum(categories) AS BIGINT) AS categories
        FROM per_order GROUP BY 1
    ), facts AS (
        SELECT a.*, replace(c_name, '#', ' ') AS customer_name, b.* EXCLUDE (customer_id),
               CAST(revenue_a AS DOUBLE) / order_count AS avg_order_value, DATE '{_F.as_of}' - last_day AS recency_days,
               last_day - first_day AS tenure_days, abs(revenue_a - coalesce(revenue_b, 0)) AS delta,
               CAST(abs(revenue_a - coalesce(revenue_b, 0)) AS DOUBLE) / nullif(CAST(revenue_a AS DOUBLE), 0) AS pct_delta
        FROM a JOIN customer ON c_custkey = a.customer_id LEFT JOIN b ON b.customer_id = a.customer_id
    ), scored AS (
        SELECT *, r_score + f_score + m_score AS rfm FROM (
            SELECT *, ntile(5) OVER (ORDER BY recency_days, customer_id) AS r_score,
                   ntile(5) OVER (ORDER BY order_count DESC, customer_id) AS f_score,
                   ntile(5) OVER (ORDER BY revenue_a DESC, customer_id) AS m_score FROM facts)
    ), bench AS (
        SELECT region_name, CAST(sum(revenue_a) AS DOUBLE) / count(*) AS avg_revenue, CAST(sum(order_count) AS DOUBLE) / count(*) AS avg_orders,
               CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency, CAST(sum(rfm) AS DOUBLE) / count(*) AS avg_rfm
        FROM scored GROUP BY 1
    )
"""

FACT_COLUMNS = """
    customer_id, customer_name, region_name, CAST(first_day AS VARCHAR) AS first_order_date, CAST(last_day AS VARCHAR) AS last_order_date,
    order_count, online_orders AS online_order_count, offline_orders AS offline_order_count, CAST(revenue_a AS DOUBLE) AS total_revenue_path_a,
    CAST(revenue_b AS DOUBLE) AS total_revenue_path_b, CAST(freight_a AS DOUBLE) AS total_freight, CAST(tax_a AS DOUBLE) AS total_tax,
    avg_order_value, CAST(round(discount_b, 4) AS DOUBLE) AS total_discount_path_b, total_lines, total_qty, products AS distinct_products,
    categories AS distinct_categories, CAST(recency_days AS BIGINT) AS recency_days, CAST(tenure_days AS BIGINT) AS customer_tenure_days,
    CAST(delta AS DOUBLE) AS revenue_delta_ab, pct_delta AS revenue_pct_delta_ab
"""
