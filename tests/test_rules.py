"""Edge rows that the tables cannot show."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions import scalars as S
from tallyspark.operators import changes, graph, joins, quality, topn
from tallyspark.plans import commission, corpus, facts, people, sales
from tallyspark.sources import seeds

c, D = F.col, Decimal


def values(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (0,)], "x int")
    assert [r[0] for r in df.orderBy(F.asc_nulls_first("x")).collect()] == [None, 0, 1]
    assert [r[0] for r in df.orderBy(F.desc_nulls_last("x")).collect()] == [1, 0, None]


def test_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    assert left.join(right, c("a") == c("b")).count() == 1
    assert left.join(right, c("a").eqNullSafe(c("b"))).count() == 2


def test_three_valued_flag(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert df.where(S.flag_not_set(c("x"), keep_null=True)).count() == 2
    assert df.where(S.flag_not_set(c("x"), keep_null=False)).count() == 1


@pytest.mark.parametrize(
    "text, strict, loose",
    [
        ("1, 2,x,,-3,1.5,99999999999", [1, 2, -3], [1, 2, -3]),
        ("4;5\n6,,", [], [4, 5, 6]),
        ("+5, 05 ,2147483647,2147483648", [5, 5, 2147483647], [5, 5, 2147483647]),
        ("", [], []),
        (None, [], []),
    ],
)
def test_split_csv_int(spark, text, strict, loose):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(S.split_csv_int(c("t")), S.split_csv_int(c("t"), extra_separators=True)).first()
    assert [row[0], row[1]] == [strict, loose]


def test_dates(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 31), dt.date(2024, 3, 1)), (dt.date(2023, 12, 31), dt.date(2024, 1, 1))],
        "a date, b date",
    )
    found = [tuple(r) for r in df.select(S.months_crossed(c("a"), c("b")), S.years_crossed(c("a"), c("b"))).collect()]
    assert found == [(2, 0), (1, 1)]
    texts = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), (None,)], "t string")
    assert [r[0] for r in texts.select(S.is_date(c("t"))).collect()] == [False, True, False]


def test_text(spark):
    row = (
        spark.createDataFrame([("A", None, "ab  ", "a.b")], "a string, n string, s string, d string")
        .select(
            F.concat("a", F.lit(" "), "n"),
            S.concat_null_as_empty(c("a"), F.lit(" "), c("n")),
            S.text_length(c("s")),
            F.replace("d", F.lit("."), F.lit("x")),
            S.stuff(c("d"), 2, 1, "--"),
            S.stuff(c("d"), 9, 1, "--"),
            S.pattern_position("[.]", c("d")),
            S.currency(F.lit(1234.5)),
        )
        .first()
    )
    assert tuple(row) == (None, "A ", 2, "axb", "a--b", None, 2, "USD 1,234.50")


def test_email(spark):
    df = spark.createDataFrame([("a.b@x.org",), ("no-at",), ("a@b",), (" a@b.c",)], "e string")
    assert [r[0] for r in df.select(S.is_email(c("e"))).collect()] == [True, False, False, False]


def test_quota_bands(spark):
    df = spark.createDataFrame(
        [(1, 0), (1, None), (120, 100), (100, 100), (80, 100), (60, 100), (59, 100)], "r int, q int"
    )
    assert [r[0] for r in df.select(rules.quota_band(c("r"), c("q"))).collect()] == [
        "No Quota", "No Quota", "Overachiever", "On Target", "Near Target", "Below Target", "At Risk",
    ]


def test_bands_and_tolerance_are_decided_in_decimals(spark):
    df = spark.createDataFrame(
        [(D("4.02"), D("3.35")), (D("4.0199"), D("3.35")), (D("-1.20"), D("-1.00")), (None, D(1))],
        "r decimal(19,4), q decimal(19,4)",
    )
    assert [r[0] for r in df.select(rules.quota_band(c("r"), c("q"))).collect()] == [
        "Overachiever", "On Target", "Overachiever", "At Risk",
    ]
    pairs = spark.createDataFrame(
        [(D("3.35"), D("0.0335")), (D("3.35"), D("0.0336")), (D(0), D(0)), (None, D(1)), (D(-5), D(1))],
        "total_revenue_path_a decimal(19,4), revenue_delta_ab decimal(19,4)",
    )
    assert [r[0] for r in pairs.select(facts.paths_agree(D("0.01"))).collect()] == [1, 0, 0, 0, 1]


def test_discounts(spark):
    df = spark.createDataFrame(
        [(D(60), "Silver", False), (D(60), "Standard", False), (D(50), "Standard", False), (D(100), "Platinum", True)],
        "a decimal(19,4), t string, s boolean",
    )
    found = [r[0] for r in df.select(rules.order_discount(c("a"), c("t"), c("s"))).collect()]
    assert found == [D(3), D(1), D(0), D(20)]


def test_customer_tier_ladder(spark):
    df = spark.createDataFrame(
        [(10000, 50, 730), (10000, 50, 729), (1000, 10, 0), (100, 0, 0), (0, 3, 0), (99, 2, 0)],
        "s int, o int, a int",
    )
    assert [r[0] for r in df.select(rules.customer_tier(c("s"), c("o"), c("a"))).collect()] == [
        "Platinum", "Gold", "Silver", "Bronze", "Bronze", "Standard",
    ]


def _tier_lines(spark, rows):
    return spark.createDataFrame(
        rows, "customer_id int, territory_group string, order_id int, category_name string, line_total decimal(19,4)"
    )


def test_tier_thresholds(spark):
    lines = _tier_lines(
        spark,
        [
            (1, "North America", 1, "Bikes", D(50000)),
            (2, "North America", 2, "Bikes", D("49999.99")),
            (3, "Europe", 3, None, D(45000)),
            (4, "Pacific", 4, "Clothing", D(40000)),
            (5, "Elsewhere", 5, "Clothing", D(5000)),
            (6, None, 6, "Clothing", D("4999")),
        ],
    )
    tiers = commission.customer_tiers(lines)
    assert values(tiers, "customer_id", "customer_tier") == [
        (1, "Gold"), (2, "Silver"), (3, "Gold"), (4, "Gold"), (5, "Bronze"), (6, "Standard"),
    ]


def test_rate_table(spark):
    rates = {tuple(r[:3]): (r[3], r[4]) for r in seeds.rate_table(spark).collect()}
    assert len(rates) == 128
    assert rates["Mountain Bikes", "Europe", "Standard"] == (D("0.0100"), D("0.0370"))
    assert rates["Touring Bikes", "Pacific", "Gold"] == (D("0.1000"), D("0.0480"))
    assert rates["Bikes", "Europe", "Gold"] == (D("0.0000"), D("0.0520"))
    assert rates["Clothing", "OTHER", "Silver"] == (D("0.0900"), D("0.0130"))
    assert rates["OTHER", "Europe", "Gold"] == (D("0.0000"), D("0.0200"))


def test_overlapping_rules(spark):
    line = spark.createDataFrame(
        [("Components", "Any", "North America", "Silver", dt.date(2020, 1, 1))],
        "category string, sub string, territory string, tier string, day date",
    )
    pricing = seeds.pricing_rules(spark)
    assert pricing.count() == 37
    keys = [("category", "category_name"), ("territory", "territory_group")]
    assert joins.join_effective_date(line, pricing, keys, "day").count() == 4
    best = joins.best_rule_per_day(
        line, pricing, keys, [("sub", "subcategory_name"), ("tier", "customer_tier")], "day", ["discount_pct"]
    )
    assert values(best, "discount_pct") == [(D("0.0600"),)]
    early = line.withColumn("day", F.lit(dt.date(2018, 12, 31)))
    none = joins.best_rule_per_day(
        early, pricing, keys, [("sub", "subcategory_name"), ("tier", "customer_tier")], "day", ["discount_pct"]
    )
    assert values(none, "rule_id") == [(None,)]


def test_best_rule_prefers_specific_then_newest(spark):
    line = spark.createDataFrame([("A", "x", dt.date(2021, 1, 1))], "k string, s string, day date")
    rules_ = spark.createDataFrame(
        [
            (1, "A", None, dt.date(2020, 12, 1), None, 1),
            (2, "A", "x", dt.date(2019, 1, 1), None, 2),
            (3, "A", "x", dt.date(2020, 1, 1), None, 3),
            (4, "A", "x", dt.date(2020, 6, 1), dt.date(2020, 12, 31), 4),
        ],
        "rule_id int, rk string, rs string, effective_date date, expiry_date date, pct int",
    )
    best = joins.best_rule_per_day(line, rules_, [("k", "rk")], [("s", "rs")], "day", ["pct"])
    assert values(best, "rule_id", "pct") == [(3, 3)]


def test_violations(spark):
    lines = spark.createDataFrame(
        [
            (1, 1, 1, D("0.2"), 5.0, D(10), 1),
            (1, 2, 1, D("-0.1"), 5.0, D(10), 1),
            (1, 3, 1, D("0"), 0.0, D(10), 1),
            (1, 4, 1, D("0"), 5.0, D(-1), 1),
            (1, 5, 1, D("0"), 5.0, D(10), 0),
            (1, 6, 1, D("-0.1"), 0.0, D(-1), 0),
            (1, 7, 1, D("0.02"), 5.0, D(10), 1),
        ],
        "order_id int, line_no int, product_id int, unit_price_discount decimal(5,4), unit_price double, "
        "line_total decimal(19,4), order_qty int",
    )
    orders = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1)], "order_id int, order_date date, territory_id int")
    territories = spark.createDataFrame([(1, "Nowhere")], "territory_id int, territory_group string")
    products = spark.createDataFrame([(1, "Bikes")], "product_id int, category_name string")
    day = dt.date(2020, 1, 1)
    found = commission.audit_violations(lines, orders, territories, products, seeds.pricing_rules(spark), day, day)
    assert values(found, "line_no", "violation_type", "severity") == [
        (1, "OVER_DISCOUNT", 3), (2, "NEGATIVE_DISCOUNT", 3), (3, "ZERO_PRICE", 3),
        (4, "NEGATIVE_LINE_TOTAL", 2), (5, "ZERO_QTY", 2), (6, "NEGATIVE_DISCOUNT", 3),
    ]
    assert tuple(commission.audit_status(found).first()) == (6, "WARN", "Violations found: 6")
    assert commission.audit_status(found.where("severity > 3")).first()["status"] == "OK"


def test_tier_override(spark):
    customers = spark.createDataFrame(
        [(1, "Standard"), (2, "Bronze"), (3, "Silver"), (4, "Gold"), (5, "Gold"), (6, "Bronze")],
        "customer_id int, customer_tier string",
    )
    persons = spark.createDataFrame(
        [(1, "IN", None), (2, "SC", None), (3, "IN", "Dr."), (4, "IN", None)],
        "person_id int, person_type string, title string",
    )
    phones = spark.createDataFrame([(i,) for i in [1, 1, 1, 2, 2, 5, 6, 6]], "person_id int")
    emails = spark.createDataFrame([(i,) for i in [1, 1, 3, 3, 3]], "person_id int")
    found = commission.tier_override(customers, persons, phones, emails)
    assert values(found, "customer_id", "resolved_tier") == [
        (1, "Bronze"), (2, "Silver"), (3, "Gold"), (4, "Silver"), (5, "Gold"), (6, "Bronze"),
    ]


def test_customer_list(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "customer_id bigint")
    assert values(commission.chosen_customers(orders, "1, 3,3,x"), "customer_id") == [(1,), (3,)]
    assert commission.chosen_customers(orders, "x,,").count() == 3
    assert values(commission.chosen_customers(orders, "1;2", loose=True), "customer_id") == [(1,), (2,)]


def test_reconcile(spark):
    df = spark.createDataFrame([(0.0,), (0.02,), (None,), (1.0,)], "p double")
    found = [r[0] for r in df.select(facts.within_tolerance(c("p"), D("0.01"))).collect()]
    assert found == [1, 0, 0, 0]


def _fact_frames(spark):
    orders = spark.createDataFrame(
        [(1, 7, dt.date(2020, 1, 1), D(100), D(90), D(8), D(2), True, "R"),
         (2, 7, dt.date(2020, 2, 1), D(50), D(45), D(4), D(1), False, "R"),
         (3, 8, dt.date(2020, 3, 1), D(0), D(0), D(0), D(0), False, "Q")],
        "order_id int, customer_id int, order_date date, total_due decimal(19,4), sub_total decimal(19,4), "
        "tax_amt decimal(19,4), freight decimal(19,4), online boolean, region_name string",
    )
    lines = spark.createDataFrame(
        [(1, 7, 1, "a", 2, D(10), D("0.1"), D(60)), (1, 7, 1, "a", 1, D(10), D(0), D(40)),
         (2, 7, 1, "a", 1, D(10), D(0), D(50))],
        "order_id int, customer_id int, product_id int, category_name string, order_qty int, "
        "unit_price decimal(19,4), unit_price_discount decimal(5,4), line_total decimal(19,4)",
    )
    customers = spark.createDataFrame([(7, "A", "B"), (8, "C", None)], "customer_id int, first_name string, last_name string")
    return orders, lines, customers


def test_two_paths_agree_when_headers_are_sums_of_lines(spark):
    orders, lines, customers = _fact_frames(spark)
    p = facts.FactsParams(as_of=dt.date(2020, 4, 1))
    found = {r["customer_id"]: r for r in facts.customer_facts(orders, lines, customers, p).collect()}
    assert found[7]["revenue_delta_ab"] == 0 and found[7]["revenue_pct_delta_ab"] == 0
    assert (found[7]["distinct_products"], found[7]["distinct_categories"], found[7]["total_lines"]) == (2, 2, 3)
    assert found[7]["total_discount_path_b"] == D(2)
    assert found[8]["total_revenue_path_b"] is None and found[8]["revenue_pct_delta_ab"] is None
    assert found[8]["customer_name"] is None


def test_payload_leaves_nulls_out_and_reads_back(spark):
    orders, lines, customers = _fact_frames(spark)
    p = facts.FactsParams(as_of=dt.date(2020, 4, 1))
    scored = facts.fact_scores(facts.customer_facts(orders, lines, customers, p))
    parsed = {r["customer_id"]: r for r in facts.parse_payload(facts.customer_payload(scored, lines)).collect()}
    assert '"revenueB"' not in parsed[8]["payload_json"] and parsed[8]["revenue_b_json"] is None
    assert parsed[7]["revenue_a_json"] == D(150) and parsed[7]["orders_json"] == 2
    bad = spark.createDataFrame([(1, '{"orders": "abc", "revenueA": "x"}')], "customer_id int, payload_json string")
    assert tuple(facts.parse_payload(bad).select("orders_json", "revenue_a_json").first()) == (None, None)


def test_quality_rules(spark):
    all_rules = seeds.quality_rules(spark)
    counts = {tuple(r[:2]): r[2] for r in all_rules.groupBy("check_group", "severity").count().collect()}
    assert counts == {
        ("Nulls", 3): 85, ("Nulls", 2): 11, ("Nulls", 1): 4, ("Ranges", 3): 85, ("Ranges", 2): 11,
        ("Ranges", 1): 4, ("Reconcile", 3): 53, ("Reconcile", 2): 5, ("Reconcile", 1): 2,
    }
    assert seeds.quality_rules(spark, limit=60).agg(F.max("qc_id")).first()[0] == 60
    df = spark.createDataFrame(
        [(1, -1.0, 1.0, None)],
        "customer_id int, total_revenue_path_a double, avg_order_value double, total_revenue_path_b double",
    )
    failed = quality.evaluate(df, all_rules).where("failed").groupBy("check_group").count()
    assert values(failed, "check_group", "count") == [("Ranges", 100), ("Reconcile", 60)]
    assert tuple(quality.fail_counts(quality.evaluate(df.where("false"), all_rules)).first()) == (0, 0, 0)


@pytest.mark.parametrize(
    "text",
    ["a IN (SELECT 1)", "exists(select 1)", "reflect('x', 'y') = 'z'", "b > 1", "a > 1; a < 2", "a > 1 -- x", "`a` > 1"],
)
def test_predicates_outside_the_list_are_refused(text):
    with pytest.raises(quality.RejectedPredicate):
        quality.predicate(text, ["a"])


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, None, "y"), (2, 50, None)], "id int, v int, p string")
    parent = spark.createDataFrame([("x",)], "k string")
    assert values(quality.not_null(df, "v", "id"), "row_key") == [("1",)]
    assert values(quality.check(df, "v_small", c("v") < 10, "id"), "row_key") == [("2",)]
    assert values(quality.unique(df, ["id"]), "row_key") == [("1",)]
    assert values(quality.foreign_key(df, "p", parent, "k", "id"), "row_key") == [("1",)]


def test_audit_images(spark):
    schema = "id int, status string, shipped date, amount int"
    before = spark.createDataFrame(
        [(1, "A", None, 5), (2, None, dt.date(2020, 1, 1), 5), (3, "A", None, 5)], schema
    )
    after = spark.createDataFrame(
        [(1, "B", dt.date(2020, 1, 2), 5), (2, "X", dt.date(2020, 1, 1), 5), (3, "A", None, 6)], schema
    )
    fields = {"status": None, "shipped": "1900-01-01", "amount": None}
    found = changes.audit_update(before, after, "id", fields)
    assert values(found, "id", "field_changed", "old_value", "new_value") == [
        (1, "shipped", None, "2020-01-02"), (1, "status", "A", "B"), (3, "amount", "5", "6"),
    ]


def test_upsert_and_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert values(changes.merge_upsert(target, source, ["id"]), "id", "v") == [(1, "a"), (2, "B"), (3, "C")]
    updated = changes.update_where(target, c("id") > 1, v=F.lit("z"))
    assert values(updated, "id", "v") == [(1, "a"), (2, "z")]


def test_dependency_levels(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "node string, depends_on string"
    )
    assert values(graph.dependency_levels(edges), "node", "level") == [
        ("a", 2), ("b", 1), ("c", 0), ("w", None), ("x", None), ("y", None),
    ]
    assert values(graph.in_degree(edges), "node", "in_degree") == [("b", 1), ("c", 2), ("x", 2), ("y", 1)]


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 4, 3, 3, 3, 1])], "id int, v int")
    assert topn.top_with_ties(df, "v", 3).count() == 5
    few = spark.createDataFrame([(1, 5), (2, None), (3, None)], "id int, v int")
    assert topn.top_with_ties(few, "v", 2).count() == 3


def test_scripts(spark):
    texts = [
        (1, "SET NOCOUNT ON\nGO\nCREATE OR ALTER PROCEDURE [dbo].[p1]\nAS SELECT * FROM #t\n"),
        (2, "CREATE OR REPLACE FUNCTION f2 AS\nPRAGMA x\n"),
        (3, "CREATE FUNCTION s.f3() RETURNS SETOF t AS $$\n$$ LANGUAGE plpgsql"),
        (4, "nothing here"),
        (5, ""),
    ]
    scripts = spark.createDataFrame(texts, "doc_id int, text string")
    found = corpus.prescan(scripts)
    assert values(found, "doc_id", "detected_dialect", "total_lines", "temp_table_references") == [
        (1, "tsql", 4, 1), (2, "plsql", 2, 0), (3, "plpgsql", 2, 0), (4, "unknown", 1, 0), (5, "unknown", 0, 0),
    ]
    assert values(corpus.script_objects(scripts), "doc_id", "object_name", "object_type", "start_line") == [
        (1, "p1", "procedure", 3), (2, "f2", "function", 1), (3, "f3", "function", 1),
    ]


def test_complexity(spark):
    schema = ", ".join(f"{name} int" for name in corpus.FACTORS)
    df = spark.createDataFrame([(50, 0, 0, 0, 0, 1, 0), (1001, 11, 6, 1, 7, 9, 2)], schema)
    assert values(corpus.complexity_score(df), "complexity", "complexity_level") == [
        (0.85, "Simple"), (9.1, "Very Complex"),
    ]
    sizes = spark.createDataFrame([(1, 499), (1, 600), (6, 100), (16, 1), (1, 5001)], "o int, l int")
    assert [r[0] for r in sizes.select(corpus.file_class(c("o"), c("l"))).collect()] == [
        "Simple script", "Standard script", "Complex script", "Enterprise script", "Enterprise script",
    ]


def test_confidence(spark):
    files = spark.createDataFrame(
        [("good", True, True, True, 0, 0, False, False), ("bad", True, False, False, 6, 3, True, True)],
        "file string, syntax_valid boolean, logic_valid boolean, dependencies_resolved boolean, todo_count int, "
        "issues_fixed int, was_reverted boolean, known_limitation boolean",
    )
    issues = spark.createDataFrame(
        [("bad", "error", "MERGE needed"), ("bad", "HIGH", "other"), ("bad", "HIGH", "Kafka source"), ("bad", "warning", "x")],
        "file string, severity string, message string",
    )
    assert values(corpus.confidence_scores(files, issues), "file", "completion_pct", "confidence_pct", "grade") == [
        ("bad", 51, 30, "F"), ("good", 90, 95, "A"),
    ]


def test_status_and_bonus(spark):
    df = spark.createDataFrame([(1,), (4,), (9,), (None,)], "s int")
    assert [r[0] for r in df.select(rules.status_label(c("s"))).collect()] == [
        "Pending", "Cancelled", "Unknown", "Unknown",
    ]
    pay = spark.createDataFrame([(100.0, "good"), (100.0, "average"), (100.0, "poor")], "s double, p string")
    assert [r[0] for r in pay.select(rules.bonus(c("s"), c("p"))).collect()] == [10.0, 5.0, 0.0]


EMPLOYEES = [
    (1, "Abhishek Sharma", "Engineering", 95000, dt.date(2022, 3, 15)),
    (2, "Priya Patel", "Marketing", 72000, dt.date(2021, 7, 20)),
    (3, "Rahul Verma", "Engineering", 88000, dt.date(2023, 1, 10)),
    (4, "Sneha Gupta", "HR", 65000, dt.date(2020, 11, 5)),
    (5, "Arjun Singh", "Engineering", 102000, dt.date(2019, 6, 30)),
    (6, "Kavya Nair", "Marketing", 78000, dt.date(2022, 9, 14)),
    (7, "Vikram Das", "Finance", 91000, dt.date(2021, 3, 22)),
    (8, "Anita Joshi", "HR", 67000, dt.date(2023, 5, 18)),
    (9, "Rohan Mehta", "Engineering", 115000, dt.date(2018, 12, 1)),
    (10, "Divya Reddy", "Finance", 84000, dt.date(2022, 1, 25)),
]


def test_employees(spark, tmp_path):
    from tallyspark.sources import files

    made = spark.createDataFrame(EMPLOYEES, files.EMPLOYEES)
    files.write_csv(made, str(tmp_path / "employees"))
    staff = files.read_csv(spark, str(tmp_path / "employees"), files.EMPLOYEES)
    totals = {r[0]: r[1] for r in people.salary_by_department(staff).collect()}
    assert totals == {"Engineering": 400000, "Finance": 175000, "Marketing": 150000, "HR": 132000}
    joined = [r[0].split()[0] for r in people.joined_after(staff, dt.date(2022, 1, 1)).collect()]
    assert joined == ["Divya", "Abhishek", "Kavya", "Rahul", "Anita"]
    means = {r[0]: (r[1], r[2]) for r in people.average_and_headcount(staff).collect()}
    assert means["Finance"] == (87500.0, 2) and means["Engineering"] == (100000.0, 4)
    assert [r[0].split()[0] for r in people.top_earners(staff, 90000).collect()] == ["Rohan", "Arjun", "Abhishek", "Vikram"]
    report = people.company_totals(staff, dt.date(2026, 3, 29)).first()
    assert tuple(report)[:6] == (10, 857000, 85700.0, "Rohan Mehta", "Sneha Gupta", "Anita Joshi")
    ranked = people.ranked_top(staff, 1)
    assert {r["name"] for r in ranked.collect()} == {"Rohan Mehta", "Kavya Nair", "Anita Joshi", "Vikram Das"}
    batches = people.batches(staff, [("id", "asc")], 4)
    assert [r[0] for r in batches.orderBy("id").select("batch").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_report_plans_only_what_is_asked(spark):
    from conftest import DATA

    from tallyspark.catalog import bindings as b
    from tallyspark.sources import Tables

    t = Tables(spark, DATA)
    frames = b.sales_orders(t), b.sales_order_lines(t), b.sales_products(t), b.sales_customers(t)
    assert set(sales.report(*frames, b.SALES_PARAMS, "Summary")) == {"summary"}
    full = sales.report(*frames, b.SALES_PARAMS, "Full")
    assert set(full) == {"summary", "top_customers", "categories"}


def test_negative_minimum_uses_the_highest_running_total(spark):
    lines = spark.createDataFrame(
        [(1, 1, 1, dt.date(2020, 1, 1), 1, D(100), D(0), 1, "a"), (2, 1, 1, dt.date(2020, 1, 2), 1, D(-30), D(0), 1, "a")],
        "order_id int, line_no int, customer_id int, order_date date, product_id int, line_total decimal(19,4), "
        "discount_applied decimal(5,4), days_to_ship int, category_name string",
    )
    customers = spark.createDataFrame(
        [(1, "n", "e", "r", dt.date(2019, 1, 1), True)],
        "customer_id int, customer_name string, email string, region string, registration_date date, is_active boolean",
    )
    day = dt.date(2020, 2, 1)
    p = sales.SalesParams(day, day, day, min_amount=D(-1000))
    assert sales.customer_profile(customers, lines, p).first()["lifetime_value"] == D(100)
