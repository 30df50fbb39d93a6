"""What the plans must and must not hold."""

import os
import re

import pytest
from conftest import DATA, ROOT

from tallyspark import catalog

QUERIES = catalog.callables()
CORE = [
    "daily_summary", "sales_staging", "customer_profile", "revenue_calc", "monthly_revenue", "report_categories",
    "comm_line_finals", "comm_seller_summary", "rfm_score", "audit_violations", "customer_facts", "lt_final",
    "trigger_change_audit", "win_row_number", "win_dense_rank", "win_ntile_global", "script_prescan",
]


def plan_of(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_core_plans_stay_in_the_jvm(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct", plan)


def test_date_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "flt_between_dates")
    assert "GreaterThanOrEqual(o_orderdate,1996-03-01T00:00)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert [f.split(":")[0] for f in schema.split(",")] == ["o_orderkey", "o_custkey", "o_orderdate"]


@pytest.mark.parametrize("name", ["win_ntile_global", "win_row_number", "sales_staging", "rfm_score"])
def test_no_window_holds_a_whole_table(spark, name):
    """A window without partition keys only runs over counts per range."""
    plan = plan_of(spark, name)
    for line in plan.splitlines():
        if re.search(r"Window \[", line) and not re.search(r"windowspecdefinition\((?!__part)[a-z_]+#", line):
            assert "__rows" in line or "__part" in line or "__sum" in line, line


@pytest.fixture
def shuffled(spark):
    """Plans as they are when no side of a join is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def tree(plan):
    """(depth, name) of each node of a plan's text."""
    nodes = []
    for line in plan.splitlines():
        found = re.match(r"^([ :|+-]*)(?:\*\(\d+\) )?([A-Z][A-Za-z]+)", line)
        if found:
            nodes.append((len(found.group(1)), found.group(2)))
    return nodes


@pytest.mark.parametrize("name", ["agg_path_b", "customer_facts", "report_categories", "reconcile_two_paths"])
def test_no_aggregate_rests_on_the_layout_of_a_join(spark, shuffled, name):
    """Between a join and the last step of an aggregate there is an exchange, so AQE may split a hot key."""
    nodes = tree(plan_of(spark, name))
    grouped = 0
    for i, (depth, node) in enumerate(nodes):
        if not node.endswith("Aggregate"):
            continue
        below = [n for d, n in nodes[i + 1 :]]
        deeper = next((j for j, (d, _) in enumerate(nodes[i + 1 :]) if d <= depth), len(below))
        chain = []
        for n in below[:deeper]:
            if n.endswith("Exchange") or n.endswith("Join") or n.startswith("Scan") or n.startswith("FileScan"):
                chain.append(n)
                break
            chain.append(n)
        aggregates = sum(n.endswith("Aggregate") for n in chain)
        grouped += 1
        # a partial aggregate may stand on a join; a final one above it must not
        assert not (chain and chain[-1].endswith("Join") and aggregates), (name, chain)
    assert grouped >= 4


@pytest.mark.parametrize("name", ["report_summary", "customer_profile", "report_categories", "agg_path_b"])
def test_distinct_counts_copy_no_rows(spark, name):
    assert "Expand" not in plan_of(spark, name)


@pytest.mark.parametrize(
    "name, table, times",
    [("comm_line_finals", "lineitem", 0), ("rfm_score", "lineitem", 0), ("revenue_calc", "lineitem", 0),
     ("report_summary", "lineitem", 0), ("customer_payload", "lineitem", 0), ("agg_path_b", "lineitem", 1)],
)
def test_lines_are_read_once(spark, name, table, times):
    """Queries that use the lines twice read a stage of them; the table itself is not in the plan above it."""
    assert plan_of(spark, name).count(f"{table}.parquet") == times


def test_neighbours_and_best_rules_join_no_frame_with_itself(spark, shuffled):
    for name in ("win_lag", "win_lead", "trigger_change_audit", "join_self_before_after"):
        assert "SortMergeJoin" not in plan_of(spark, name), name
    assert "collect_list" not in plan_of(spark, "join_effective_date_best")


def sources():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallyspark")):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    yield name, file.read()


def test_nothing_is_collected_or_checkpointed_locally():
    allowed = {
        "quality.py": 1,  # the distinct rule texts
        "urls.py": 1,  # at most 20,000 labelled rows
        "language.py": 1,  # one count per language and hash
        "toxicity.py": 1,  # one weight per hash
        "html_text.py": 1,  # at most 2,000 labelled pages
        "vector_codes.py": 3,  # the first vectors, and one sum per entry and position
        "files.py": 1,  # one name per data file
        "decontamination.py": 1,  # a block of the benchmark, at most 16 MB
    }
    for name, text in sources():
        assert len(re.findall(r"\.collect\(\)|\.toPandas\(|\.rdd\b", text)) <= allowed.get(name, 0), name
        assert "localCheckpoint" not in text and "F.udf" not in text, name


def test_schemas_are_stable(spark):
    from __spark_entry__ import entry

    assert entry(spark).schema == entry(spark).schema
    assert entry(spark).count() > 0


def test_rows_of_a_task_are_bounded_where_nearly_every_line_is_a_group(spark, monkeypatch):
    """Tasks sized by compressed bytes get millions of narrow rows."""
    monkeypatch.setattr("tallyspark.operators.joins.TASK_ROWS", 100)
    plan = plan_of(spark, "agg_two_level")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert re.search(rf"hashpartitioning\(l_orderkey#\d+L, {-(-lines // 100)}\), REPARTITION_BY_NUM", plan)


def test_lines_travel_without_their_orders_columns(spark, monkeypatch):
    """The staged lines hold what is computed from and what was asked for; orders take the tiers."""
    from tallyspark.plans import commission

    staged = {}

    def keep(df, label="stage", compression=None):
        staged[label] = set(df.columns)
        return df

    monkeypatch.setattr(commission, "materialise", keep)
    QUERIES["comm_pricing"](spark, DATA)
    assert staged["lines"] == {"order_id", "line_no", "product_id", "line_total", "category_name", "subcategory_name"}
    assert {"customer_id", "territory_group"} <= staged["orders"] and "line_total" not in staged["orders"]


def test_staged_orders_and_lines_are_written_in_the_order_of_their_names(spark, shuffled, monkeypatch):
    from tallyspark.plans import commission

    plans = {}

    def kept(df, label, *compression):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(commission, "materialise", kept)
    QUERIES["comm_pricing"](spark, DATA)

    def top(label):
        return re.sub(r"#\d+L?", "", next(x for x in plans[label].splitlines() if re.search(r"\bSort \[", x)))

    assert "Sort [territory_name ASC NULLS FIRST, seller_id ASC NULLS FIRST], false" in top("orders")
    assert "Sort [category_name ASC NULLS FIRST, subcategory_name ASC NULLS FIRST, order_id" in top("lines")
    # names of territories come after the last shuffle of the orders
    assert plans["orders"].index("BroadcastHashJoin") < plans["orders"].index("SortMergeJoin")


def test_categories_of_orders_travel_to_their_orders_once(spark, shuffled):
    from pyspark.sql import functions as F

    from tallyspark.plans import facts

    lines = spark.createDataFrame(
        [(1, 1, 5, 2, 3.0, 0.5, 6.0), (1, 2, 6, 1, 3.0, 0.0, 3.0), (2, 1, 5, 1, 3.0, 0.0, 3.0), (None, 1, 5, 1, 1.0, 0.0, 1.0)],
        "order_id long, line_no int, product_id long, order_qty int, unit_price double, unit_price_discount double, line_total double",
    )
    orders = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (None, 9)], "order_id long, customer_id long")
    products = spark.createDataFrame([(5, "a"), (6, "a"), (6, "b")], "product_id long, category_name string")
    made = facts.order_categories(lines, orders, products)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # lines by order and product, by product, by order; products; orders
    assert plan.count("Exchange hashpartitioning") == 5
    assert sorted(map(tuple, made.select("order_id", "category_name", "line_total", "products", "customer_id").collect())) == [
        (1, "a", 9.0, 2, 7), (1, "b", 3.0, 1, 7), (2, "a", 3.0, 1, 7), (2, "a", 3.0, 1, 8),
    ]
    assert made.where(F.col("order_id").isNull()).isEmpty()


def test_steps_of_a_logged_run_are_written_in_zstd(spark, tmp_path):
    from tallyspark.plans import runs

    made = runs.logged_run(spark, "run", [("step", lambda made: spark.range(9))], str(tmp_path / "log"))
    assert all(name.endswith(".zstd.parquet") for name in made["step"].inputFiles())
