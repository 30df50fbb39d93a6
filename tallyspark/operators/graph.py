"""Levels of a dependency graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import fresh_path, materialise


def in_degree(edges: DataFrame) -> DataFrame:
    """How many different nodes depend on each node."""
    return (
        edges.select("node", "depends_on")
        .distinct()
        .groupBy(F.col("depends_on").alias("node"))
        .agg(F.count("*").alias("in_degree"))
    )


def _ends(chains: DataFrame) -> DataFrame:
    """Where each chain of single dependencies ends, how far away, and whether it does.

    ``chains`` holds (node, to): nodes with one dependency. Pointers are doubled:
    a chain of n nodes takes log2(n) rounds, one write each. A round in which no
    more chains end leaves only those that run into a cycle.
    """
    state = materialise(chains.select("node", "to", F.lit(1).alias("far"), F.lit(True).alias("open")), "chains")
    before = None
    while True:
        still = state.agg(F.count_if("open")).first()[0]
        if still == 0 or still == before:
            return state
        before = still
        ahead = state.select(
            F.col("node").alias("__node"), F.col("to").alias("__to"), F.col("far").alias("__far")
        )
        joined = state.join(ahead, F.col("open") & (F.col("to") == F.col("__node")), "left")
        state = materialise(
            joined.select(
                "node",
                F.coalesce("__to", "to").alias("to"),
                (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"),
                F.col("__node").isNotNull().alias("open"),
            ),
            "chains",
        )


def dependency_levels(edges: DataFrame) -> DataFrame:
    """Topological level per node: 0 depends on nothing, n on levels below n.

    ``edges`` holds (node, depends_on). Chains of nodes with one dependency are
    followed to their ends by doubling, whatever their length. The other nodes
    keep a counter of open dependencies and the highest level seen; a round
    brings the last round's finished nodes to their dependants and is written
    once, so there are at most as many writes as levels. Nodes on or behind a
    cycle never finish and get a NULL level. A NULL dependency is none.
    """
    listed = materialise(edges.select("node", "depends_on").distinct(), "edges")
    edges = listed.where("node is not null and depends_on is not null")
    degrees = edges.groupBy("node").agg(F.count("*").alias("open"), F.min("depends_on").alias("to"))
    nodes = listed.select("node").union(listed.select("depends_on")).where("node is not null").distinct()
    roots = nodes.join(degrees.select("node"), "node", "left_anti")
    ends = _ends(degrees.where("open = 1").select("node", "to"))
    # edges of the nodes with several dependencies, past the chains
    past = ends.select(
        F.col("node").alias("__node"), F.col("to").alias("__to"), F.col("far").alias("__far"), F.col("open").alias("__open")
    )
    several = degrees.where("open > 1").select("node", "open")
    core = materialise(
        edges.join(several.select("node"), "node", "left_semi")
        .join(past, F.col("depends_on") == F.col("__node"), "left")
        .select(
            "node",
            F.when(~F.coalesce("__open", F.lit(False)), F.coalesce("__to", "depends_on")).alias("to"),
            (F.coalesce("__far", F.lit(0)) + 1).alias("far"),
        ),
        "core",
    )
    folder, spark = fresh_path(edges.sparkSession, "levels"), edges.sparkSession
    first = roots.select("node", F.lit(0).cast("bigint").alias("open"), F.lit(0).alias("level")).unionByName(
        several.select("node", "open", F.lit(0).alias("level"))
    )
    first.write.parquet(f"{folder}/round=0")
    schema = spark.read.parquet(f"{folder}/round=0").schema
    for number in itertools.count():
        state = spark.read.schema(schema).parquet(f"{folder}/round={number}")
        finished = state.where("open = 0").select(F.col("node").alias("__at"), F.col("level").alias("__level"))
        hits = (
            core.join(finished, F.col("to") == F.col("__at"))
            .groupBy(F.col("node").alias("__hit"))
            .agg(F.count("*").alias("__n"), F.max(F.col("__level") + F.col("far")).alias("__least"))
        )
        pending = state.where("open > 0")
        sizes = state.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if sizes[0] == 0 or sizes[1] == 0:
            break
        pending.join(hits, F.col("node") == F.col("__hit"), "left").select(
            "node",
            (F.col("open") - F.coalesce("__n", F.lit(0))).alias("open"),
            F.greatest("level", F.coalesce("__least", F.lit(0))).alias("level"),
        ).write.parquet(f"{folder}/round={number + 1}")
    done = spark.read.schema(schema).parquet(folder).where("open = 0").select("node", "level")
    stuck = pending.select("node", F.lit(None).cast("int").alias("level"))
    known = done.unionByName(stuck)
    chained = ends.join(known.withColumnsRenamed({"node": "__at", "level": "__level"}), F.col("to") == F.col("__at"), "left")
    level = F.when(~F.col("open"), F.col("__level") + F.col("far"))
    return known.unionByName(chained.select("node", level.cast("int").alias("level")))


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes without a level: those on or behind a cycle, joined where edges join them.

    A component is named by its smallest node. Each round takes the least name
    among a node and its neighbours, then the name of that name; names travel
    twice as far each time, so rounds grow with the logarithm of a component's width.
    """
    levels = materialise(dependency_levels(edges), "levels")
    stuck = levels.where("level is null").select("node")
    links = edges.select("node", F.col("depends_on").alias("other")).join(stuck, "node", "left_semi")
    links = links.join(stuck.withColumnRenamed("node", "other"), "other", "left_semi").select("node", "other")
    both = materialise(links.union(links.select("other", "node")).distinct(), "links")
    named = materialise(stuck.withColumn("component", F.col("node")), "components")
    while True:
        beside = both.join(named.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("__least"))
        nearer = materialise(
            named.join(beside, "node", "left").select(
                "node", F.col("component").alias("before"), F.least("component", F.coalesce("__least", "component")).alias("component")
            ),
            "components",
        )
        ahead = nearer.select(F.col("node").alias("__node"), F.col("component").alias("__next"))
        jumped = materialise(
            nearer.join(ahead, F.col("component") == F.col("__node")).select("node", "before", F.col("__next").alias("component")),
            "components",
        )
        named = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return named
