"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialise

#: Edges (two integers each) up to which a round is one task's work: shuffles would cost more than it does.
FEW_EDGES = 1 << 17


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """Link the neighbours of every node (the larger ones, or the smaller ones and itself) to the least."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    around = dealt(
        _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = around.join(least, "u")
    if large:
        linked = linked.where(F.col("v") > F.col("u"))
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return dealt(new.where("u <> v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of an edge (u, v): the least id that it is linked to.

    Self-links and repeated edges do no harm; null ends are left out. Each
    round is a table in the shared folder, and rounds end when a round changes
    nothing: as many as the logarithm of the graph's size, roughly. A round
    over at most ``FEW_EDGES`` edges shuffles nothing. No edges give no rows.
    """
    current = materialise(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = current.agg(mark).first()
    while before[0][0]:
        few = before[0][0] <= FEW_EDGES
        current = materialise(_star(_star(current, True, few), False, few), "edges")
        after = current.agg(mark).first()
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("id"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
