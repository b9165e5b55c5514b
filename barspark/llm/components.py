"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Smallest reachable id of every node that has an edge: ``(node, comp)``.

    ``edges`` holds ids ``u`` and ``v``. In each round every node points at its
    least neighbour (or itself) and then at that one's target; edges and labels
    are rewritten with the targets, and edges inside one target vanish. The
    least id of a component only ever points at itself, so it is the label that
    remains. Chains shrink by a factor each round and stars end in one or two.
    Only a row test reaches the driver.
    """
    e = scratch.table(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        f"{label}-e0",
    )
    comp = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("comp", F.col("node"))
    comp = scratch.table(comp, f"{label}-c0")
    k = 0
    while e.limit(1).count():
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to")).withColumnRenamed("u", "id")
        least = scratch.table(least, f"{label}-m{k}")
        jump = least.alias("a").join(
            least.select(F.col("id").alias("to"), F.col("to").alias("far")), "to"
        ).select("id", "far")
        jump = scratch.table(jump, f"{label}-j{k}")
        comp_next = (
            comp.join(jump.withColumnRenamed("id", "comp"), "comp", "left")
            .select("node", F.coalesce("far", "comp").alias("comp"))
        )
        e_next = (
            e.join(jump.select(F.col("id").alias("u"), F.col("far").alias("fu")), "u")
            .join(jump.select(F.col("id").alias("v"), F.col("far").alias("fv")), "v")
            .where("fu <> fv")
            .select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))
            .distinct()
        )
        comp_next = scratch.table(comp_next, f"{label}-c{k + 1}")
        e_next = scratch.table(e_next, f"{label}-e{k + 1}")
        scratch.drop(f"{label}-m{k}", f"{label}-j{k}", f"{label}-c{k}", f"{label}-e{k}")
        comp, e, k = comp_next, e_next, k + 1
    scratch.drop(f"{label}-e{k}")
    return comp
