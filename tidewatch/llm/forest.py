"""Connected components by Borůvka contraction, with the minimum spanning forest as a by-product.

In every round each component picks its least edge (by weight, then by the edge's ends, so picks never form a cycle but for
two components that pick the same edge), picked edges join the forest, the stars and chains they form are contracted by
pointer doubling, and the remaining edges are renamed to the contracted ends; edges inside a component and all but the
least of parallel ones go. Each round at least halves the components that still have an edge. Every round's state is
written to the shared folder, so lineage stays short and the run survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize, shared_path



def spanning_forest(edges: DataFrame, forest_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v, w) with bigint ends -> (labels (node, component), forest (u, v, w)).

    Every end of an edge has a label: a node of its component. Self-loops only yield their node. The forest is persisted
    under ``forest_path`` (one folder a round). No edges: both results are empty.
    """
    spark = edges.sparkSession
    forest_path = forest_path or shared_path(spark, "forest")
    forest_schema = "u bigint, v bigint, w bigint"
    start = edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("long").alias("w"))
    live = materialize(start.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", "w", F.col("u").alias("fu"), F.col("v").alias("fv")), "boruvka-edges")
    labels = materialize(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component")), "boruvka-labels")
    live = live.where("u <> v")
    rounds = 0
    while not live.isEmpty():
        # Each component's least edge. Partial aggregation takes hot components before the shuffle.
        both = live.select(F.col("u").alias("c"), F.col("v").alias("to"), "w", "fu", "fv").unionByName(live.select(F.col("v").alias("c"), F.col("u").alias("to"), "w", "fu", "fv"))
        pick = materialize(both.groupBy("c").agg(F.min(F.struct("w", "fu", "fv", "to")).alias("e")).select("c", "e.to", "e.w", "e.fu", "e.fv"), "boruvka-picks")
        pick.select(F.col("fu").alias("u"), F.col("fv").alias("v"), "w").distinct().write.parquet(f"{forest_path}/round={rounds}")
        # Two components that picked each other: the smaller becomes the root.
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parent = pick.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        parent = materialize(parent, "boruvka-parents")
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            parent = materialize(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "boruvka-parents")
            still = parent.where("moved").limit(1).count()
            parent = parent.select("c", "p")
            if not still:
                break
        names = parent.select(F.col("c"), F.col("p"))
        labels = materialize(labels.join(names.withColumnRenamed("c", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "boruvka-labels")
        renamed = (
            live.join(names.select(F.col("c").alias("u"), F.col("p").alias("pu")), "u")
            .join(names.select(F.col("c").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), "w", "fu", "fv")
        )
        live = materialize(renamed.groupBy("u", "v").agg(F.min(F.struct("w", "fu", "fv")).alias("e")).select("u", "v", "e.w", "e.fu", "e.fv"), "boruvka-edges")
        rounds += 1
    if rounds == 0:
        return labels, spark.createDataFrame([], forest_schema)
    return labels, spark.read.schema(forest_schema).parquet(*[f"{forest_path}/round={i}" for i in range(rounds)])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of ``edges`` (u, v)."""
    return spanning_forest(edges.select("u", "v", F.lit(0).alias("w")))[0]
