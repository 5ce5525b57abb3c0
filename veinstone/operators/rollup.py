"""Bottom-up roll-ups over trees: what a node says depends on what its children said, level by level.

The levels are depths, found once; a round joins one level with the one above. The rounds are as many as the tree is
deep, each a join and no driver loop over rows. Children that say nothing are skipped: their own children stand for them.
Nodes that hang on a circle have no depth and are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut


def bottom_up(nodes: DataFrame, own: Callable[[Column], Column], allowed: Column | None = None) -> DataFrame:
    """(id, value): ``own(children)`` of each node, children being the array of the values of its nearest descendants that have one, in order.

    nodes: (id, parent, depth, place, ...): place orders siblings. ``allowed`` says which nodes may have a value of their own.
    """
    allowed = F.lit(True) if allowed is None else allowed
    n = cut(nodes.where("depth >= 0").withColumn("_allowed", F.coalesce(allowed, F.lit(False))), "nodes")
    deepest = n.agg(F.max("depth").alias("d")).first()["d"]
    if deepest is None:
        return n.select("id", own(F.array().cast("array<string>")).alias("value")).limit(0)
    done, below = None, None
    for depth in range(deepest, -1, -1):
        level = n.where(F.col("depth") == depth)
        empty = F.array().cast("array<string>")
        if below is None:
            joined = level.withColumn("_c", empty)
        else:
            # What comes up from a level: of each parent the values in the order of its children.
            gathered = below.groupBy("parent").agg(F.flatten(F.sort_array(F.collect_list(F.struct("place", "id", "up")))["up"]).alias("_c"))
            joined = level.join(gathered.withColumnRenamed("parent", "id"), "id", "left").withColumn("_c", F.coalesce("_c", empty))
        valued = joined.withColumn("value", F.when(F.col("_allowed"), own(F.col("_c"))))
        up = F.when(F.coalesce("value", F.lit("")) != "", F.array("value")).otherwise(F.col("_c"))
        below = cut(valued.select("id", "parent", "place", "value", up.alias("up")), "level")
        part = below.where("value IS NOT NULL").select("id", "value")
        done = part if done is None else done.unionByName(part)
    return done
