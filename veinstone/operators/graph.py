"""Property graphs as node and edge frames: degrees, expansion, deltas, communities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut, salted_left_join


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at each node, counted on both sides before the shuffle."""
    return symmetric(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(ends, "node", "left_anti")


def allowed(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the allowed types; an edge goes if one of its ends has gone."""
    n = nodes.where(F.col("type").isin(*node_types))
    keys = n.select("node")
    e = edges.where(F.col("type").isin(*edge_types))
    for end in ("src", "dst"):
        e = e.join(keys.withColumnRenamed("node", end), end, "left_semi")
    return n, e


def edge_weight(default: Column, confidence: Column) -> Column:
    """The greater of the type's default and the confidence, within [0.05, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), default, F.coalesce(confidence, F.lit(0.0))))


def expand(seeds: DataFrame, edges: DataFrame, per_seed: int, least: float = 0.0) -> DataFrame:
    """Paths of one and two edges from each seed over edges of at least ``least`` weight, the best ``per_seed`` of each.

    (seed, node, hops, score): score is the least weight of the path less 0.05 for the second edge; of several paths to
    a node the best counts, then the shorter. seeds: (seed, node).
    """
    e = symmetric(edges.where(F.coalesce("weight", F.lit(0.5)) >= least).select("src", "dst", F.coalesce("weight", F.lit(0.5)).alias("weight")))
    one = seeds.join(e, seeds["node"] == e["src"]).select("seed", F.col("node").alias("start"), F.col("dst").alias("node"), F.col("weight").alias("w1"))
    two = one.join(e, one["node"] == e["src"]).where(F.col("dst") != F.col("start")).select("seed", "start", F.col("dst").alias("node"), (F.least("w1", "weight") - 0.05).alias("score"), F.lit(2).alias("hops"))
    both = one.select("seed", "start", "node", F.col("w1").alias("score"), F.lit(1).alias("hops")).unionByName(two)
    best = both.groupBy("seed", "node").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"))).alias("b")).select("seed", "node", F.col("b.score").alias("score"), (-F.col("b.h")).alias("hops"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "hops", "node")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_seed)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def stale(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a delta sync deletes: old rows whose key the new state lacks."""
    return old.join(new.select(*key).distinct(), key, "left_anti")


def merge(rows: DataFrame, identity: list[str], order: list[str], *values: str) -> DataFrame:
    """One row an identity: the values of the row that is greatest by ``order``."""
    return rows.groupBy(*identity).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_m")).select(*identity, *[F.col(f"_m.{v}").alias(v) for v in values])


def propagate(edges: dict[str, dict[str, float]], rounds: int = 20, floor: float = 0.05) -> dict[str, str]:
    """Labels by propagation in place: nodes in order of their names, ties to the smallest label."""
    label = {n: n for n in edges}
    for _ in range(rounds):
        changed = False
        for n in sorted(edges):
            weight: dict[str, float] = {}
            for m, w in edges[n].items():
                weight[label[m]] = weight.get(label[m], 0.0) + max(floor, w)
            if weight:
                best = min(weight, key=lambda x: (-round(weight[x], 9), x))
                if best != label[n]:
                    label[n], changed = best, True
        if not changed:
            break
    return label


def communities_in_components(edges: DataFrame, component: str, rounds: int = 20, bound: int = 50_000) -> DataFrame:
    """(node, label): propagation in place within each component.

    A component of at most ``bound`` edges is done in one task, the nodes one after another; larger ones by joins, with the same labels.
    """
    sized = edges.join(edges.groupBy(component).count(), component)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        graph: dict[str, dict[str, float]] = {}
        for s, d, w in zip(rows.src, rows.dst, rows.weight):
            for a, b in ((s, d), (d, s)):
                graph.setdefault(a, {})
                if a != b:  # a loop has no vote
                    graph[a][b] = graph[a].get(b, 0.0) + max(0.05, w)
        found = propagate(graph, rounds)
        yield pd.DataFrame({"node": list(found), "label": list(found.values())})

    small = sized.where(F.col("count") <= bound).select(component, "src", "dst", "weight")
    grouped = small.groupBy(component).applyInPandas(lambda pdf: next(run(iter([pdf]))), "node string, label string")
    large = sized.where(F.col("count") > bound)
    return grouped.unionByName(in_place_labels(large, component, rounds)) if large.limit(1).count() else grouped


def in_place_labels(edges: DataFrame, component: str, rounds: int = 20, floor: float = 0.05) -> DataFrame:
    """(node, label): the labels that ``propagate`` gives in each component, by joins.

    Within a round a node takes into account the new labels of neighbours of smaller names and the old ones of the others.
    So new labels are computed anew from each other until none moves: each depends on smaller names only, which makes the result the only one.
    """
    edges = edges.withColumn("weight", F.greatest(F.lit(floor), F.col("weight")))
    alone = edges.select(F.explode(F.array(F.struct(component, "src"), F.struct(component, F.col("dst").alias("src")))).alias("node")).distinct()
    ends = symmetric(edges.where("src <> dst").select(F.struct(component, "src").alias("src"), F.struct(component, F.col("dst").alias("src")).alias("dst"), "weight"))
    e = cut(ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    state = alone.select("node", F.col("node.src").alias("old"), F.col("node.src").alias("new"))
    for _ in range(rounds):
        moved = 1
        while moved:
            seen = salted_left_join(e, state.withColumnRenamed("node", "dst"), "dst", "src").withColumn("label", F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")))
            votes = seen.groupBy("src", "label").agg(F.sum("weight").alias("w"))
            best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.round("w", 9), "label"))["label"].alias("best"))
            state = cut(state.join(best, "node", "left").select("node", "old", F.coalesce("best", "new").alias("new"), (F.coalesce("best", "new") != F.col("new")).alias("moved")), "labels")
            moved = state.where("moved").limit(1).count()
            state = state.drop("moved")
        changed = state.where("old <> new").limit(1).count()
        state = state.select("node", F.col("new").alias("old"), "new")
        if not changed:
            break
    return state.select(F.col("node.src").alias("node"), F.col("new").alias("label"))


def synchronous_labels(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): all nodes take the heaviest label of their neighbours at once, ties to the smallest; distributed."""
    e = cut(symmetric(edges.select("src", "dst", "weight")), "edges")
    labels = e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.round("w", 9)).alias("top"))
        labels = cut(votes.join(best, "src").where(F.round("w", 9) == F.col("top")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("label")), "labels")
    return labels


def density(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, nodes, edges, density) of each community: 2m / (n (n - 1)) over distinct pairs."""
    n = labels.groupBy("label").agg(F.count("*").alias("nodes"))
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    inner = pairs.join(labels.select(F.col("node").alias("a"), "label"), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("l2")), "b").where("label = l2").groupBy("label").agg(F.count("*").alias("edges"))
    return n.join(inner, "label", "left").fillna(0, ["edges"]).withColumn("density", F.when(F.col("nodes") > 1, F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(F.lit(0.0)))


def stable_names(now: dict[str, set[str]], before: dict[str, set[str]]) -> dict[str, str]:
    """Names for communities: the previous name of greatest Jaccard from 0.5, each once and greedily; else a hash of the members."""
    import hashlib

    pairs = sorted(((len(m & p) / len(m | p), k, o) for k, m in now.items() for o, p in before.items() if m & p), key=lambda x: (-x[0], x[1], x[2]))
    names: dict[str, str] = {}
    for j, k, o in pairs:
        if j >= 0.5 and k not in names and o not in names.values():
            names[k] = o
    return {k: names.get(k) or hashlib.sha1("|".join(sorted(m)).encode()).hexdigest()[:16] for k, m in now.items()}
