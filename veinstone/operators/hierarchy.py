"""Parent-child links to full hierarchies.

Every row has at most one parent, so each component of the links is a tree, or one circle with trees hanging on it.
Components are found by pointer doubling: each node holds an ancestor and the distance to it, and both double in every
round, so the rounds grow with the logarithm of the depth. Components of bounded size are then co-located, a task
going through its components one after another, by an iterative depth-first traversal with colours: white nodes are new,
grey ones on the path, black ones done; a link to a grey node closes a circle. Components above the bound
never meet in one task: their circles are marked and their paths grow by the same doubling, as joins.

Defined results: rows with a null id are left out; a repeated row counts once; of several different parents of an id the
smallest existing one counts; a parent that is null, blank or no existing id makes a root with depth 0. If the way up
never reaches a root, depth is -1, the root is the smallest id of the circle, and the path holds the way into the circle
and once around it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut, salted_left_join

#: Nodes of a component that one task may hold.
BOUND = 100_000

_NODES = "id string, root string, depth int, path array<string>, descendants long, state string, back string"


def links(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, parent): one row an id, the parent being null unless it exists."""
    pairs = df.select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")).where("id IS NOT NULL").distinct()
    ids = pairs.select(F.col("id").alias("parent")).distinct()
    asked = pairs.where("trim(parent) <> ''").select("parent").distinct()
    there = asked.join(ids, "parent", "left_semi").withColumn("there", F.lit(True))
    # Children of one parent may be any share of the rows: the join is salted by the child.
    found = salted_left_join(pairs, there, "parent", "id")
    return found.groupBy("id").agg(F.min(F.when(F.col("there"), F.col("parent"))).alias("parent"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, parent, root, depth): of trees the root and the depth; of nodes that run into a circle its smallest id and -1."""
    state = cut(pairs.select("id", "parent", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"), F.coalesce("parent", "id").alias("least"), F.col("parent").isNull().alias("done")), "links")
    roots = state.where("done").select("id", "parent", F.col("id").alias("root"), F.lit(0).alias("depth"))
    solved, open_ = [roots], state.where("NOT done").drop("done")
    known = roots.select(F.col("id").alias("up"), F.col("root").alias("top"), F.col("depth").alias("below"))
    reach, left = 1, open_.count()
    while left:
        # What points at a node solved in the last round is solved; the rest jumps on, but from nodes solved in this round.
        met = cut(salted_left_join(open_, known, "up", "id"), "met")
        now = met.where("top IS NOT NULL").select("id", "parent", F.col("top").alias("root"), (F.col("steps") + F.col("below")).alias("depth"))
        rest = met.where("top IS NULL").drop("top", "below")
        ahead = rest.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("least").alias("smaller"))
        jumped = cut(
            salted_left_join(rest, ahead, "up", "id").select("id", "parent", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("least", "smaller").alias("least")),
            "open",
        )
        solved.append(now)
        known = now.select(F.col("id").alias("up"), F.col("root").alias("top"), F.col("depth").alias("below"))
        before, left, reach = left, jumped.count(), reach * 2
        if left == before and reach >= left:
            # All ways are longer than there are nodes: each pointer stands on a circle and has been around it.
            around = jumped.select(F.col("id").alias("up"), F.col("least").alias("root"))
            ringed = salted_left_join(jumped.select("id", "parent", "up"), around, "up", "id")
            solved.append(ringed.select("id", "parent", "root", F.lit(-1).alias("depth")))
            break
        open_ = jumped
    out = solved[0]
    for s in solved[1:]:
        out = out.unionByName(s)
    return cut(out, "components")


def traverse(rows: list[tuple[str, str | None]], paths: bool = True) -> Iterator[tuple[str, str, int, list[str] | None, int, str, str | None]]:
    """(id, root, depth, path, descendants, state, back) of one component's (id, parent) rows, by depth-first traversal.

    A link to a grey node is a back edge, which closes a circle: ``back`` is the node it comes from.
    Paths are made one after another on the way out, so that what is held grows with the nodes and not with the paths.
    """
    parent = dict(rows)
    children: dict[str, list[str]] = {}
    for i, p in rows:
        if p is not None:
            children.setdefault(p, []).append(i)
    roots = [i for i, p in rows if p is None]
    ring: list[str] = []
    if not roots and rows:
        # Up from any node until a grey one: the link to it is the back edge that closes the circle.
        grey, way, at = set(), [], rows[0][0]
        while at not in grey:
            grey.add(at)
            way.append(at)
            at = parent[at]
        ring = way[way.index(at) :]
        first = ring.index(min(ring))
        ring = ring[first:] + ring[:first]
        roots = [ring[0]]
    place = {i: k for k, i in enumerate(ring)}
    depth, below, back = {}, {}, {}
    for root in roots:
        colour = {root: 1}  # white nodes are absent, grey is 1, black is 2
        depth[root] = 0
        stack = [(root, iter(sorted(children.get(root, ()))))]
        while stack:
            node, rest = stack[-1]
            for c in rest:
                if colour.get(c) == 1:
                    back[c] = node
                if colour.get(c):
                    continue
                colour[c] = 1
                depth[c] = depth[node] + 1
                stack.append((c, iter(sorted(children.get(c, ())))))
                break
            else:
                stack.pop()
                colour[node] = 2
                below.setdefault(node, 0)
                if stack and node not in place:
                    below[stack[-1][0]] = below.get(stack[-1][0], 0) + below[node] + 1

    def way_up(i: str) -> list[str]:
        out = [i]
        while (p := parent[out[-1]]) is not None and p not in place:
            out.append(p)
        return out

    for i in depth:
        if not ring:
            path = way_up(i)[::-1] if paths else None
            yield i, roots[0], depth[i], path, below[i], "tree", None
            continue
        path = (([i] if i in place else way_up(i)) if paths else None)
        if paths:
            k = place[i] + 1 if i in place else place[parent[path[-1]]]
            path = path + [ring[(k + d) % len(ring)] for d in range(len(ring) - (i in place))]
        # Below a node of the circle lie all others of the circle and what hangs on it.
        yield i, ring[0], -1, path, len(rows) - 1 if i in place else below[i], "circle" if i in place else "runs into circle", back.get(i)


def _traversal(paths: bool):
    types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string())
    names = ["id", "root", "depth", "path", "descendants", "state", "back"]

    def emit(rows: list[tuple[str, str | None]]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in traverse(rows, paths):
            out.append(r)
            size += 1 + len(r[3] or ())
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for b in batches:
            for c, i, p in zip(*(b.column(k).to_pylist() for k in range(3))):
                if c != current and rows:
                    yield from emit(rows)
                    rows = []
                current = c
                rows.append((i, p))
        if rows:
            yield from emit(rows)

    return run


def _rings(loose: DataFrame) -> DataFrame:
    """(root, id, place) of the nodes of circles: place counts parent links from the root, which is the smallest id of the circle."""
    ring = cut(loose.where("id = root").select("root", "id", F.lit(0).cast("long").alias("place")), "ring")
    jumps, reach, known = loose.select("id", F.col("parent").alias("to")), 1, ring.count()
    while known:
        ahead = ring.join(jumps, "id").select("root", F.col("to").alias("id"), (F.col("place") + reach).alias("place"))
        ring = cut(ring.unionByName(ahead).groupBy("root", "id").agg(F.min("place").alias("place")), "ring")
        before, known = known, ring.count()
        if known == before:
            break
        jumps = cut(salted_left_join(jumps, jumps.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "id").select("id", F.col("next").alias("to")), "jumps")
        reach *= 2
    return ring


def _wide(big: DataFrame, paths: bool) -> DataFrame:
    """Nodes of components above the bound, by joins alone: the way up to a root or a circle doubles in each round."""
    ring = _rings(big.where("depth < 0"))
    marked = salted_left_join(big, ring.select(F.col("id").alias("parent"), F.col("place").alias("meets")), "parent", "id").join(ring.select("id", "place"), "id", "left")
    state = cut(marked.select("id", "root", "depth", "place", F.when(F.col("place") == 0, F.col("parent")).alias("back"), F.array("id").alias("tail"), F.coalesce("place", "meets").alias("meets"), F.when(F.col("place").isNull() & F.col("meets").isNull(), F.col("parent")).alias("up")), "wide")
    while state.where("up IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("id").alias("up"), F.col("tail").alias("more"), F.col("up").alias("next"), F.col("meets").alias("later"))
        joined = salted_left_join(state, ahead, "up", "id")
        state = cut(joined.select("id", "root", "depth", "place", "back", F.when(F.col("more").isNull(), F.col("tail")).otherwise(F.concat("tail", "more")).alias("tail"), F.coalesce("meets", "later").alias("meets"), F.col("next").alias("up")), "wide")
    below = state.select(F.explode(F.slice("tail", 2, F.size("tail"))).alias("id")).groupBy("id").agg(F.count("*").alias("below"))
    sizes = state.where("depth < 0").groupBy("root").agg(F.count("*").alias("n"))
    circles = ring.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("ring")) if paths else ring.select("root").distinct().withColumn("ring", F.lit(None).cast("array<string>"))
    full = salted_left_join(state.join(below, "id", "left"), sizes.join(circles, "root"), "root", "id")
    # Once around the circle, from where the way meets it.
    around = F.expr("concat(slice(ring, int(meets) + 1, size(ring)), slice(ring, 1, int(meets)))")
    path = F.when(F.col("depth") >= 0, F.reverse("tail")).when(F.col("place").isNotNull(), around).otherwise(F.concat("tail", around)) if paths else F.lit(None).cast("array<string>")
    descendants = F.when(F.col("place").isNotNull(), F.col("n") - 1).otherwise(F.coalesce("below", F.lit(0)))
    kind = F.when(F.col("depth") >= 0, "tree").when(F.col("place").isNotNull(), "circle").otherwise("runs into circle")
    return full.select("id", "root", F.col("depth").cast("int"), path.alias("path"), descendants.cast("long").alias("descendants"), kind.alias("state"), "back")


def hierarchies(df: DataFrame, key: str, parent: str, bound: int = BOUND, paths: bool = True) -> DataFrame:
    """(id, root, depth, path from root to node, number of descendants, state, back) of each node.

    ``back`` is not null at the smallest node of a circle only: the link from it is the back edge, as traversal begins there.
    The results don't depend on the bound. Without ``paths`` the path is null.
    """
    found = components(links(df, key, parent))
    sizes = found.groupBy("root").count()
    large = cut(sizes.where(F.col("count") > bound).select("root"), "large")
    small = found.join(large, "root", "left_anti")
    nodes = small.select("root", "id", "parent").repartition("root").sortWithinPartitions("root", "id").mapInArrow(_traversal(paths), _NODES)
    big = found.join(large, "root", "left_semi")
    if big.limit(1).count():
        nodes = nodes.unionByName(_wide(big, paths))
    return nodes


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, id, distance): every node below every node of the trees, one row a pair, so that no list grows without bound."""
    trees = nodes.where("depth >= 0")
    pairs = trees.select("id", "depth", F.posexplode("path").alias("level", "ancestor"))
    return pairs.where("ancestor <> id").select("ancestor", "id", (F.col("depth") - F.col("level")).alias("distance"))
