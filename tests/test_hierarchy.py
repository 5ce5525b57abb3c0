import random

import pytest

from veinstone.operators import hierarchy as H

SCHEMA = "section_id string, parent_section_id string, root string, depth int"


def brute(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None:
            parent.setdefault(i, set())
            if p is not None and p.strip():
                parent[i].add(p)
    up = {i: min((p for p in ps if p in parent), default=None) for i, ps in parent.items()}
    out = {}
    for i in up:
        way, at = [], i
        while at is not None and at not in way:
            way.append(at)
            at = up[at]
        out[i] = (way[-1], len(way) - 1) if at is None else (min(way[way.index(at) :]), -1)
    return out, up


def rows(spark, pairs):
    return spark.createDataFrame([(i, p, "x", 7) for i, p in pairs], SCHEMA)


def found(df, **kw):
    return {r["id"]: r for r in H.hierarchies(df, "section_id", "parent_section_id", **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bound", [100_000, 3])
def test_random_links_against_brute_force(spark, seed, bound):
    rng = random.Random(seed)
    ids = [f"s{i:03d}" for i in range(120)]
    pairs = [(i, rng.choice([None, "", "  ", "absent", *ids, *ids[:3], *ids[:3]])) for i in ids]
    pairs += [(f"d{i}", f"d{i - 1}" if i else None) for i in range(40)]  # a deep one
    pairs += [("self", "self"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t1", "r2"), ("t2", "t1"), (None, "s000")]
    pairs += pairs[:30]  # delivered twice
    rng.shuffle(pairs)
    expected, up = brute(pairs)
    got = found(rows(spark, pairs), bound=bound)
    assert {i: (r["root"], r["depth"]) for i, r in got.items()} == expected
    for i, r in got.items():
        if r["depth"] >= 0:
            assert r["path"][0] == r["root"] and r["path"][-1] == i and len(r["path"]) == r["depth"] + 1
            assert all(up[c] == p for p, c in zip(r["path"], r["path"][1:]))
            assert r["descendants"] == sum(1 for j, x in got.items() if x["depth"] >= 0 and i in x["path"][:-1])


def test_circles_are_told_from_what_runs_into_them(spark):
    got = found(rows(spark, [("b", "a"), ("a", "c"), ("c", "b"), ("x", "a"), ("y", "x"), ("o", None)]))
    assert {i: r["state"] for i, r in got.items()} == {"a": "circle", "b": "circle", "c": "circle", "x": "runs into circle", "y": "runs into circle", "o": "tree"}
    assert all(got[i]["root"] == "a" for i in "abcxy")


def test_star_with_most_rows_under_one_parent(spark):
    got = found(rows(spark, [("hub", None), *((f"n{i}", "hub") for i in range(500))]), bound=50)
    assert got["hub"]["descendants"] == 500 and got["n7"]["path"] == ["hub", "n7"]


def test_empty_and_descendants(spark):
    assert found(rows(spark, [])) == {}
    nodes = H.hierarchies(rows(spark, [("a", None), ("b", "a"), ("c", "b")]), "section_id", "parent_section_id")
    assert sorted(tuple(r) for r in H.descendants(nodes).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_two_parents_take_the_smallest_existing(spark):
    got = found(rows(spark, [("a", None), ("b", None), ("c", "b"), ("c", "a"), ("d", "zz"), ("d", "b")]))
    assert got["c"]["root"] == "a" and got["d"]["root"] == "b"


def test_deep_chain_takes_no_recursion():
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 20_000)]
    got = {r[0]: r for r in H.traverse(rows, paths=False)}
    assert got["n19999"][2] == 19_999 and got["n0"][4] == 19_999
    assert next(r for r in H.traverse(rows[:50]) if r[0] == "n49")[3][:2] == ["n0", "n1"]


@pytest.mark.parametrize("ring", [1, 2, 7])
def test_circles_dont_depend_on_the_bound(spark, ring):
    rng = random.Random(ring)
    pairs = [(f"m{i:02d}", f"m{(i + 1) % ring:02d}") for i in range(ring)] + [("t00", "m00"), *((f"t{i:02d}", rng.choice([f"t{rng.randrange(i):02d}", f"m{rng.randrange(ring):02d}"])) for i in range(1, 25))]
    pairs += [("o", None), ("p", "o"), ("q", "p")]
    small, large = (found(rows(spark, pairs), bound=b) for b in (1_000, 2))
    assert small == large and {r["state"] for r in large.values()} == {"tree", "circle", "runs into circle"}
    assert {i: r["state"] for i, r in found(rows(spark, pairs), bound=2, paths=False).items()} == {i: r["state"] for i, r in small.items()}


@pytest.mark.parametrize("bound", [100_000, 2])
def test_back_edges(spark, bound):
    """One back edge a circle, at its smallest node, whatever the bound."""
    got = found(rows(spark, [("b", "a"), ("a", "c"), ("c", "b"), ("x", "a"), ("self", "self"), ("o", None), ("p", "o")]), bound=bound)
    assert {i: (r["back"], r["path"]) for i, r in got.items() if r["back"] is not None} == {"a": ("c", ["a", "c", "b"]), "self": ("self", ["self"])}
