import numpy as np
import pytest

from veinstone.llm import neighbours as N

DIM = 16
SCHEMA = "chunk_id long, id string, q int, v array<float>"


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == DIM and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(9)
    np.fill_diagonal(s, -9)
    out = {}
    for a, i in enumerate(ids):
        order = np.lexsort((ids, -s[a]))[: min(k, len(ids) - 1)]
        out[i] = [(ids[j], s[a][j]) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", 1, v) for i, v in rows], SCHEMA)


def search(df, **kw):
    out = {}
    for r in N.nearest(df, "chunk_id", "v", DIM, **kw).collect():
        out.setdefault(r["id"], []).append((r["place"], r["other"]))
    return {i: [o for _, o in sorted(v)] for i, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, DIM))
    out = [(i, (centres[i % 40] + 0.1 * rng.standard_normal(DIM)).astype(np.float32).tolist()) for i in range(600)]
    one = rng.standard_normal(DIM).astype(np.float32).tolist()
    out += [(1000 + i, one) for i in range(200)]  # a quarter of all rows are copies
    out += [(1500, (2 * np.float32(one)).tolist())]
    return out + out[:50]


def test_all_pairs_above_the_least(spark, rows):
    expected = brute(dict(rows).items(), 10)
    wanted = {(min(i, j), max(i, j)) for i, n in expected.items() for j, s in n if s >= 0.9}
    near = N.nearest(frame(spark, rows), "chunk_id", "v", DIM, k=10, least=0.9, recall=0.999, leaf=64)
    got = {tuple(r) for r in N.close_pairs(near, 0.9, "a", "b").collect()}
    assert len(got & wanted) >= 0.99 * len(wanted) and len(got - wanted) <= 0.01 * len(wanted)
    assert {(1000, 1001), (1000, 1500), (1005, 1199)} <= got  # ties go by smaller id; every copy has its nearest


def test_recall_without_a_least_cosine(spark, rows):
    expected = brute(dict(rows).items(), 10)
    got = search(frame(spark, rows), k=10, trees=12, leaf=128)
    hits = sum(len({j for j, _ in expected[i]} & set(got.get(i, []))) for i in expected if i < 1000)
    assert hits / sum(len(expected[i]) for i in expected if i < 1000) >= 0.9


def test_unusable_vectors(spark):
    e = np.eye(DIM, dtype=np.float32)
    bad = [(1, None), (2, []), (3, [0.0] * DIM), (4, [float("nan")] * DIM), (5, [1.0] * 3), (6, [float("inf")] + [0.0] * (DIM - 1)), (None, e[0].tolist()), (7, [None] + [1.0] * (DIM - 1))]
    good = [(10, e[0].tolist()), (11, (e[0] * 1e-30).tolist()), (12, e[1].tolist()), (10, e[0].tolist())]
    got = search(frame(spark, bad + good), k=10)
    assert got == {10: [11, 12], 11: [10, 12], 12: [10, 11]}
    assert search(frame(spark, []), k=10) == {} and search(frame(spark, good[:1]), k=10) == {}


def test_ranges_are_the_longest_prefix_matches():
    rng = np.random.default_rng(0)
    h = np.sort(np.concatenate([rng.integers(0, 1 << N.BITS, 1000), np.full(300, 12345)]))
    level = rng.integers(0, N.BITS + 1, len(h))
    seen = np.zeros(len(h), int)
    for rows, a, b in N.matches(h, level):
        for r in rows:
            same = (h >> np.int64(N.BITS - level[r])) == (h[r] >> np.int64(N.BITS - level[r]))
            assert same[a:b].all() and same.sum() == b - a
        seen[rows] += 1
    assert (seen == 1).all()


def test_the_ascent_ends_at_one_level_in_all_trees():
    rng = np.random.default_rng(1)
    x = N.unit(rng.standard_normal((4000, DIM)))
    f = N.Forest(x, len(x), 5, 50, 3)
    levels = np.array([level for _, _, level in f.place(x)])
    assert (levels == levels[0]).all()
    sizes = lambda by: sum(t.size(t.strings(x), by) for t in f.trees)
    assert (sizes(levels[0]) >= 250).all() and (sizes(np.minimum(N.BITS, levels[0] + 1)) < 250).all()


def test_quantised_forms():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1, 97))
    x = N.unit(np.concatenate([base + 0.3 * rng.standard_normal((300, 97)), rng.standard_normal((300, 97))]))
    exact = x @ x.T
    for bits in (8, 4):
        q = N.quantise(x, bits)
        y = N.dequantise(q.tobytes(), 600, 97, bits)
        near = exact >= 0.85
        assert near.sum() > 10_000 and (exact - y @ y.T)[near].max() <= N.SLACK[bits]


def test_a_crowd_of_near_copies_is_searched_like_any_other(spark):
    """Vectors whose strings are all equal get bits of their own: none is lost for being in a crowd."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(DIM)
    crowd = [(i, (base + 0.02 * rng.standard_normal(DIM)).astype(np.float32).tolist()) for i in range(1500)]
    rest = [(5000 + i, rng.standard_normal(DIM).astype(np.float32).tolist()) for i in range(300)]
    tree = N.Forest(N.unit(np.array([v for _, v in crowd + rest], np.float32)), 1800, 3, 16, 7)
    assert any(t.crowds for t in tree.trees) or tree.parts > 3
    expected = brute(crowd + rest, 10)
    got = search(frame(spark, crowd + rest), k=10, trees=24, leaf=64)
    hits = sum(len({j for j, _ in expected[i]} & set(got.get(i, []))) for i, _ in crowd)
    assert hits / sum(len(expected[i]) for i, _ in crowd) >= 0.9


def test_trees_follow_the_theory():
    assert N.trees_needed(100, 1000, 0.9, 0.99) <= 2
    assert N.trees_needed(10**6, 1000, 0.9, 0.99) > N.trees_needed(10**6, 1000, 0.97, 0.99)
