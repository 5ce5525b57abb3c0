import pytest

from veinstone.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n long, copies string")
    sources = M.read_sources(df, "source", "n", spark.createDataFrame(targets, TARGETS))
    total, _ = M.plan(sources, **kw)
    mixed = M.mix(df, "doc_id", "source", "n", sources)
    return sources, mixed, {r["source"]: r for r in M.report(mixed, sources).collect()}, total


def test_targets_that_can_be_met_are_met(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 7) for i in range(300)]
    _, mixed, report, total = mix(spark, docs, [("a", 0.7, 2), ("b", 0.3, 4)])
    assert report["a"]["actual_share"] == pytest.approx(0.7, abs=0.01) and report["b"]["actual_share"] == pytest.approx(0.3, abs=0.01)
    assert sum(r["used_tokens"] for r in report.values()) == pytest.approx(total, rel=0.01)
    assert report["b"]["most_copies"] <= 4


def test_caps_missing_sources_and_strange_rows(spark):
    docs = [(i, "a", 10) for i in range(500)] + [(900 + i, "tiny", 10) for i in range(3)] + [(990, None, 10), (991, "other", 10), (992, "a", 0), (1, "a", 10)]
    _, mixed, report, _ = mix(spark, docs, [("a", 0.5, 1), ("tiny", 0.4, 3), ("none", 0.1, 2)])
    assert report["tiny"]["used_tokens"] == 90 and report["tiny"]["state"] == "capped" and report["tiny"]["most_copies"] == 3
    assert report["none"]["used_tokens"] == 0 and report["none"]["state"] == "no documents"
    assert report["a"]["most_copies"] == 1
    ids = {r["doc_id"] for r in mixed.collect()}
    assert not ids & {990, 991, 992}


def test_records_of_a_block_are_used_equally_often(spark):
    docs = [(i, "a", 5) for i in range(400)] + [(1000 + i, "b", 5) for i in range(100)]
    _, mixed, _, _ = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 9)])
    b = [r["copies"] for r in mixed.collect() if r["source"] == "b"]
    assert len(b) == 100 and set(b) <= {2, 3}


def test_temperature_meets_the_entropy():
    aim = M.entropy([0.4, 0.6])
    _, got = M.temperature(30.0, [40.0, 60.0], [10.0, 500.0], [1e9, 1e9], aim)
    assert sum(got) == pytest.approx(30.0) and M.entropy([40 + got[0], 60 + got[1]]) == pytest.approx(aim, abs=1e-3)
    assert M.spread(10.0, [1.0, 100.0], [5.0, 5.0]) == pytest.approx([1.0, 9.0])


def test_empty(spark):
    _, mixed, report, _ = mix(spark, [], [("a", 1.0, 1)])
    assert mixed.count() == 0 and report["a"]["actual_share"] in (0.0, None)


def test_each_source_has_the_exponent_of_its_target():
    sources = [M.Source("a", 0.7, 2, 900, 90), M.Source("b", 0.25, 9, 90, 9), M.Source("c", 0.05, 1, 10, 1), M.Source("none", 0.0, 1)]
    total, _ = M.plan(sources)
    for s in sources[:2]:
        assert (s.tokens / 1000) ** s.exponent == pytest.approx(s.target, rel=1e-6)
    assert sources[2].state == "capped" and (10 / 1000) ** sources[2].exponent == pytest.approx(10 / total, rel=1e-6)
    assert sources[3].exponent is None and sum(s.budget for s in sources) == pytest.approx(total)
    assert M.exponent_for(1.0, 0.5) is None and M.exponent_for(0.0, 0.5) is None and M.exponent_for(0.5, 0.0) is None


def test_order_is_blocks_of_permutations(spark):
    docs = [(i, "a", 5 + i % 7) for i in range(1500)] + [(5000 + i, "b", 6) for i in range(200)]
    _, mixed, report, _ = mix(spark, docs, [("a", 0.6, 1), ("b", 0.4, 9)])
    rows = M.order(mixed, "doc_id", 1000).orderBy("block", "place").collect()
    assert len(rows) == sum(r["copies"] for r in mixed.collect())
    used, passes = {}, {}
    for r in rows:
        passes.setdefault((r["source"], r["pass"]), []).append(r["doc_id"])
        used.setdefault(r["block"], {}).setdefault(r["source"], []).append(r["tokens"])
    blocks = sorted(used)
    assert blocks == list(range(len(blocks)))
    for b in blocks[:-1]:
        assert sum(used[b]["a"]) == pytest.approx(1000 * report["a"]["actual_share"], abs=24) and sum(used[b]["b"]) == pytest.approx(1000 * report["b"]["actual_share"], abs=24)
    # Whole passes hold every record once, in orders that differ from pass to pass.
    first, second = passes["b", 0], passes["b", 1]
    assert sorted(first) == sorted(second) == list(range(5000, 5200)) and first != second
    assert M.order(mixed.limit(0), "doc_id").count() == 0
