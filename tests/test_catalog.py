import difflib
import random

from pyspark.sql import functions as F

from veinstone.operators import catalogue as K
from veinstone.operators import chunking as C
from veinstone.operators import rollup
from veinstone.operators import similarity as S
from veinstone.plans import catalog, knowledge
from veinstone.sources.tables import table


def test_places_of_titles():
    text = "Intro\n3.2 Release  of\ncollateral\nbody\n4.1 Approval ordcr of loans\n"
    assert K.locate("Intro", text) == ("exact", 0)
    assert K.locate("3.2 Release of collateral", text) == ("compact", 6)
    how, at = K.locate("4.1 Approval order of loans", text)
    assert how == "line" and text[at:].startswith("4.1")
    assert K.locate("nothing like it at all", text)[0] == "missing" and K.locate(" ", text)[0] == "missing"
    assert K.locate("Intro", text, begin=3)[0] != "exact"


def test_packs_and_protected_blocks():
    assert K.pack([100, 300, 300, 900, 10, 10], 600) == [0, 0, 1, 2, 3, 3]
    assert K.pack([], 10) == []
    assert K.adjust([(0, 100), (100, 200)], [(80, 150)]) == [(0, 80), (80, 200)]
    assert K.adjust([(0, 100), (100, 200)], [(90, 110)]) == [(0, 110), (110, 200)]  # the first of equals
    assert K.adjust([(0, 100)], [(20, 40)]) == [(0, 100)]


def test_list_of_contents():
    toc = "\n".join(f"{i}.1 Title {i}" for i in range(1, 9))
    text = toc + "\n" + "body text. " * 200 + "\n1.1 Title 1\nmore"
    found, end = K.contents_list(text)
    assert found and end == len(toc)
    assert K.contents_list("no headings at all")[0] is False and K.contents_list("")[0] is False


def test_syntax_chunks_keep_paths_and_code():
    text = "# A\n" + "x" * 100 + "\n## B\n```\n# no heading\n```\n" + "y" * 100 + "\n# C\nshort\n# D\n" + "z" * 90
    got = K.syntax_chunks(text)
    assert [(p, level) for p, level, _, _ in got] == [("A", 1), ("A > B", 2), ("C", 1), ("D", 1)]
    assert "".join(text[a:b] for _, _, a, b in got) == text
    assert K.syntax_chunks("")[:1] == [] and K.syntax_chunks("plain text")[0][:2] == ("", 0)


def test_representative_text():
    text = "h" * 900 + "\nabc guarantee here\nnothing\n" + "t" * 700
    assert K.representative("short", ["x"]) == "short"
    assert "guarantee" in K.representative(text, ["guarantee"]) and "nothing" not in K.representative(text, ["guarantee"])


def test_nesting_of_headings_against_all_pairs():
    rng = random.Random(1)
    for _ in range(50):
        levels = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        for i, (end, parent) in enumerate(C.nest(levels)):
            assert end == next((j for j in range(i + 1, len(levels)) if levels[j] <= levels[i]), None)
            assert parent == max((j for j in range(i) if levels[j] < levels[i]), default=None)


def test_roll_up_from_below_against_recursion(spark):
    rng = random.Random(2)
    parent = {i: (rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(60)}
    text = {i: rng.choice([None, f"t{i}"]) for i in parent}
    allowed = {i: i % 5 != 0 for i in parent}
    depth = lambda i: 0 if parent[i] is None else depth(parent[i]) + 1
    kids = lambda i: [j for j in parent if parent[j] == i]

    def up(i):
        below = [v for j in sorted(kids(i), key=lambda j: (j % 3, f"n{j:02d}")) for v in up(j)]
        own = (";".join(below) if below else text[i]) if allowed[i] else None
        return [own] if own else below

    rows = [(f"n{i:02d}", None if p is None else f"n{p:02d}", depth(i), i % 3, text[i], allowed[i]) for i, p in parent.items()] + [("loop", "loop", -1, 0, "x", True)]
    df = spark.createDataFrame(rows, "id string, parent string, depth int, place int, text string, ok boolean")
    got = {r["id"]: r["value"] for r in rollup.bottom_up(df, lambda c: F.when(F.size(c) > 0, F.array_join(c, ";")).otherwise(F.col("text")), F.col("ok")).collect()}
    assert got == {f"n{i:02d}": v for i in parent if allowed[i] for v in [up(i)[0] if up(i) else None] if v is not None}
    assert rollup.bottom_up(df.limit(0), lambda c: F.array_join(c, ";")).count() == 0


def test_heading_match_loses_no_pair(spark, sf):
    def keys(t, c):
        return {r[0] for r in table(spark, sf, t, c).where(F.col(c).isNotNull()).select(K.key(F.col(c))).distinct().collect() if len(r[0]) >= 4}

    titles = keys("kb_section", "section_title")
    expected = {}
    for h in keys("kb_chunk_revision", "title"):
        if h in titles:
            expected[h] = 1.0
            continue
        best = max((0.9 if h in t or t in h else difflib.SequenceMatcher(None, h, t, autojunk=False).ratio() if min(len(h), len(t)) >= 6 else 0.0) for t in titles)
        if round(best, 6) >= 0.82:
            expected[h] = round(best, 6)
    got = {r["h"]: r["ratio"] for r in catalog.heading_match(spark, sf).collect()}
    assert got == expected


def test_merging_of_passes_loses_no_pair(spark, sf):
    rows = knowledge.pass_merge(spark, sf).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["file_node_id"], r["anchor_type"]), {})[r["label"]] = r["stands_for"]
    for members in groups.values():
        for a, stands in members.items():
            near = [b for b in members if b != a and S.overlap(a, b) >= 0.72]
            assert (stands == a) or (stands in near)
            if not near:
                assert stands == a


def _broadcast_explodes(df):
    """Whether the plan, before anything is run, broadcasts rows that explode has multiplied."""
    def walk(node, under):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan(), under)
        under = under or name.startswith("BroadcastExchange")
        return under and name == "Generate" or any([walk(node.children().apply(i), under) for i in range(node.children().size())])

    return walk(df._jdf.queryExecution().executedPlan(), False)


def test_merging_of_passes_broadcasts_no_parts(spark, sf):
    assert not _broadcast_explodes(knowledge.pass_merge(spark, sf))


def test_merging_of_passes_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    rows = {("".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))): rng.choice([None, 0.5, 0.9]) for _ in range(150)} | {"a" * 30: 0.5, "a" * 25 + "b": 0.9, "abcdefgh" * 9: None}
    at = [(None, "t"), (1, None), (1, "t"), (2, "t")]
    data = [(f, k, name, c) for f, k in at for name, c in rows.items()]
    spark.createDataFrame(data, "file_node_id long, anchor_type string, anchor_name string, confidence double").write.parquet(f"{tmp_path}/kb_anchor_registry.parquet")
    own = {a: (c or 0.0, len(a), a) for a, c in rows.items() if len(a) >= 3}
    merged = {a: max(own[b] for b in own if b == a or S.overlap(a, b) >= 0.72)[2] for a in own}
    got = {(r["file_node_id"], r["anchor_type"], r["label"]): r["stands_for"] for r in knowledge.pass_merge(spark, str(tmp_path)).collect()}
    assert got == {(f, k, a): a if f is None or k is None else merged[a] for f, k in at for a in own}


def test_windows_are_as_long_as_the_overlap_asks():
    assert all(S.window_size(n) == min(m for m in range(n + 1) if m / n >= 0.72) for n in range(3, 2000))


def _headings(spark, at, headings, titles):
    spark.createDataFrame([(x,) for x in headings], "title string").write.parquet(f"{at}/kb_chunk_revision.parquet")
    spark.createDataFrame([(x,) for x in titles], "section_title string").write.parquet(f"{at}/kb_section.parquet")
    return catalog.heading_match(spark, str(at))


def test_heading_match_broadcasts_no_pairs_of_characters(spark, sf):
    assert not _broadcast_explodes(catalog.heading_match(spark, sf))


def test_heading_match_of_keys_that_repeat_pairs(spark, tmp_path):
    rows = _headings(spark, tmp_path, ["aaaaacbaaaabba", "abcde", "xyzw"], ["aaaaabdaaaabba", "abcdefgh", None]).collect()
    ratio = round(difflib.SequenceMatcher(None, "aaaaacbaaaabba", "aaaaabdaaaabba", autojunk=False).ratio(), 6)
    assert {(r["h"], r["t"], r["ratio"]) for r in rows} == {("aaaaacbaaaabba", "aaaaabdaaaabba", ratio), ("abcde", "abcdefgh", 0.9)}
