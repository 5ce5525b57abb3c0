import random
import string

import pytest
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import chunking as C
from veinstone.operators import evidence as E
from veinstone.operators import graph as G
from veinstone.operators import ranking, similarity as S
from veinstone.streaming import feed


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv_and_text_expressions(spark):
    words = ["", "a", "hello", "section_8f6b7d", "Zürich", "担保"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r["w"]: r["h"] for r in df.select("w", T.fnv1a(F.col("w")).alias("h")).collect()}
    assert all(got[w] == fnv(w) for w in words if w)
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x()</script> c",)], "h string")
    assert html.select(T.html_text(F.col("h"))).first()[0] == "a & b c"


@pytest.mark.parametrize("seed", range(5))
def test_split_content_covers_and_keeps_the_limit(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(string.ascii_lowercase + "。；\n;") for _ in range(rng.randint(0, 3000)))
    p = C.split_content(t, 200, 20)
    assert all(b - a <= 200 for a, b in p)
    assert not t or (p[0][0] == 0 and p[-1][1] == len(t) and all(b >= c for (_, b), (c, _) in zip(p, p[1:])))


def test_windows_and_merging():
    assert C.windows([5, 5, 5, 5], 10, 1) == [(0, 2), (1, 3), (2, 4)]
    assert C.windows([], 10, 1) == [] and C.windows([50], 10, 1) == [(0, 1)]
    assert C.merge_small([100, 10, 100, 10], 50) == [0, 1, 1, 1]
    assert C.merge_small([10], 50) == [0]


def test_html_tables():
    t = C.html_tables("<table><tr><th>a</th><th>b</th></tr><tr><td>1 &lt; 2</td></tr></table>")
    assert t == [[["a", "b"], ["1 < 2", ""]]]
    assert C.table_markdown(t[0]).splitlines()[0] == "| a | b |"
    assert C.compact_table(t[0]) == "[表格: a | b | 1 < 2]"
    assert C.html_tables(None) == []


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.randint(0, 2), a := rng.randint(0, 300), a + rng.randint(0, 80)) for i in range(n)]
    a, b = make(80), make(80)
    x = spark.createDataFrame(a, "a long, g long, a0 long, a1 long")
    y = spark.createDataFrame(b, "b long, g long, b0 long, b1 long")
    got = sorted((r["a"], r["b"]) for r in C.overlap_join(x, y, ["g"], ("a0", "a1"), ("b0", "b1"), 32).collect())
    assert got == sorted((i, j) for i, g, p, q in a for j, h, r, s in b if g == h and p < s and r < q and p < q and r < s)


def test_alignment():
    text = "Die Akte wird\n3 Jahre aufbewahrt und danach geschlossen."
    assert S.align("3 Jahre", text) == ("exact", 14, 21)
    state, a, b = S.align("akte wird 3 jahre", text)
    assert state == "compact" and text[a:b] == "Akte wird\n3 Jahre"
    state, a, b = S.align("Akte wjrd 3 Jahre aufbewahrt", text)
    assert state == "subsequence" and "Jahre" in text[a:b]
    long = "".join(chr(0x4E00 + i % 3000) for i in range(3000))  # over 1.5 million pairs of characters
    state, a, b = S.align("x".join(long[i : i + 90] for i in range(900, 1800, 90)), long)
    assert state == "blocks" and (a, b) == (900, 1800)
    assert S.common_subsequence("abcbdab", "bdcaba") in ([1, 2, 3, 5], [1, 3, 5, 6], [1, 2, 5, 6], [3, 4, 5, 6]) or len(S.common_subsequence("abcbdab", "bdcaba")) == 4
    assert S.align("ganz anderes", text)[0] == "failed" and S.align("", text)[0] == "failed"
    assert S.overlap("abc", "xabcx") == 1.0


def test_near_labels_find_close_names(spark):
    names = ["orchardcreditline", "orchardcreditlime", "harvestadvancecover", "bidbondfacility"]
    df = spark.createDataFrame([(1, n) for n in names] * 2, "f int, label string")
    assert [(r["a"], r["b"]) for r in S.near_labels(df, ["f"]).collect()] == [("orchardcreditlime", "orchardcreditline")]


def test_near_labels_find_all_containment(spark):
    names = ["档案室rv7", "档案室rv7234", "xy档案室rv7", "orchard", "theorchardfee", "orchardcreditline", "abc", "abcd"]
    df = spark.createDataFrame([(f, n) for f in (1, 2) for n in names], "f int, label string")
    expected = {(f, *sorted((a, b))) for f in (1, 2) for a in names for b in names if a != b and a in b and len(a) >= 4 and len(b) - len(a) <= 6}
    got = [(r["f"], r["a"], r["b"]) for r in S.near_labels(df, ["f"]).where("similarity = 0.9").collect()]
    assert len(got) == len(set(got)) and expected <= set(got) and (1, "档案室rv7", "档案室rv7234") in expected


def test_search_exact_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[5] = v[9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = {}
    for r in S.search_exact(df, df.where("id % 10 = 0"), "id", "v", 3, block=2).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = (u @ u[q]).round(6)
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == [int(i) for i in np.lexsort((np.arange(60), -s))[:3]]


def test_fusion_doesnt_depend_on_order_and_first_place_counts(spark):
    rows = [("a", 1, 3.0, 1), ("a", 2, 2.0, 2), ("a", 1, 1.0, 3), ("b", 2, 9.0, 1)]
    out = []
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "route string, k long, score double, rank int")
        out.append(sorted((x["k"], round(x["score"], 9), x["channels"]) for x in ranking.fuse(df, "k", {"a": 0.6, "b": 0.4}, "weighted_rrf").collect()))
    assert out[0] == out[1]
    assert out[0][0] == (1, round(0.6 / 61, 9), 1) and out[0][1] == (2, round(0.6 / 62 + 0.4 / 61 + 0.005, 9), 2)


def test_propagation_and_names():
    edges = {}
    for a, b in [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]:
        edges.setdefault(a, {})[b] = edges.setdefault(b, {})[a] = 1.0
    label = G.propagate(edges)
    assert label["a"] == label["b"] == label["c"] != label["x"] == label["y"] == label["z"]
    names = G.stable_names({"1": {"a", "b", "c"}, "2": {"q"}}, {"old": {"a", "b"}})
    assert names["1"] == "old" and len(names["2"]) == 16


def test_diversity_and_cover():
    rows = [(1, "s", "f"), (2, "s", "f"), (3, "s", "f"), (4, "t", "f"), (5, "u", "g")]
    assert E.diversify(rows, 2, 2, 4) == [1, 2, 5, 3]
    assert E.cover_anchors([(1, 0.9, {"x"}), (2, 0.8, {"x", "y"}), (3, 0.7, set())], ["x", "y"], 3) == [1, 2, 3]


def test_signature_is_independent_of_order(spark):
    df = spark.range(50).selectExpr("id % 3 AS g", "id AS v")
    sig = lambda d: sorted(tuple(r) for r in E.snapshot_signature(d, ["g"], ["v"]).collect())
    assert sig(df) == sig(df.orderBy(F.desc("v")).repartition(3)) != sig(df.where("v > 0"))


def test_stream_and_batch_agree(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = feed.read_feed(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = feed.run_once(feed.rate_windows(s, 3600), "update")
    last = windows.groupBy("begin", "user_id", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    stale = feed.run_once(feed.stale_tasks(s))
    assert set(stale.columns) == {"key", "last", "state"}


@pytest.mark.parametrize("name", ["k", "t", "_salt", "n", "id"])
def test_clashing_column_names_do_no_harm(spark, name):
    df = spark.createDataFrame([(1, "a b", "z"), (2, None, "z")], f"doc long, body string, `{name}` string")
    assert ranking.document_frequency(df, "doc", F.col("body")).count() == 2
    assert C.per_text(df, "doc", "body", "size int", lambda t: [(len(t),)]).collect()[0]["size"] == 3


def test_labels_dont_depend_on_the_size_of_a_component(spark):
    import random

    rng = random.Random(3)
    rows = [(c, f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}", rng.choice([0.01, 0.5, 1.0])) for c in (1, 2) for _ in range(40)]
    df = spark.createDataFrame(rows, "file int, src string, dst string, weight double")
    labels = lambda bound: sorted(tuple(r) for r in G.communities_in_components(df, "file", bound=bound).collect())
    assert labels(0) == labels(1_000)


def test_label_propagation_covers_the_largest_file(spark, sf):
    from veinstone.plans import graphs

    s = spark.read.parquet(f"{sf}/kb_section.parquet")
    linked = s.join(s.select(F.col("section_id").alias("parent_section_id")).distinct(), "parent_section_id", "left_semi").where("file_node_id = 880001").select("section_id").distinct()
    assert linked.count() > 0
    assert linked.join(graphs.label_propagation(spark, sf), F.col("section_id") == F.col("node"), "left_anti").count() == 0
