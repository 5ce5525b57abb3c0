"""Queries on a property graph: files, sections, chunks, anchors and the links between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinstone.operators import graph as G
from veinstone.sources.tables import table


def _edges(spark, sf):
    """Edges of the knowledge base: section in file, chunk in section, anchor evidenced by chunk, section under section."""
    s = table(spark, sf, "kb_section", "section_id", "file_node_id", "parent_section_id").distinct()
    c = table(spark, sf, "kb_chunk", "id", "section_id").where("section_id IS NOT NULL")
    a = table(spark, sf, "kb_anchor_registry", "anchor_id", "source_chunk_id", "confidence").where("source_chunk_id IS NOT NULL").distinct()
    name = lambda kind, col: F.concat(F.lit(kind + ":"), F.col(col).cast("string"))
    w = lambda x: F.lit(x).cast("double")
    return (
        s.select(name("s", "section_id").alias("src"), name("f", "file_node_id").alias("dst"), F.lit("IN_FILE").alias("type"), w(0.5).alias("weight"))
        .unionByName(c.select(name("c", "id").alias("src"), name("s", "section_id").alias("dst"), F.lit("IN_SECTION").alias("type"), w(0.8).alias("weight")))
        .unionByName(a.select(name("a", "anchor_id").alias("src"), name("c", "source_chunk_id").alias("dst"), F.lit("EVIDENCED_BY").alias("type"), G.edge_weight(F.lit(0.3), F.col("confidence").cast("double")).alias("weight")))
        .unionByName(s.where("trim(parent_section_id) <> ''").select(name("s", "section_id").alias("src"), name("s", "parent_section_id").alias("dst"), F.lit("UNDER").alias("type"), w(0.7).alias("weight")))
    )


def _nodes(spark, sf):
    name = lambda kind, df, col: df.select(F.concat(F.lit(kind + ":"), F.col(col).cast("string")).alias("node"), F.lit(kind).alias("type"))
    parts = [("f", "kb_chunk", "file_node_id"), ("s", "kb_section", "section_id"), ("c", "kb_chunk", "id"), ("a", "kb_anchor_registry", "anchor_id")]
    out = None
    for kind, t, col in parts:
        n = name(kind, table(spark, sf, t, col).where(F.col(col).isNotNull()).distinct(), col)
        out = n if out is None else out.unionByName(n)
    return out


def graph_stats(spark, sf):
    """Edges by type."""
    return _edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


def graph_degree(spark, sf):
    """Degree of each node."""
    return G.degrees(_edges(spark, sf))


def graph_hubs(spark, sf):
    """Nodes of degree 20 or more."""
    return G.degrees(_edges(spark, sf)).where("degree >= 20")


def graph_isolates(spark, sf):
    """Nodes without an edge."""
    return G.isolates(_nodes(spark, sf), _edges(spark, sf))


def schema_filter(spark, sf):
    """Edges left if only sections and chunks are allowed."""
    return G.allowed(_nodes(spark, sf), _edges(spark, sf), ["s", "c"], ["IN_SECTION", "UNDER"])[1].groupBy("type").agg(F.count("*").alias("n"))


def confidence_labels(spark, sf):
    """Summaries by confidence label; what is no known label is UNKNOWN."""
    c = F.upper(F.col("confidence"))
    return table(spark, sf, "kb_section_summary", "confidence").groupBy(F.when(c.isin("HIGH", "MEDIUM", "LOW"), c).otherwise("UNKNOWN").alias("label")).agg(F.count("*").alias("n"))


def graph_seed_expand(spark, sf):
    """The ten best paths of one and two edges from each chunk whose id is divisible by 50."""
    seeds = table(spark, sf, "kb_chunk", "id").where("id % 50 = 0").select(F.col("id").alias("seed"), F.concat(F.lit("c:"), F.col("id").cast("string")).alias("node"))
    return G.expand(seeds, _edges(spark, sf), 10, 0.3).select("seed", "node", "hops", F.round("score", 6).alias("score"), "place")


def graph_subgraph(spark, sf):
    """Edges between the nodes of sections and chunks of the largest file."""
    s = table(spark, sf, "kb_section", "section_id", "file_node_id").where("file_node_id = 880001").select(F.concat(F.lit("s:"), "section_id").alias("node")).distinct()
    c = table(spark, sf, "kb_chunk", "id", "file_node_id").where("file_node_id = 880001").select(F.concat(F.lit("c:"), F.col("id").cast("string")).alias("node"))
    return G.induced(_edges(spark, sf), s.unionByName(c)).groupBy("type").agg(F.count("*").alias("n"))


def graph_delta_stale(spark, sf):
    """Edges that go when deleted chunks go."""
    e = _edges(spark, sf)
    gone = table(spark, sf, "kb_chunk", "id", "del_flag").where("del_flag").select(F.concat(F.lit("c:"), F.col("id").cast("string")).alias("node"))
    kept = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return G.stale(e, kept, ["src", "dst", "type"]).select("src", "dst", "type")


def graph_merge(spark, sf):
    """Anchors merged by base and name: the best confidence wins."""
    a = table(spark, sf, "kb_anchor_registry", "id", "kb_id", "anchor_name", "anchor_type", "confidence").distinct()
    return G.merge(a, ["kb_id", "anchor_name"], ["confidence", "id"], "id", "anchor_type")


def surprise_score(spark, sf):
    """Anchors by surprise: 3 for an uncertain one, 2 if its chunk is of another file, 1 if the chunk is a hub."""
    a = table(spark, sf, "kb_anchor_registry", "id", "file_node_id", "source_chunk_id", "confidence").where("source_chunk_id IS NOT NULL").distinct()
    c = table(spark, sf, "kb_chunk", "id", "file_node_id").select(F.col("id").alias("source_chunk_id"), F.col("file_node_id").alias("other"))
    d = a.groupBy("source_chunk_id").agg(F.count("*").alias("degree"))
    j = a.join(c, "source_chunk_id").join(d, "source_chunk_id")
    score = F.when(F.coalesce("confidence", F.lit(0)) < 0.5, 3).otherwise(0) + F.when(F.col("other") != F.col("file_node_id"), 2).otherwise(0) + F.when(F.col("degree") >= 5, 1).otherwise(0)
    return j.select("id", score.alias("score"))


def _section_edges(spark, sf):
    s = table(spark, sf, "kb_section", "section_id", "file_node_id", "parent_section_id").distinct()
    ids = s.select(F.col("section_id").alias("parent_section_id")).distinct()
    return s.join(ids, "parent_section_id", "left_semi").select(F.col("file_node_id").alias("component"), F.col("section_id").alias("src"), F.col("parent_section_id").alias("dst"), F.lit(1.0).alias("weight"))


def label_propagation(spark, sf):
    """Communities of sections within each file, the largest one too, in place."""
    return G.communities_in_components(_section_edges(spark, sf), "component")


def community_density(spark, sf):
    """Size and density of the communities of one synchronous round."""
    e = _section_edges(spark, sf)
    return G.density(e, G.synchronous_labels(e, 1))


def synchronous_round(spark, sf):
    """Labels of sections after one synchronous round."""
    return G.synchronous_labels(_section_edges(spark, sf), 1)


_E = """s AS (SELECT DISTINCT section_id, file_node_id, parent_section_id FROM kb_section),
    an AS (SELECT DISTINCT anchor_id, source_chunk_id, confidence FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL),
    e AS (SELECT 's:' || section_id AS src, 'f:' || file_node_id AS dst, 'IN_FILE' AS type, 0.5::DOUBLE AS weight FROM s
      UNION ALL SELECT 'c:' || id, 's:' || section_id, 'IN_SECTION', 0.8::DOUBLE FROM kb_chunk WHERE section_id IS NOT NULL
      UNION ALL SELECT 'a:' || anchor_id, 'c:' || source_chunk_id, 'EVIDENCED_BY', least(1.0, greatest(0.05, 0.3, coalesce(confidence::DOUBLE, 0))) FROM an
      UNION ALL SELECT 's:' || section_id, 's:' || parent_section_id, 'UNDER', 0.7::DOUBLE FROM s WHERE trim(parent_section_id) <> ''),
    y AS (SELECT src, dst, type, weight FROM e UNION ALL SELECT dst, src, type, weight FROM e),
    n AS (SELECT DISTINCT 'f:' || file_node_id AS node, 'f' AS type FROM kb_chunk WHERE file_node_id IS NOT NULL UNION ALL SELECT DISTINCT 's:' || section_id, 's' FROM kb_section
      UNION ALL SELECT 'c:' || id, 'c' FROM kb_chunk UNION ALL SELECT DISTINCT 'a:' || anchor_id, 'a' FROM kb_anchor_registry WHERE anchor_id IS NOT NULL)"""
_SE = "se AS (SELECT DISTINCT section_id AS src, parent_section_id AS dst FROM kb_section WHERE parent_section_id IN (SELECT section_id FROM kb_section)), sy AS (SELECT * FROM se UNION ALL SELECT dst, src FROM se), v AS (SELECT src, dst AS label, count(*) AS w FROM sy GROUP BY ALL), lab AS (SELECT src AS node, label FROM v QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, label) = 1)"

CATALOGUE = {
    "graph_stats": (graph_stats, f"WITH {_E} SELECT type, count(*) AS n, round(avg(weight), 6) AS weight FROM e GROUP BY type"),
    "graph_degree": (graph_degree, f"WITH {_E} SELECT src AS node, count(*) AS degree FROM y GROUP BY src"),
    "graph_hubs": (graph_hubs, f"WITH {_E} SELECT src AS node, count(*) AS degree FROM y GROUP BY src HAVING count(*) >= 20"),
    "graph_isolates": (graph_isolates, f"WITH {_E} SELECT node, type FROM n WHERE node NOT IN (SELECT src FROM y)"),
    "schema_filter": (schema_filter, f"WITH {_E}, k AS (SELECT node FROM n WHERE type IN ('s', 'c')) SELECT type, count(*) AS n FROM e WHERE type IN ('IN_SECTION', 'UNDER') AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) GROUP BY type"),
    "confidence_labels": (confidence_labels, "SELECT CASE WHEN upper(confidence) IN ('HIGH', 'MEDIUM', 'LOW') THEN upper(confidence) ELSE 'UNKNOWN' END AS label, count(*) AS n FROM kb_section_summary GROUP BY 1"),
    "graph_seed_expand": (
        graph_seed_expand,
        f"""WITH {_E}, g AS (SELECT * FROM y WHERE weight >= 0.3), q AS (SELECT id AS seed, 'c:' || id AS start FROM kb_chunk WHERE id % 50 = 0),
        o AS (SELECT seed, start, dst AS node, weight AS score, 1 AS hops FROM q JOIN g ON src = start), t AS (SELECT seed, o.start, g.dst AS node, least(score, weight) - 0.05 AS score, 2 AS hops FROM o JOIN g ON g.src = o.node WHERE g.dst <> o.start),
        b AS (SELECT seed, node, score, hops FROM (SELECT seed, node, score, hops FROM o UNION ALL SELECT seed, node, score, hops FROM t) QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY score DESC, hops) = 1)
        SELECT seed, node, hops, round(score, 6) AS score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, hops, node) AS place FROM b QUALIFY place <= 10""",
    ),
    "graph_subgraph": (graph_subgraph, f"WITH {_E}, k AS (SELECT 's:' || section_id AS node FROM kb_section WHERE file_node_id = 880001 UNION SELECT 'c:' || id FROM kb_chunk WHERE file_node_id = 880001) SELECT type, count(*) AS n FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) GROUP BY type"),
    "graph_delta_stale": (graph_delta_stale, f"WITH {_E}, k AS (SELECT 'c:' || id AS node FROM kb_chunk WHERE del_flag) SELECT src, dst, type FROM e WHERE src IN (SELECT node FROM k) OR dst IN (SELECT node FROM k)"),
    "graph_merge": (graph_merge, "SELECT kb_id, anchor_name, id, anchor_type FROM (SELECT DISTINCT id, kb_id, anchor_name, anchor_type, confidence FROM kb_anchor_registry) QUALIFY row_number() OVER (PARTITION BY kb_id, anchor_name ORDER BY confidence DESC NULLS LAST, id DESC) = 1"),
    "surprise_score": (
        surprise_score,
        "WITH a AS (SELECT DISTINCT id, file_node_id, source_chunk_id, confidence FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL) SELECT a.id, (CASE WHEN coalesce(confidence, 0) < 0.5 THEN 3 ELSE 0 END + CASE WHEN c.file_node_id <> a.file_node_id THEN 2 ELSE 0 END + CASE WHEN count(*) OVER (PARTITION BY source_chunk_id) >= 5 THEN 1 ELSE 0 END) AS score FROM a JOIN kb_chunk c ON c.id = a.source_chunk_id",
    ),
    "label_propagation": (label_propagation, None),
    "synchronous_round": (synchronous_round, f"WITH {_SE} SELECT * FROM lab"),
    "community_density": (
        community_density,
        f"WITH {_SE}, n AS (SELECT label, count(*) AS nodes FROM lab GROUP BY label), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM se WHERE src <> dst), i AS (SELECT x.label, count(*) AS edges FROM p JOIN lab x ON x.node = a JOIN lab z ON z.node = b WHERE x.label = z.label GROUP BY x.label) SELECT n.label, nodes, coalesce(edges, 0) AS edges, CASE WHEN nodes > 1 THEN round(2 * coalesce(edges, 0) / (nodes * (nodes - 1)), 6) ELSE 0 END AS density FROM n LEFT JOIN i USING (label)",
    ),
}
