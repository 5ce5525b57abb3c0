"""Queries: summaries from below, merging of what several passes found, the knowledge graph and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import graph as G
from veinstone.operators import hierarchy, rollup
from veinstone.operators import similarity as S
from veinstone.plans.graphs import _E, _edges, _nodes
from veinstone.sources.tables import table


def _tree(spark, sf):
    """Sections with parent, depth and place."""
    h = hierarchy.components(hierarchy.links(table(spark, sf, "kb_section", "section_id", "parent_section_id"), "section_id", "parent_section_id"))
    s = table(spark, sf, "kb_section", "section_id", "seq_start", "section_title", "section_level").groupBy(F.col("section_id").alias("id")).agg(F.min(F.coalesce("seq_start", F.lit(0))).alias("place"), F.min("section_title").alias("title"))
    return h.join(s, "id").select("id", "parent", "depth", "place", "title")


def bottom_up_summaries(spark, sf):
    """Summary of each section, children first: what its nearest summarised descendants say, else its own text, joined by ``；`` up to 1,200 characters.

    Appendices have none: what stands below them goes to the section above, as with sections that have nothing to say.
    """
    t = _tree(spark, sf)
    own = table(spark, sf, "kb_section_summary", "section_id", "node_summary").where("length(trim(node_summary)) > 0").groupBy(F.col("section_id").alias("id")).agg(F.min("node_summary").alias("text"))
    kind = table(spark, sf, "kb_section", "section_id", "section_type").groupBy(F.col("section_id").alias("id")).agg(F.min("section_type").alias("type"))
    n = t.join(own, "id", "left").join(kind, "id", "left")
    make = lambda c: F.substring(F.when(F.size(c) > 0, F.array_join(c, "；")).otherwise(F.col("text")), 1, 1200)
    return rollup.bottom_up(n, make, F.coalesce("type", F.lit("")) != "appendix").select(F.col("id").alias("section_id"), F.length("value").alias("characters"), F.substring(F.sha1("value"), 1, 12).alias("hash"))


def summary_rollup(spark, sf):
    """Fields of summaries by section: confidence labels in order, each once, up to 50; covered chunks of the section and its children."""
    s = table(spark, sf, "kb_section_summary", "id", "section_id", "confidence", "covered_chunk_ids").dropDuplicates(["id"])
    p = table(spark, sf, "kb_section", "section_id", "parent_section_id").groupBy("section_id").agg(F.min("parent_section_id").alias("parent"))
    own = s.select("section_id", "id", "confidence", "covered_chunk_ids")
    up = s.join(p, "section_id").where("parent IS NOT NULL AND parent <> section_id").select(F.col("parent").alias("section_id"), "id", "confidence", "covered_chunk_ids")
    both = own.unionByName(up)
    # Chunks are counted, not listed; labels are few.
    n = both.select("section_id", F.explode("covered_chunk_ids").alias("c")).groupBy("section_id").agg(F.count_distinct("c").alias("chunks"))
    labels = both.where("confidence IS NOT NULL").groupBy("section_id", "confidence").agg(F.min("id").alias("first")).groupBy("section_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list(F.struct("first", "confidence")))["confidence"], 1, 50), ",").alias("labels"))
    return n.join(labels, "section_id", "full").select("section_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "labels")


def summary_gates(spark, sf):
    """Sections that may have a summary: levels 1 to 4, no appendix; the rest by what stops them."""
    s = table(spark, sf, "kb_section", "section_id", "section_level", "section_type").groupBy("section_id").agg(F.min("section_level").alias("level"), F.min("section_type").alias("type"))
    gate = F.when(F.col("type") == "appendix", "skipped").when(F.col("level").isNull(), "no level").when(F.col("level") > 4, "too deep").otherwise("allowed")
    return s.groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


def field_merge(spark, sf):
    """Of the fields (anchors) of a chunk and type one: the best label of confidence, then the longer name, then the smaller id."""
    a = table(spark, sf, "kb_anchor_registry", "id", "source_chunk_id", "anchor_type", "anchor_name", "confidence").where("source_chunk_id IS NOT NULL").dropDuplicates(["id"])
    rank = F.when(F.col("confidence") >= 0.8, 3).when(F.col("confidence") >= 0.5, 2).when(F.col("confidence").isNotNull(), 1).otherwise(0)
    best = a.groupBy("source_chunk_id", "anchor_type").agg(F.max(F.struct(rank.alias("r"), F.length("anchor_name").alias("n"), (-F.col("id")).alias("i"))).alias("b"))
    return best.select("source_chunk_id", "anchor_type", (-F.col("b.i")).alias("id"))


def pass_merge(spark, sf):
    """Anchors of one file and type after several passes: equal labels merge, then labels whose overlap reaches 0.72 give way to the one of higher confidence, then greater length.

    One row an anchor label: the label that stands for it. Two labels overlap by 0.72 if they share one of the windows of the shorter,
    the substrings that are 0.72 as long as it. Each distinct window meets the labels that hold its rarest three characters;
    per window, its owners take the best label that holds it, and the labels that hold it the best of its owners. Pairs of labels are not listed.
    """
    by = ["file_node_id", "anchor_type"]
    a = table(spark, sf, "kb_anchor_registry", *by, "anchor_name", "confidence")
    l = a.select(*by, T.label(F.col("anchor_name")).alias("label"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c")).where("length(label) >= 3")
    one = l.groupBy(*by, "label").agg(F.max("c").alias("c")).withColumn("n", F.length("label"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.substring("label", i, F.lit(3))))
    parts = one.select(*by, "label", "c", "n", F.explode(cuts).alias("part"))
    windows = S.windows(one.where("file_node_id IS NOT NULL AND anchor_type IS NOT NULL"), by, "label", S.part_counts(parts, "part")).distinct()
    # The optimizer doesn't know that explode makes more rows: left to itself it broadcasts them.
    held = windows.hint("merge").join(parts, [*by, "part"]).where(F.col("label").contains(F.col("window")))
    mine, own = F.struct("c", "n", F.col("label").alias("l")), F.length("window") == S.window_size(F.col("n"))
    of = Window.partitionBy(*by, "window")
    best = held.select(*by, "label", F.max(F.when(own, mine)).over(of).alias("owner"), F.when(own, F.max(mine).over(of)).alias("holder"))
    stronger = best.groupBy(*by, "label").agg(F.max(F.greatest("owner", "holder")).alias("theirs"))  # at least the label itself
    j = one.join(stronger, [*by, "label"], "left")
    return j.select(*by, "label", F.coalesce("theirs.l", "label").alias("stands_for"))


def graph_dedupe(spark, sf):
    """Nodes by key and edges by type and ends, each once, with the heaviest weight; how many of each type."""
    e = _edges(spark, sf).groupBy("type", "src", "dst").agg(F.max("weight").alias("weight"))
    n = _nodes(spark, sf).dropDuplicates(["node"])
    return e.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight")).unionByName(n.groupBy("type").agg(F.count("*").alias("n"), F.lit(0.0).alias("weight")))


def assertion_graph(spark, sf):
    """Relations as nodes of their own: each quote is an assertion between its summary and its chunk; edges SUBJECT, OBJECT and EVIDENCED_BY, counted by role."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id", "evidence_role").distinct()
    key = F.concat(F.lit("x:"), "id")
    parts = [("SUBJECT", "summary_id", "m:"), ("OBJECT", "chunk_id", "c:"), ("EVIDENCED_BY", "chunk_id", "c:")]
    out = None
    for kind, c, prefix in parts:
        p = e.where(F.col(c).isNotNull()).select(key.alias("src"), F.concat(F.lit(prefix), c).alias("dst"), F.lit(kind).alias("type"), "evidence_role")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("type", "evidence_role").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"))


def assertion_audit(spark, sf):
    """Assertions whose subject or object is missing, and how many assertions stand on each object that is there: the audit's counts."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id").distinct()
    m = table(spark, sf, "kb_section_summary", "id").distinct().select(F.col("id").alias("summary_id"), F.lit(True).alias("subject"))
    c = table(spark, sf, "kb_chunk", "id").select(F.col("id").alias("chunk_id"), F.lit(True).alias("object"))
    d = e.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count("*").alias("degree"))
    j = e.join(m, "summary_id", "left").join(c, "chunk_id", "left").join(d, "chunk_id", "left")
    state = F.when(F.col("subject").isNull() & F.col("object").isNull(), "none").when(F.col("subject").isNull(), "no subject").when(F.col("object").isNull(), "no object").otherwise("whole")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.max("degree").alias("most"))


def member_evidence(spark, sf):
    """A piece of evidence for each section of a community: the quote of the smallest id that stands on one of its chunks, if there is one."""
    c = table(spark, sf, "kb_chunk", "id", "section_id").where("section_id IS NOT NULL").select(F.col("id").alias("chunk_id"), "section_id")
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("id").alias("evidence_id"))
    return c.join(e, "chunk_id", "left").groupBy("section_id").agg(F.min("evidence_id").alias("evidence_id"), F.count("*").alias("chunks"))


def kb_subgraph(spark, sf):
    """Graph of one base, of bounded size: its 400 first nodes and the 1,000 heaviest edges between them."""
    ids = table(spark, sf, "kb_section", "kb_id", "section_id").where("kb_id = 7").select(F.concat(F.lit("s:"), "section_id").alias("node")).unionByName(table(spark, sf, "kb_chunk", "kb_id", "id").where("kb_id = 7").select(F.concat(F.lit("c:"), "id").alias("node"))).distinct()
    first = F.broadcast(ids.orderBy("node").limit(400))  # 400 rows
    e = G.induced(_edges(spark, sf).distinct(), first)
    return e.orderBy(F.desc("weight"), "type", "src", "dst").limit(1000).select("src", "dst", "type", "weight")


def graph_audit(spark, sf):
    """The audit in one table: nodes, edges, isolated nodes, hubs, dangling edges, uncertain anchors."""
    n, e = _nodes(spark, sf), _edges(spark, sf)
    d = G.degrees(e)
    known = n.select(F.col("node").alias("dst"))
    counts = [
        ("nodes", n.agg(F.count("*").alias("n"))), ("edges", e.agg(F.count("*").alias("n"))), ("isolated", G.isolates(n, e).agg(F.count("*").alias("n"))),
        ("hubs", d.where("degree >= 20").agg(F.count("*").alias("n"))), ("dangling", e.join(known, "dst", "left_anti").agg(F.count("*").alias("n"))),
        ("uncertain", table(spark, sf, "kb_anchor_registry", "id", "confidence").distinct().where("coalesce(confidence, 0) < 0.5").agg(F.count("*").alias("n"))),
    ]
    out = None
    for name, c in counts:
        p = c.select(F.lit(name).alias("what"), "n")
        out = p if out is None else out.unionByName(p)
    return out


def contracted_edges(spark, sf):
    """Edges between sections that assertions make: two sections are tied if a summary of the one stands on a chunk of the other; weight is how often."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "section_id", "chunk_id").distinct().where("chunk_id IS NOT NULL AND section_id IS NOT NULL")
    c = table(spark, sf, "kb_chunk", "id", "section_id").where("section_id IS NOT NULL").select(F.col("id").alias("chunk_id"), F.col("section_id").alias("dst"))
    return e.join(c, "chunk_id").where("section_id <> dst").groupBy(F.col("section_id").alias("src"), "dst").agg(F.count("*").alias("weight"))


def attribute_enrichment(spark, sf):
    """Attributes that anchors add to their chunk: the first of each type that is not there as a section type already."""
    a = table(spark, sf, "kb_anchor_registry", "id", "source_chunk_id", "anchor_type").where("source_chunk_id IS NOT NULL").distinct()
    c = table(spark, sf, "kb_chunk", "id", "section_id").select(F.col("id").alias("source_chunk_id"), "section_id")
    s = table(spark, sf, "kb_section", "section_id", "section_type").where("section_type IS NOT NULL").select("section_id", F.when(F.col("section_type") == "procedure", "process").when(F.col("section_type") == "scope", "plan").otherwise(F.col("section_type")).alias("anchor_type")).distinct()
    return a.join(c, "source_chunk_id").join(s, ["section_id", "anchor_type"], "left_anti").groupBy("source_chunk_id", "anchor_type").agg(F.min("id").alias("id"))


def file_graph_delete(spark, sf):
    """What goes when file 880001 is deleted: its own nodes, the edges at them, and shared anchors that no other chunk bears out."""
    own = table(spark, sf, "kb_chunk", "id", "file_node_id").where("file_node_id = 880001").select(F.concat(F.lit("c:"), "id").alias("node")).unionByName(table(spark, sf, "kb_section", "section_id", "file_node_id").where("file_node_id = 880001").select(F.concat(F.lit("s:"), "section_id").alias("node")).distinct())
    e = _edges(spark, sf)
    gone = e.join(own.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(e.join(own.withColumnRenamed("node", "src"), "src", "left_anti").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select(e.columns))
    left = e.where("type = 'EVIDENCED_BY'").join(own.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src").distinct()
    orphans = e.where("type = 'EVIDENCED_BY'").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src").distinct().join(left, "src", "left_anti")
    return own.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")).unionByName(orphans.agg(F.count("*").alias("n")).select(F.lit("orphaned anchors").alias("what"), "n"))


def canonical_units(spark, sf):
    """Units of knowledge: quotes that are aligned, with a canonical id of their text, ends resolved; the rest by what they lack."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id", "evidence_quote", "alignment_status").distinct()
    m = table(spark, sf, "kb_section_summary", "id").distinct().select(F.col("id").alias("summary_id"), F.lit(True).alias("m"))
    c = table(spark, sf, "kb_chunk", "id").select(F.col("id").alias("chunk_id"), F.lit(True).alias("c"))
    j = e.join(m, "summary_id", "left").join(c, "chunk_id", "left")
    state = F.when(F.coalesce(F.trim("evidence_quote"), F.lit("")) == "", "no quote").when(~F.coalesce(F.col("alignment_status").isin("exact", "lesser", "fuzzy"), F.lit(False)), "not aligned").when(F.col("m").isNull() | F.col("c").isNull(), "no end").otherwise("kept")
    canon = F.substring(F.sha1(T.label(F.col("evidence_quote"))), 1, 16)
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_distinct(canon).alias("units"))


def business_graph(spark, sf):
    """The graph of plans: nodes of plan, role, department and system anchors by label and base, edges between those that one chunk bears out; counted by the kinds they tie."""
    a = table(spark, sf, "kb_anchor_registry", "kb_id", "anchor_type", "anchor_name", "source_chunk_id").where("source_chunk_id IS NOT NULL").select("kb_id", "anchor_type", T.label(F.col("anchor_name")).alias("label"), "source_chunk_id").where("label <> ''").distinct()
    p = a.where("anchor_type = 'plan'").select("kb_id", F.col("label").alias("plan"), "source_chunk_id")
    o = a.where("anchor_type IN ('role', 'department', 'system')")
    return p.join(o, ["kb_id", "source_chunk_id"]).select("kb_id", "plan", "anchor_type", "label").distinct().groupBy("anchor_type").agg(F.count("*").alias("edges"), F.count_distinct("kb_id", "plan").alias("plans"), F.count_distinct("kb_id", "label").alias("others"))


_TREE = """s AS (SELECT DISTINCT section_id AS id, parent_section_id AS parent FROM kb_section WHERE section_id IS NOT NULL),
    l AS (SELECT s.id, min(p.id) AS parent FROM s LEFT JOIN (SELECT DISTINCT id FROM s) p ON p.id = s.parent AND trim(s.parent) <> '' GROUP BY s.id)"""

CATALOGUE = {
    "bottom_up_summaries": (bottom_up_summaries, None),
    "summary_rollup": (
        summary_rollup,
        """WITH s AS (SELECT DISTINCT ON (id) id, section_id, confidence, covered_chunk_ids FROM kb_section_summary), p AS (SELECT section_id, min(parent_section_id) AS parent FROM kb_section GROUP BY section_id),
        b AS (SELECT section_id, id, confidence, covered_chunk_ids FROM s UNION ALL SELECT parent, id, confidence, covered_chunk_ids FROM s JOIN p USING (section_id) WHERE parent IS NOT NULL AND parent <> section_id),
        n AS (SELECT section_id, count(DISTINCT c) AS chunks FROM (SELECT section_id, unnest(covered_chunk_ids) AS c FROM b) GROUP BY section_id), f AS (SELECT section_id, confidence, min(id) AS first FROM b WHERE confidence IS NOT NULL GROUP BY ALL),
        g AS (SELECT section_id, string_agg(confidence, ',' ORDER BY first, confidence) AS labels FROM f GROUP BY section_id) SELECT section_id, coalesce(chunks, 0) AS chunks, labels FROM n FULL JOIN g USING (section_id)""",
    ),
    "summary_gates": (summary_gates, "SELECT CASE WHEN t = 'appendix' THEN 'skipped' WHEN l IS NULL THEN 'no level' WHEN l > 4 THEN 'too deep' ELSE 'allowed' END AS gate, count(*) AS n FROM (SELECT section_id, min(section_level) AS l, min(section_type) AS t FROM kb_section GROUP BY section_id) GROUP BY 1"),
    "field_merge": (
        field_merge,
        "SELECT source_chunk_id, anchor_type, id FROM (SELECT DISTINCT ON (id) * FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source_chunk_id, anchor_type ORDER BY CASE WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.5 THEN 2 WHEN confidence IS NOT NULL THEN 1 ELSE 0 END DESC, length(anchor_name) DESC NULLS LAST, id) = 1",
    ),
    "pass_merge": (pass_merge, None),
    "graph_dedupe": (
        graph_dedupe,
        f"WITH {_E}, d AS (SELECT type, src, dst, max(weight) AS w FROM e GROUP BY ALL) SELECT type, count(*) AS n, round(sum(w), 4) AS weight FROM d GROUP BY type UNION ALL SELECT type, count(DISTINCT node), 0.0 FROM n GROUP BY type",
    ),
    "assertion_graph": (
        assertion_graph,
        """WITH e AS (SELECT DISTINCT id, summary_id, chunk_id, evidence_role FROM kb_section_summary_evidence), x AS (SELECT 'SUBJECT' AS type, evidence_role, summary_id AS dst FROM e UNION ALL SELECT 'OBJECT', evidence_role, chunk_id FROM e UNION ALL SELECT 'EVIDENCED_BY', evidence_role, chunk_id FROM e)
        SELECT type, evidence_role, count(*) AS edges, count(DISTINCT dst) AS targets FROM x WHERE dst IS NOT NULL GROUP BY ALL""",
    ),
    "assertion_audit": (
        assertion_audit,
        """WITH e AS (SELECT DISTINCT id, summary_id, chunk_id FROM kb_section_summary_evidence), d AS (SELECT chunk_id, count(*) AS degree FROM e WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
        j AS (SELECT e.*, degree, summary_id IN (SELECT id FROM kb_section_summary) AS s, coalesce(e.chunk_id IN (SELECT id FROM kb_chunk), false) AS o FROM e LEFT JOIN d USING (chunk_id))
        SELECT CASE WHEN NOT coalesce(s, false) AND NOT o THEN 'none' WHEN NOT coalesce(s, false) THEN 'no subject' WHEN NOT o THEN 'no object' ELSE 'whole' END AS state, count(*) AS n, max(degree) AS most FROM j GROUP BY 1""",
    ),
    "member_evidence": (
        member_evidence,
        "SELECT section_id, min(evidence_id) AS evidence_id, count(*) AS chunks FROM kb_chunk k LEFT JOIN (SELECT chunk_id, min(id) AS evidence_id FROM kb_section_summary_evidence WHERE chunk_id IS NOT NULL GROUP BY chunk_id) e ON e.chunk_id = k.id WHERE section_id IS NOT NULL GROUP BY section_id",
    ),
    "kb_subgraph": (
        kb_subgraph,
        f"""WITH {_E}, i AS (SELECT 's:' || section_id AS node FROM kb_section WHERE kb_id = 7 UNION SELECT 'c:' || id FROM kb_chunk WHERE kb_id = 7), f AS (SELECT node FROM i ORDER BY node LIMIT 400)
        SELECT DISTINCT src, dst, type, weight FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM f) ORDER BY weight DESC, type, src, dst LIMIT 1000""",
    ),
    "graph_audit": (
        graph_audit,
        f"""WITH {_E}, d AS (SELECT src AS node, count(*) AS degree FROM y GROUP BY src) SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'isolated', count(*) FROM n WHERE node NOT IN (SELECT node FROM d)
        UNION ALL SELECT 'hubs', count(*) FROM d WHERE degree >= 20 UNION ALL SELECT 'dangling', count(*) FROM e WHERE dst NOT IN (SELECT node FROM n) UNION ALL SELECT 'uncertain', count(*) FROM (SELECT DISTINCT id, confidence FROM kb_anchor_registry) WHERE coalesce(confidence, 0) < 0.5""",
    ),
    "contracted_edges": (
        contracted_edges,
        "SELECT e.section_id AS src, k.section_id AS dst, count(*) AS weight FROM (SELECT DISTINCT id, section_id, chunk_id FROM kb_section_summary_evidence) e JOIN kb_chunk k ON k.id = e.chunk_id WHERE e.section_id <> k.section_id GROUP BY ALL",
    ),
    "attribute_enrichment": (
        attribute_enrichment,
        """WITH a AS (SELECT DISTINCT id, source_chunk_id, anchor_type FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL), s AS (SELECT DISTINCT section_id, CASE section_type WHEN 'procedure' THEN 'process' WHEN 'scope' THEN 'plan' ELSE section_type END AS t FROM kb_section WHERE section_type IS NOT NULL)
        SELECT source_chunk_id, anchor_type, min(a.id) AS id FROM a JOIN kb_chunk k ON k.id = a.source_chunk_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.section_id = k.section_id AND s.t = a.anchor_type) GROUP BY ALL""",
    ),
    "file_graph_delete": (
        file_graph_delete,
        f"""WITH {_E}, k AS (SELECT 'c:' || id AS node FROM kb_chunk WHERE file_node_id = 880001 UNION SELECT 's:' || section_id FROM kb_section WHERE file_node_id = 880001), v AS (SELECT * FROM e WHERE type = 'EVIDENCED_BY')
        SELECT 'nodes' AS what, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM e WHERE src IN (SELECT node FROM k) OR dst IN (SELECT node FROM k)
        UNION ALL SELECT 'orphaned anchors', count(DISTINCT src) FROM v WHERE dst IN (SELECT node FROM k) AND src NOT IN (SELECT src FROM v WHERE dst NOT IN (SELECT node FROM k))""",
    ),
    "canonical_units": (
        canonical_units,
        """WITH e AS (SELECT DISTINCT id, summary_id, chunk_id, evidence_quote, alignment_status FROM kb_section_summary_evidence),
        j AS (SELECT *, CASE WHEN coalesce(trim(evidence_quote, ' '), '') = '' THEN 'no quote' WHEN alignment_status IS NULL OR alignment_status NOT IN ('exact', 'lesser', 'fuzzy') THEN 'not aligned' WHEN NOT coalesce(summary_id IN (SELECT id FROM kb_section_summary), false) OR NOT coalesce(chunk_id IN (SELECT id FROM kb_chunk), false) THEN 'no end' ELSE 'kept' END AS state FROM e)
        SELECT state, count(*) AS n, count(DISTINCT left(sha1(regexp_replace(lower(evidence_quote), '[^0-9a-z一-鿿]', '', 'g')), 16)) AS units FROM j GROUP BY state""",
    ),
    "business_graph": (
        business_graph,
        """WITH a AS (SELECT DISTINCT kb_id, anchor_type, regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label, source_chunk_id FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL), b AS (SELECT * FROM a WHERE label <> ''),
        x AS (SELECT DISTINCT p.kb_id, p.label AS plan, o.anchor_type, o.label FROM b p JOIN b o USING (kb_id, source_chunk_id) WHERE p.anchor_type = 'plan' AND o.anchor_type IN ('role', 'department', 'system'))
        SELECT anchor_type, count(*) AS edges, count(DISTINCT (kb_id, plan)) AS plans, count(DISTINCT (kb_id, label)) AS others FROM x GROUP BY anchor_type""",
    ),
}
