"""Queries: the routes of retrieval over the knowledge base, the graph's answers, and the choice of evidence.

A request is data here: its words with weights, its anchors and fields are constants of the module, as callers would pass them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import evidence as E
from veinstone.operators import ranking
from veinstone.sources.tables import table

WORDS = {"担保": 1.0, "抵押": 0.8, "代偿": 0.6, "bond": 1.0, "collateral": 0.8, "bürgschaft": 1.0}
_V = "(VALUES " + ", ".join(f"('{t}', {b}::DOUBLE)" for t, b in WORDS.items()) + ") q(token, boost)"


def _score_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, {T.words_sql(text)} AS w FROM {source} WHERE {text} IS NOT NULL), {name}_p AS (SELECT DISTINCT id, unnest(w) AS token FROM {name}_t),
        {name} AS (SELECT id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score FROM {name}_p JOIN {_V} USING (token)
            JOIN (SELECT token, count(*) AS df FROM {name}_p GROUP BY token) f USING (token), (SELECT count(*) AS n FROM {name}_t) c GROUP BY id)"""


def _unit_sql(name: str, score: str = "score") -> str:
    return f"CASE WHEN max({score}) OVER () > min({score}) OVER () THEN ({score} - min({score}) OVER ()) / (max({score}) OVER () - min({score}) OVER ()) ELSE 1 / (1 + exp(-0.5 * ({score} - 5))) END"


def _scored(df: DataFrame, key: str, text: str) -> DataFrame:
    return ranking.binary_similarity(df.select(key, text), key, F.col(text), WORDS).select(F.col(key).alias("id"), F.round("score", 9).alias("score"))


def _unit(df: DataFrame) -> DataFrame:
    return ranking.min_max(df, []).select("id", F.round("unit", 6).alias("unit"))


def weighted_query(spark, sf):
    """Query clauses: each distinct word of two letters or more once, with its weight by rarity in the revisions and the boost of its kind (noun 2.0)."""
    d = table(spark, sf, "kb_chunk_revision", "id", "content").where("content IS NOT NULL").groupBy("id").agg(F.max("content").alias("content"))
    df = ranking.document_frequency(d, "id", F.col("content")).join(ranking.query_weights(spark, WORDS), "token", "right")
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    f = F.coalesce("df", F.lit(0))
    return df.crossJoin(n).where(F.length("token") >= 2).select("token", F.round(F.log10(1 + (F.col("n") - f + 0.5) / (f + 0.5)) * 2.0 * F.col("boost"), 3).alias("weight"))


def _revisions(spark, sf):
    return table(spark, sf, "kb_chunk_revision", "id", "content", "chunk_id").where("content IS NOT NULL").groupBy("id").agg(F.max("content").alias("content"), F.max("chunk_id").alias("chunk_id"))


def _anchors(spark, sf):
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_name", "aliases", "evidence_quote", "source_chunk_id", "status", "file_node_id", "anchor_type").where("status = 'active'").dropDuplicates(["id"])
    return a.withColumn("text", F.concat_ws(" ", "anchor_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "evidence_quote"))


def _summaries(spark, sf):
    s = table(spark, sf, "kb_section_summary", "id", "section_title", "node_summary", "covered_chunk_ids", "section_id").dropDuplicates(["id"])
    return s.withColumn("text", F.concat_ws(" ", "section_title", "node_summary"))


def route_lexical(spark, sf):
    """Lexical route over two indexes, revisions and anchors, each on [0, 1] by itself, then one list of 50."""
    both = _unit(_scored(_revisions(spark, sf), "id", "content")).withColumn("source", F.lit("chunk")).unionByName(_unit(_scored(_anchors(spark, sf), "id", "text")).withColumn("source", F.lit("field")))
    return ranking.top(both, 50, F.desc("unit"), F.col("source"), F.col("id"))


def route_structured(spark, sf):
    """Structured route: summaries as units of knowledge, and anchors, each type on [0, 1] by itself; 50 of both."""
    both = _unit(_scored(_summaries(spark, sf), "id", "text")).withColumn("source", F.lit("unit")).unionByName(_unit(_scored(_anchors(spark, sf), "id", "text")).withColumn("source", F.lit("anchor")))
    return ranking.top(both, 50, F.desc("unit"), F.col("source"), F.col("id"))


def route_sections(spark, sf):
    """Section route: summaries by their words; the first covered chunk is the primary one."""
    s = _summaries(spark, sf)
    hits = _unit(_scored(s, "id", "text")).join(s.select("id", F.try_element_at("covered_chunk_ids", F.lit(1)).alias("chunk_id")), "id")
    return ranking.top(hits, 30, F.desc("unit"), F.col("id"))


def route_questions(spark, sf):
    """Question route: titles as questions. Added to the score: 1.8 for an equal question, 1.2 for one that holds the asked one, 1.2 for a checked answer, 1.1 for a late revision."""
    asked = "bond"
    r = table(spark, sf, "kb_chunk_revision", "id", "title", "revision_source", "revision_no").where("title IS NOT NULL").dropDuplicates(["id"])
    s = _scored(r, "id", "title").join(r, "id")
    label = T.label(F.col("title"))
    bonus = F.when(label == asked, 1.8).otherwise(0.0) + F.when(label.contains(asked), 1.2).otherwise(0.0) + F.when(F.col("revision_source") == "manual_edit", 1.2).otherwise(0.0) + F.when(F.col("revision_no") >= 3, 1.1).otherwise(0.0)
    return ranking.top(s.select("id", F.round(F.col("score") + bonus, 6).alias("score")), 50, F.desc("score"), F.col("id"))


def community_search(spark, sf):
    """Communities (the sections of a file) by the words their titles and summaries hold: .50 + .35 x share of words + .10 x size, 0 without any; size counts up to 20 members."""
    s = _summaries(spark, sf).join(table(spark, sf, "kb_section", "section_id", "file_node_id").groupBy("section_id").agg(F.min("file_node_id").alias("community")), "section_id")
    hits = [F.max(F.lower("text").contains(w).cast("int")) for w in WORDS]
    c = s.groupBy("community").agg(F.count("*").alias("members"), sum(hits[1:], hits[0]).alias("matched"))
    score = F.when(F.col("matched") == 0, 0.0).otherwise(F.least(F.lit(0.99), 0.5 + 0.35 * F.col("matched") / len(WORDS) + 0.10 * F.least(F.lit(1.0), F.col("members") / 20)))
    return ranking.top(c.select("community", "members", "matched", F.round(score, 6).alias("score")).where("score > 0"), 20, F.desc("score"), F.col("community"))


def rerank_fallback(spark, sf):
    """Without a rerank model the scores stay and ranks are made from them."""
    return route_sections(spark, sf).select("id", F.col("unit").alias("score"), F.row_number().over(Window.orderBy(F.desc("unit"), "id")).alias("rerank_rank"))


def relation_score(weight: Column, evidence: Column, depth: Column, scope: Column, base: float = 0.82, places: int = 4) -> Column:
    """base + .10 x weight + .04 x evidence - .06 x (depth - 1), + .06 within the scope, within [.05, .99], rounded."""
    unit = lambda c, d: F.least(F.greatest(F.coalesce(c, F.lit(d)), F.lit(0.0)), F.lit(1.0))
    s = base + 0.10 * unit(weight, 1.0) + 0.04 * unit(evidence, 0.0) - 0.06 * (F.greatest(depth, F.lit(1)) - 1) + F.when(scope, 0.06).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.05), F.least(s, F.lit(0.99))), places)


def graph_relations(spark, sf):
    """Plan anchors, their evidence and the chunk it stands in (both needed), scored as relations; the best of each file, type and name."""
    a = _anchors(spark, sf).where("anchor_type = 'plan' AND evidence_quote IS NOT NULL")
    conf = table(spark, sf, "kb_anchor_registry", "id", "confidence").groupBy("id").agg(F.max("confidence").cast("double").alias("confidence"))
    c = table(spark, sf, "kb_chunk", "id", "section_id", "file_node_id").select(F.col("id").alias("source_chunk_id"), "section_id", F.col("file_node_id").alias("chunk_file"))
    j = a.join(conf, "id").join(c, "source_chunk_id")
    s = j.select("file_node_id", "anchor_name", "id", "source_chunk_id", relation_score(F.col("confidence"), F.when(F.length("evidence_quote") >= 40, 1.0).otherwise(0.5), F.when(F.col("section_id").isNull(), 2).otherwise(1), F.col("chunk_file") == F.col("file_node_id"), places=6).alias("score"))
    best = s.groupBy("file_node_id", "anchor_name").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("file_node_id", "anchor_name", (-F.col("b.i")).alias("id"), F.col("b.score").alias("score"))


def graph_field_context(spark, sf):
    """Plans with what stands in their chunk: the department, the role and the rule document named there, where there are any."""
    a = _anchors(spark, sf).where("source_chunk_id IS NOT NULL")
    plans = a.where("anchor_type = 'plan'").select("id", "source_chunk_id")
    out = plans
    for kind in ("department", "role", "rule_document"):
        names = a.where(F.col("anchor_type") == kind).groupBy("source_chunk_id").agg(F.min("anchor_name").alias(kind))
        out = out.join(names, "source_chunk_id", "left")
    return out.where("department IS NOT NULL OR role IS NOT NULL OR rule_document IS NOT NULL").select("id", "department", "role", "rule_document")


def sibling_plans(spark, sf):
    """Siblings of each section whose id is divisible by 50: sections of the same file and type by the distance of ids, twenty at most."""
    s = table(spark, sf, "kb_section", "id", "file_node_id", "section_type").where("section_type IS NOT NULL").distinct()
    q = s.where("id % 50 = 0").select(F.col("id").alias("seed"), "file_node_id", "section_type")
    order = Window.partitionBy("seed").orderBy(F.abs(F.col("id") - F.col("seed")), "id")
    return q.join(s, ["file_node_id", "section_type"]).where("id <> seed").withColumn("place", F.row_number().over(order)).where("place <= 20").select("seed", "id", "place")


def _paths(spark, sf):
    """Paths chunk - anchor - chunk that share an anchor's label: seeds are chunks whose id is divisible by 50, with the score of their words."""
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_type", "anchor_name", "source_chunk_id", "confidence", "evidence_quote").where("source_chunk_id IS NOT NULL").dropDuplicates(["id"])
    a = a.select(F.col("source_chunk_id").alias("chunk_id"), T.label(F.col("anchor_name")).alias("node"), "anchor_type", F.col("confidence").cast("double").alias("w"), "evidence_quote").where("node <> ''")
    degree = a.groupBy("node").agg(F.count("*").alias("degree"))
    seeds = a.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("seed"), "node", F.col("w").alias("w1"))
    other = a.select("chunk_id", "node", F.col("w").alias("w2"), "anchor_type", "evidence_quote")
    return seeds.join(other, "node").where("seed <> chunk_id").join(degree, "node")


def graph_path_scores(spark, sf):
    """Chunks reached over a shared anchor: .52 x seed + .30 x least weight + words up to .08 - .10 for a generic anchor - hub up to .15, within [.05, .99]; more for several seeds of one fact."""
    words = F.size(F.filter(F.array(*[F.lit(w) for w in WORDS]), lambda w: F.coalesce(F.lower("evidence_quote").contains(w), F.lit(False))))
    lexical = F.least(F.lit(0.08), 0.08 * words / len(WORDS))
    raw = 0.52 * F.coalesce("w1", F.lit(0.0)) + 0.30 * F.coalesce(F.least("w1", "w2"), F.lit(0.5)) + lexical - F.when(F.col("anchor_type") == "other", 0.10).otherwise(0.0) - F.least(F.lit(0.15), F.greatest(F.lit(0), F.col("degree") - 8) * 0.004) - 0.05
    p = _paths(spark, sf).withColumn("s", F.least(F.lit(0.99), F.greatest(F.lit(0.05), raw)))
    support = p.groupBy("node", "chunk_id").agg(F.countDistinct("seed").alias("support"), F.max("s").alias("s"))
    return support.select("node", "chunk_id", "support", F.round(F.least(F.lit(0.99), F.col("s") + F.least(F.lit(0.14), (F.col("support") - 1) * 0.04)), 6).alias("score"))


def field_priority(spark, sf):
    """Evidence groups (chunks) by what the question aims at: + .15 if an anchor of the asked type stands there, + .35 in a procedure, then by the number of asked words; 30."""
    s = _scored(_revisions(spark, sf), "id", "content").join(_revisions(spark, sf).select("id", "chunk_id", "content"), "id")
    words = F.size(F.filter(F.array(*[F.lit(w) for w in WORDS]), lambda w: F.lower("content").contains(w)))
    best = s.withColumn("words", words).groupBy("chunk_id").agg(F.max("score").alias("score"), F.max("words").alias("words"))
    field = table(spark, sf, "kb_anchor_registry", "source_chunk_id", "anchor_type").where("anchor_type = 'department'").select(F.col("source_chunk_id").alias("chunk_id")).distinct().withColumn("field", F.lit(True))
    c = table(spark, sf, "kb_chunk", "id", "section_id").select(F.col("id").alias("chunk_id"), "section_id")
    procedure = table(spark, sf, "kb_section", "section_id", "section_type").where("section_type = 'procedure'").select("section_id").distinct().withColumn("procedure", F.lit(True))
    j = best.join(c, "chunk_id").join(field, "chunk_id", "left").join(procedure, "section_id", "left")
    score = F.col("score") + F.when(F.col("field"), 0.15).otherwise(0.0) + F.when(F.col("procedure"), 0.35).otherwise(0.0)
    return ranking.top(j.select("chunk_id", F.round(score, 6).alias("score"), "words"), 30, F.desc("score"), F.desc("words"), F.col("chunk_id"))


def context_choice(spark, sf):
    """Context of each small chunk: its parent chunk if the section's own has fewer than 700 characters, else the section chunk, else itself."""
    n = _revisions(spark, sf).groupBy("chunk_id").agg(F.max(F.length("content")).alias("n"))
    c = table(spark, sf, "kb_chunk", "id", "section_id", "chunk_type").join(n.withColumnRenamed("chunk_id", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pick = lambda kind, name: c.where(F.col("chunk_type") == kind).groupBy("section_id").agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias(name))
    j = c.where("chunk_type = 'small_chunk'").join(pick("section_chunk", "s"), "section_id", "left").join(pick("parent_chunk", "p"), "section_id", "left")
    by = F.when(F.col("s.n") >= 700, "section").when(F.col("p").isNotNull(), "parent").when(F.col("s").isNotNull(), "section").otherwise("self")
    return j.withColumn("by", by).select("id", "by", F.when(F.col("by") == "section", -F.col("s.i")).when(F.col("by") == "parent", -F.col("p.i")).otherwise(F.col("id")).alias("context_id"))


def comparison_coverage(spark, sf):
    """For each question (a base) that compares three products, the best chunk of each product first, without repetition, then the best of the rest: six a base."""
    anchors = ["担保", "bond", "bürgschaft"]
    s = _scored(_revisions(spark, sf), "id", "content").join(_revisions(spark, sf), "id")
    c = table(spark, sf, "kb_chunk", "id", "kb_id").select(F.col("id").alias("chunk_id"), "kb_id")
    held = F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: F.lower("content").contains(a))
    g = s.withColumn("held", held).groupBy("chunk_id").agg(F.max(F.struct("score", "held")).alias("b")).join(c, "chunk_id").select("kb_id", "chunk_id", F.col("b.score").alias("score"), F.col("b.held").alias("held"))
    # No more than six of each set of products can be taken: cut to them before the groups come together.
    few = g.withColumn("n", F.row_number().over(Window.partitionBy("kb_id", "held").orderBy(F.desc("score"), "chunk_id"))).where("n <= 6").drop("n")

    def choose(pdf):
        import pandas as pd

        ids = E.cover_anchors([(int(i), float(x), set(h)) for i, x, h in zip(pdf.chunk_id, pdf.score, pdf.held)], anchors, 6)
        return pd.DataFrame({"kb_id": [pdf.kb_id.iloc[0]] * len(ids), "chunk_id": ids, "place": range(1, len(ids) + 1)})

    return few.groupBy("kb_id").applyInPandas(choose, "kb_id long, chunk_id long, place int")


_R = "r AS (SELECT id, max(content) AS content, max(chunk_id) AS chunk_id FROM kb_chunk_revision WHERE content IS NOT NULL GROUP BY id)"
_A = "a AS (SELECT DISTINCT ON (id) *, concat_ws(' ', anchor_name, coalesce(array_to_string(aliases, ' '), ''), evidence_quote) AS text FROM kb_anchor_registry WHERE status = 'active')"
_S = "s AS (SELECT DISTINCT ON (id) *, concat_ws(' ', section_title, node_summary) AS text FROM kb_section_summary)"


def _units(name: str, source: str) -> str:
    return f"SELECT id, round({_unit_sql(name)}, 6) AS unit, '{source}' AS source FROM (SELECT id, round(score, 9) AS score FROM {name})"


_HELD = " + ".join(f"coalesce((lower({{0}}) LIKE '%{w}%')::INT, 0)" for w in WORDS)

CATALOGUE = {
    "weighted_query": (
        weighted_query,
        f"""WITH {_R}, p AS (SELECT DISTINCT id, unnest({T.words_sql('content')}) AS token FROM r), f AS (SELECT token, count(*) AS df FROM p GROUP BY token)
        SELECT q.token, round(log10(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * 2.0 * boost, 3) AS weight FROM {_V} LEFT JOIN f USING (token), (SELECT count(*) AS n FROM r) WHERE length(q.token) >= 2""",
    ),
    "route_lexical": (route_lexical, f"WITH {_R}, {_A}, {_score_sql('x', 'r', 'id', 'content')}, {_score_sql('y', 'a', 'id', 'text')}, u AS ({_units('x', 'chunk')} UNION ALL {_units('y', 'field')}) SELECT *, row_number() OVER (ORDER BY unit DESC, source, id) AS place FROM u QUALIFY place <= 50"),
    "route_structured": (route_structured, f"WITH {_S}, {_A}, {_score_sql('x', 's', 'id', 'text')}, {_score_sql('y', 'a', 'id', 'text')}, u AS ({_units('x', 'unit')} UNION ALL {_units('y', 'anchor')}) SELECT *, row_number() OVER (ORDER BY unit DESC, source, id) AS place FROM u QUALIFY place <= 50"),
    "route_sections": (route_sections, f"WITH {_S}, {_score_sql('x', 's', 'id', 'text')}, u AS ({_units('x', 'section')}) SELECT u.id, unit, covered_chunk_ids[1] AS chunk_id, row_number() OVER (ORDER BY unit DESC, u.id) AS place FROM u JOIN s USING (id) QUALIFY place <= 30"),
    "route_questions": (
        route_questions,
        f"""WITH t AS (SELECT DISTINCT ON (id) id, title, revision_source, revision_no FROM kb_chunk_revision WHERE title IS NOT NULL), {_score_sql('x', 't', 'id', 'title')},
        y AS (SELECT id, regexp_replace(lower(title), '[^0-9a-z一-鿿]', '', 'g') AS l, revision_source, revision_no, round(score, 9) AS score FROM x JOIN t USING (id)),
        z AS (SELECT id, round(score + CASE WHEN l = 'bond' THEN 1.8 ELSE 0 END + CASE WHEN l LIKE '%bond%' THEN 1.2 ELSE 0 END + CASE WHEN revision_source = 'manual_edit' THEN 1.2 ELSE 0 END + CASE WHEN revision_no >= 3 THEN 1.1 ELSE 0 END, 6) AS score FROM y)
        SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM z QUALIFY place <= 50""",
    ),
    "community_search": (
        community_search,
        f"""WITH {_S}, f AS (SELECT section_id, min(file_node_id) AS community FROM kb_section GROUP BY section_id),
        c AS (SELECT community, count(*) AS members, {' + '.join(f"max((lower(text) LIKE '%{w}%')::INT)" for w in WORDS)} AS matched FROM s JOIN f USING (section_id) GROUP BY community),
        z AS (SELECT community, members, matched, round(least(0.99, 0.5 + 0.35 * matched / {len(WORDS)} + 0.10 * least(1.0, members / 20)), 6) AS score FROM c WHERE matched > 0)
        SELECT *, row_number() OVER (ORDER BY score DESC, community) AS place FROM z QUALIFY place <= 20""",
    ),
    "rerank_fallback": (rerank_fallback, f"WITH {_S}, {_score_sql('x', 's', 'id', 'text')}, u AS ({_units('x', 'section')}) SELECT id, unit AS score, row_number() OVER (ORDER BY unit DESC, id) AS rerank_rank FROM u QUALIFY rerank_rank <= 30"),
    "graph_relations": (
        graph_relations,
        f"""WITH {_A}, f AS (SELECT id, max(confidence)::DOUBLE AS w FROM kb_anchor_registry GROUP BY id),
        j AS (SELECT a.id, a.file_node_id, a.anchor_name, round(greatest(0.05, least(0.99, 0.82 + 0.10 * least(1, greatest(0, coalesce(w, 1))) + 0.04 * CASE WHEN length(evidence_quote) >= 40 THEN 1.0 ELSE 0.5 END - CASE WHEN c.section_id IS NULL THEN 0.06 ELSE 0 END + CASE WHEN c.file_node_id = a.file_node_id THEN 0.06 ELSE 0 END)), 6) AS score
            FROM a JOIN f USING (id) JOIN kb_chunk c ON c.id = a.source_chunk_id WHERE anchor_type = 'plan' AND evidence_quote IS NOT NULL)
        SELECT file_node_id, anchor_name, id, score FROM j QUALIFY row_number() OVER (PARTITION BY file_node_id, anchor_name ORDER BY score DESC, id) = 1""",
    ),
    "graph_field_context": (
        graph_field_context,
        f"""WITH {_A}, x AS (SELECT source_chunk_id AS c, anchor_type, min(anchor_name) AS n FROM a WHERE source_chunk_id IS NOT NULL GROUP BY ALL)
        SELECT a.id, d.n AS department, r.n AS role, u.n AS rule_document FROM a LEFT JOIN x d ON d.c = source_chunk_id AND d.anchor_type = 'department' LEFT JOIN x r ON r.c = source_chunk_id AND r.anchor_type = 'role' LEFT JOIN x u ON u.c = source_chunk_id AND u.anchor_type = 'rule_document'
        WHERE a.anchor_type = 'plan' AND source_chunk_id IS NOT NULL AND (d.n IS NOT NULL OR r.n IS NOT NULL OR u.n IS NOT NULL)""",
    ),
    "sibling_plans": (
        sibling_plans,
        "WITH s AS (SELECT DISTINCT id, file_node_id, section_type FROM kb_section WHERE section_type IS NOT NULL) SELECT q.id AS seed, s.id, row_number() OVER (PARTITION BY q.id ORDER BY abs(s.id - q.id), s.id) AS place FROM s q JOIN s USING (file_node_id, section_type) WHERE q.id % 50 = 0 AND s.id <> q.id QUALIFY place <= 20",
    ),
    "graph_path_scores": (
        graph_path_scores,
        f"""WITH a AS (SELECT DISTINCT ON (id) source_chunk_id AS chunk_id, regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS node, anchor_type, confidence::DOUBLE AS w, evidence_quote FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL),
        b AS (SELECT * FROM a WHERE node <> ''), d AS (SELECT node, count(*) AS degree FROM b GROUP BY node),
        p AS (SELECT x.chunk_id AS seed, y.node, y.chunk_id, least(0.99, greatest(0.05, 0.52 * coalesce(x.w, 0) + 0.30 * coalesce(least(x.w, y.w), 0.5) + least(0.08, 0.08 * ({_HELD.format('y.evidence_quote')}) / {len(WORDS)})
            - CASE WHEN y.anchor_type = 'other' THEN 0.10 ELSE 0 END - least(0.15, greatest(0, degree - 8) * 0.004) - 0.05)) AS s FROM b x JOIN b y USING (node) JOIN d USING (node) WHERE x.chunk_id % 50 = 0 AND x.chunk_id <> y.chunk_id)
        SELECT node, chunk_id, count(DISTINCT seed) AS support, round(least(0.99, max(s) + least(0.14, (count(DISTINCT seed) - 1) * 0.04)), 6) AS score FROM p GROUP BY node, chunk_id""",
    ),
    "field_priority": (
        field_priority,
        f"""WITH {_R}, {_score_sql('x', 'r', 'id', 'content')}, b AS (SELECT chunk_id, max(round(score, 9)) AS score, max({_HELD.format('content')}) AS words FROM x JOIN r USING (id) GROUP BY chunk_id),
        z AS (SELECT b.chunk_id, round(score + CASE WHEN b.chunk_id IN (SELECT source_chunk_id FROM kb_anchor_registry WHERE anchor_type = 'department') THEN 0.15 ELSE 0 END + CASE WHEN c.section_id IN (SELECT section_id FROM kb_section WHERE section_type = 'procedure') THEN 0.35 ELSE 0 END, 6) AS score, words FROM b JOIN kb_chunk c ON c.id = b.chunk_id)
        SELECT *, row_number() OVER (ORDER BY score DESC, words DESC, chunk_id) AS place FROM z QUALIFY place <= 30""",
    ),
    "context_choice": (
        context_choice,
        f"""WITH {_R}, n AS (SELECT chunk_id, max(length(content)) AS n FROM r GROUP BY chunk_id), c AS (SELECT k.id, section_id, chunk_type, coalesce(n, 0) AS n FROM kb_chunk k LEFT JOIN n ON n.chunk_id = k.id),
        s AS (SELECT section_id, id, n FROM c WHERE chunk_type = 'section_chunk' AND section_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n DESC, id) = 1), p AS (SELECT section_id, id, n FROM c WHERE chunk_type = 'parent_chunk' AND section_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n DESC, id) = 1)
        SELECT c.id, CASE WHEN s.n >= 700 THEN 'section' WHEN p.id IS NOT NULL THEN 'parent' WHEN s.id IS NOT NULL THEN 'section' ELSE 'self' END AS "by", CASE WHEN s.n >= 700 THEN s.id WHEN p.id IS NOT NULL THEN p.id WHEN s.id IS NOT NULL THEN s.id ELSE c.id END AS context_id
        FROM c LEFT JOIN s USING (section_id) LEFT JOIN p USING (section_id) WHERE c.chunk_type = 'small_chunk'""",
    ),
    "comparison_coverage": (comparison_coverage, None),
}
