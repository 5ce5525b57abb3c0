"""Queries: relations between chunks by rules, and what retrieval reads from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import relations as R
from veinstone.sources.tables import table

#: What a chunk's title, section and text say of it, as the rules ask for it.
_META_SQL = """
    rv AS (SELECT id, arg_max(title, create_time) AS title, arg_max(title_path, create_time) AS title_path FROM (SELECT DISTINCT id, title, title_path, create_time FROM kb_chunk_revision) GROUP BY id),
    st AS (SELECT section_id, min(section_type) AS section_type FROM kb_section GROUP BY section_id),
    c AS (SELECT k.id, k.file_node_id AS file, k.parse_generation AS generation, k.seq_no AS seq, k.section_id, k.chunk_type, st.section_type,
        nullif(regexp_extract(rv.title, '([0-9]{1,2}\\.[0-9]{1,2})', 1), '') AS clause_id, nullif(regexp_extract(rv.title, '([0-9]{1,2})\\.[0-9]{1,2}', 1), '') AS chapter_id,
        nullif(regexp_extract(rv.title, '[0-9]{1,2}\\.([0-9]{1,2})', 1), '') AS clause_order, CASE WHEN len(rv.title_path) >= 2 THEN rv.title_path[-2] END AS title_parent, k.content_hash AS table_key
        FROM kb_chunk k LEFT JOIN rv ON rv.id = k.latest_revision_id LEFT JOIN st USING (section_id)),
    m AS (SELECT id, file, generation, 'same_section_type' AS rule, nullif(section_type, '') AS key FROM c WHERE section_type <> 'other'
        UNION ALL SELECT id, file, generation, 'same_group', nullif(section_id, '') FROM c UNION ALL SELECT id, file, generation, 'same_clause', clause_id FROM c
        UNION ALL SELECT id, file, generation, 'same_chapter', chapter_id FROM c UNION ALL SELECT id, file, generation, 'same_title_parent', nullif(title_parent, '') FROM c
        UNION ALL SELECT id, file, generation, 'same_table', nullif(table_key, '') FROM c UNION ALL SELECT id, file, generation, 'db_schema_related', nullif(table_key, '') FROM c),
    g AS (SELECT *, count(*) OVER w AS members, min(id) OVER w AS class_id FROM m WHERE key IS NOT NULL WINDOW w AS (PARTITION BY file, generation, rule, key))
"""


def chunks_with_meta(spark, sf):
    """Chunks as the rules take them: clause and chapter from the title of the newest revision, the group from the section, the table from the content's hash."""
    k = table(spark, sf, "kb_chunk", "id", "file_node_id", "parse_generation", "seq_no", "section_id", "chunk_type", "latest_revision_id", "content_hash")
    r = table(spark, sf, "kb_chunk_revision", "id", "title", "title_path", "create_time").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("create_time"))).alias("title"), F.max_by("title_path", F.when(F.col("title_path").isNotNull(), F.col("create_time"))).alias("title_path"))
    s = table(spark, sf, "kb_section", "section_id", "section_type").groupBy("section_id").agg(F.min("section_type").alias("section_type"))
    part = lambda p, g: F.regexp_extract("title", p, g)
    number = r"([0-9]{1,2})\.([0-9]{1,2})"
    meta = F.create_map(
        F.lit("clause_id"), part(r"([0-9]{1,2}\.[0-9]{1,2})", 1), F.lit("chapter_id"), part(number, 1), F.lit("clause_order"), part(number, 2), F.lit("chunk_group_id"), F.col("section_id"),
        F.lit("title_parent"), F.when(F.size("title_path") >= 2, F.element_at("title_path", -2)), F.lit("table_key"), F.col("content_hash"),
    )
    return k.join(r, "latest_revision_id", "left").join(s, "section_id", "left").select("id", F.col("file_node_id").alias("file"), F.col("parse_generation").alias("generation"), F.col("seq_no").alias("seq"), "section_id", "chunk_type", "section_type", meta.alias("meta"))


def chunk_relation_classes(spark, sf):
    """Chunks tied by rules of equality: their class, its size and the links of each."""
    return R.classes(chunks_with_meta(spark, sf)).select("rule", "id", "class_id", "members", "links", "weight")


def _children(spark, sf):
    c = table(spark, sf, "kb_chunk", "id", "section_id", "chunk_type").where("section_id IS NOT NULL")
    own = c.where("chunk_type IN ('section_chunk', 'parent_chunk')").select("section_id", F.col("chunk_type").alias("kind"), F.col("id").alias("context"))
    return c.where("chunk_type = 'small_chunk'").select("section_id", F.col("id").alias("child")).join(own, "section_id").select("context", "kind", "child")


def chunk_relation_edges(spark, sf):
    """The next chunk and the next clause of each chunk, and its section and parent chunks."""
    return R.edges(chunks_with_meta(spark, sf), _children(spark, sf))


_EDGE_SQL = f"""{_META_SQL},
    n AS (SELECT id, lead(id) OVER w AS next, try_cast(clause_order AS INT) AS a, try_cast(lead(clause_order) OVER w AS INT) AS b FROM c WINDOW w AS (PARTITION BY file, generation ORDER BY seq, id)),
    e AS (SELECT 'adjacent_next' AS rule, id AS from_id, next AS to_id, 1.0::DOUBLE AS weight FROM n WHERE next IS NOT NULL
        UNION ALL SELECT 'adjacent_clause', id, next, 0.82 FROM n WHERE next IS NOT NULL AND a + 1 = b
        UNION ALL SELECT CASE k.chunk_type WHEN 'section_chunk' THEN 'section_context' ELSE 'parent_context' END, s.id, k.id, CASE k.chunk_type WHEN 'section_chunk' THEN 0.92 ELSE 0.74 END
            FROM kb_chunk s JOIN kb_chunk k ON k.section_id = s.section_id AND k.chunk_type IN ('section_chunk', 'parent_chunk') WHERE s.chunk_type = 'small_chunk')"""


def chunk_neighbours(spark, sf):
    """The other ends of each seed's edges, of chunks that are in force, by weight, sequence and id: twelve a seed. Seeds are the ids divisible by 50."""
    e = chunk_relation_edges(spark, sf)
    both = e.select(F.col("from_id").alias("seed"), F.col("to_id").alias("id"), "weight").unionByName(e.select(F.col("to_id").alias("seed"), F.col("from_id").alias("id"), "weight")).where("seed % 50 = 0")
    best = both.groupBy("seed", "id").agg(F.max("weight").alias("weight"))
    live = table(spark, sf, "kb_chunk", "id", "seq_no", "enabled", "audit_status", "del_flag").where("enabled AND audit_status = 'approved' AND NOT coalesce(del_flag, false)")
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "seq_no", "id")
    return best.join(live, "id").withColumn("place", F.row_number().over(order)).where("place <= 12").select("seed", "id", "weight", "place")


def chunk_fetch(spark, sf):
    """Chunks by ids (those divisible by 50) with the text in force and the section's pointer, each once."""
    ids = table(spark, sf, "kb_chunk", "id").where("id % 50 = 0")
    c = table(spark, sf, "kb_chunk", "id", "section_id", "published_revision_id", "latest_revision_id").withColumn("rid", F.coalesce("published_revision_id", "latest_revision_id"))
    r = table(spark, sf, "kb_chunk_revision", "id", "content").where("content IS NOT NULL").groupBy(F.col("id").alias("rid")).agg(F.max("content").alias("content"))
    p = table(spark, sf, "kb_section", "section_id", "seq_start").groupBy("section_id").agg(F.min("seq_start").alias("seq_start"))
    return c.join(ids, "id", "left_semi").join(r, "rid").join(p, "section_id", "left").select("id", "section_id", "seq_start", F.length("content").alias("characters")).distinct()


CATALOGUE = {
    "chunk_relation_classes": (chunk_relation_classes, f"""WITH {_META_SQL.replace("arg_max(title, create_time)", "arg_max(title, create_time) FILTER (WHERE title IS NOT NULL)").replace("arg_max(title_path, create_time)", "arg_max(title_path, create_time) FILTER (WHERE title_path IS NOT NULL)")}
        SELECT rule, id, class_id, members, members - 1 AS links, CASE rule WHEN 'same_section_type' THEN 0.6 WHEN 'same_group' THEN 0.85 WHEN 'same_clause' THEN 0.9 WHEN 'same_chapter' THEN 0.7 WHEN 'same_title_parent' THEN 0.65 WHEN 'same_table' THEN 0.8 ELSE 0.88 END::DOUBLE AS weight FROM g WHERE members > 1"""),
    "chunk_relation_edges": (chunk_relation_edges, f"WITH {_EDGE_SQL} SELECT * FROM e"),
    "chunk_neighbours": (
        chunk_neighbours,
        f"""WITH {_EDGE_SQL}, b AS (SELECT seed, id, max(weight) AS weight FROM (SELECT from_id AS seed, to_id AS id, weight FROM e UNION ALL SELECT to_id, from_id, weight FROM e) WHERE seed % 50 = 0 GROUP BY ALL)
        SELECT seed, b.id, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, seq_no NULLS FIRST, b.id) AS place FROM b JOIN kb_chunk k ON k.id = b.id WHERE enabled AND audit_status = 'approved' AND NOT coalesce(del_flag, false) QUALIFY place <= 12""",
    ),
    "chunk_fetch": (
        chunk_fetch,
        """SELECT DISTINCT k.id, k.section_id, p.seq_start, length(r.content) AS characters FROM kb_chunk k JOIN (SELECT id, max(content) AS content FROM kb_chunk_revision WHERE content IS NOT NULL GROUP BY id) r ON r.id = coalesce(published_revision_id, latest_revision_id)
        LEFT JOIN (SELECT section_id, min(seq_start) AS seq_start FROM kb_section GROUP BY section_id) p USING (section_id) WHERE k.id % 50 = 0""",
    ),
}
